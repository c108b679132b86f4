"""A store of thumbnails by asset and size: Parquet, partitioned by the first two characters of the asset's id.

Lists and existence read the keys only, never the contents. A thumbnail that is stored again replaces the older one.
Trees of image files, laid out as prefix/asset_size.jpg, are read with Spark's binaryFile source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import history, ranking

SCHEMA = "asset_id string, size string, content binary, bytes long, stored_at timestamp, prefix string"
FILE_NAME = r"([^/]+)_([A-Za-z0-9]+)\.[A-Za-z0-9]+$"


def prefix_of(asset_id: Column) -> Column:
    """The partition; ids that are shorter have themselves, an empty or null id '_'."""
    return F.coalesce(F.nullif(F.substring(asset_id, 1, 2), F.lit("")), F.lit("_"))


def put(thumbnails: DataFrame, folder: str) -> None:
    """Adds thumbnails (asset_id, size, content, stored_at) to the store; rows of a prefix come together, so a run adds few files to each."""
    rows = thumbnails.select(F.col("asset_id").cast("string").alias("asset_id"), "size", "content", F.octet_length("content").cast("long").alias("bytes"), "stored_at", prefix_of(F.col("asset_id").cast("string")).alias("prefix"))
    rows.repartition("prefix").write.partitionBy("prefix").mode("append").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All thumbnails as they were stored, older ones too."""
    return spark.read.schema(SCHEMA).parquet(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id, size, bytes, stored_at and prefix of the newest thumbnail of each asset and size; contents are not read."""
    return history.latest_per(stored(spark, folder).drop("content"), ["asset_id", "size"], [F.desc("stored_at"), F.desc("bytes")])


def held(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (asset_id, size) with held: whether the store has it."""
    there = stored(spark, folder).select(F.col("asset_id").alias("__id"), F.col("size").alias("__size"), F.col("prefix").alias("__prefix")).distinct()
    on = (prefix_of(F.col("asset_id")) == F.col("__prefix")) & (F.col("asset_id") == F.col("__id")) & (F.col("size") == F.col("__size"))
    return wanted.join(there, on, "left").withColumn("held", F.col("__id").isNotNull()).drop("__id", "__size", "__prefix")


def contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """asset_id, size and content of the wanted (asset_id, size); the join on prefix lets Spark leave out other partitions."""
    asked = wanted.select("asset_id", "size", prefix_of(F.col("asset_id")).alias("prefix")).distinct()
    met = stored(spark, folder).join(asked, ["prefix", "asset_id", "size"], "left_semi")
    return history.latest_per(met, ["asset_id", "size"], [F.desc("stored_at"), F.desc("bytes")]).select("asset_id", "size", "content")


def evicted(spark: SparkSession, folder: str, budget: int) -> DataFrame:
    """asset_id and size of the thumbnails that go, the oldest first within each prefix, until a prefix keeps its share of the budget.

    A prefix's share is the budget's part by its bytes, so that prefixes are judged beside each other and no task sees all.
    """
    rows = listing(spark, folder)
    sums = rows.groupBy("prefix").agg(F.sum("bytes").alias("of_prefix"))
    total = sums.agg(F.sum("of_prefix")).first()[0] or 0
    shared = rows.join(sums.select("prefix", F.floor(F.col("of_prefix") * F.lit(budget) / F.lit(max(total, 1))).alias("share")), "prefix")
    return ranking.evict_to_budget(shared, "bytes", F.col("share"), [F.col("stored_at"), F.col("asset_id"), F.col("size")], ["prefix"]).select("asset_id", "size")


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id, size, bytes, stored_at and content of a tree of image files; where content isn't selected, files are only listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = lambda k: F.regexp_extract("path", FILE_NAME, k)
    return files.where(name(1) != "").select(name(1).alias("asset_id"), name(2).alias("size"), F.col("length").alias("bytes"), F.col("modificationTime").alias("stored_at"), "content")
