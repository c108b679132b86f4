"""Sharding by fixed virtual slots.

Each record is hashed into one of a fixed number of virtual slots, bytes are summed
per slot, and a versioned map gives the shard of each slot. Version 1 deals the
slots round robin; a rebalancing edits the map and makes the next version: in each
shard the largest slots stay as long as their sum is within an even share, the
others move to whatever shard has least. The map has as many rows as there are
slots, whatever the number of records, so it may be broadcast. Each version is stored
in a folder of its own, which saving it again replaces.

A record's slot comes from its id and checksum. Records alike in both would crowd one
slot, so where there are several, each one's place in the written table counts too.

Defined results: a null text has no bytes (size 1); null and repeated ids are
records like any other; rows are never dropped; an empty table gives an empty
result. Ties are settled by slot number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

SLOTS = 4096


def with_slots(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and row (a number of its own) of each record; written, so that row stays what it is."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), checksum.alias("text_crc32"), F.monotonically_increasing_id().alias("row")))
    hashed = F.xxhash64("doc_id", "text_crc32")
    several = cut(keyed.groupBy(hashed.alias("alike")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("alike"))
    own = F.when(F.col("alike").isNotNull(), F.xxhash64("doc_id", "text_crc32", "row")).otherwise(hashed)
    marked = keyed.join(several, hashed == F.col("alike"), "left")
    return marked.withColumn("virtual_slot", F.pmod(own, F.lit(slots)).cast("int")).drop("alike")


def slot_totals(keyed: DataFrame) -> DataFrame:
    """virtual_slot, bytes and records; at most one row a slot."""
    return keyed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt round robin."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, edited so that the shards' bytes are near equal; shards may be more or fewer than before."""
    load = slot_map.join(F.broadcast(totals), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    running = load.withColumn("running", F.sum("bytes").over(by_size))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    marked = running.withColumn("stays", (F.col("running") <= share) & (F.col("shard") < shards))
    slot = F.struct((-F.col("bytes")).alias("less"), "virtual_slot")
    whole = marked.agg(
        (F.max("version") + 1).alias("version"),
        F.array_agg(F.when(F.col("stays"), F.struct("virtual_slot", "shard"))).alias("kept"),
        F.sort_array(F.array_agg(F.when(~F.col("stays"), slot))).alias("movers"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)) for k in range(shards)]).alias("loads"),
    )
    moved = F.expr("""
        aggregate(movers, named_struct('loads', loads, 'moved', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
          (a, m) -> named_struct(
            'loads', transform(a.loads, (x, k) -> if(k = array_position(a.loads, array_min(a.loads)) - 1, x - m.less, x)),
            'moved', concat(a.moved, array(named_struct('virtual_slot', m.virtual_slot, 'shard', cast(array_position(a.loads, array_min(a.loads)) - 1 as int))))),
          a -> a.moved)""")
    return whole.select("version", F.explode(F.concat("kept", moved)).alias("x")).select("version", "x.virtual_slot", "x.shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Stores a version of the map beside earlier ones; saved again, it replaces itself."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest by default."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    wanted: Column | int = F.lit(version) if version is not None else F.lit(stored.agg(F.max("version")).first()[0])
    return stored.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def placed(keyed: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Each record with its shard and its place in the shard (slot, gapless from 0).

    A record's place is its place in its virtual slot after the records of the
    shard's earlier slots; so no task sorts a whole shard.
    """
    before = F.sum("records").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("records")
    places = slot_map.join(F.broadcast(totals), "virtual_slot").select("version", "virtual_slot", "shard", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row"))
    return keyed.withColumn("within", within).join(F.broadcast(places), "virtual_slot").withColumn("slot", (F.col("before") + F.col("within") - 1).cast("long")).drop("before", "within", "row")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """docs' ids with size, checksum, virtual slot, shard and place, by the newest stored map (maps: its folder), rebalanced once and stored.

    Without a stored map the first one is stored and then rebalanced; without a folder a new one in the shared folder is taken.
    """
    spark = docs.sparkSession
    keyed = with_slots(docs, slots)
    totals = cut(slot_totals(keyed))
    if maps is None:
        maps = shared_dir(spark)
        save_map(first_map(spark, shards, slots), maps)
    save_map(rebalanced(load_map(spark, maps), totals, shards), maps)
    return placed(keyed, load_map(spark, maps), totals)
