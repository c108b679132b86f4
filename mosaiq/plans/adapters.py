"""The curation schema over the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.hashing import sign_bits

HOME = (50.8468, 4.3525)

#: The same columns in DuckDB, as a common table expression.
ASSETS_SQL = """a AS (
  SELECT event_id AS asset_id, user_id AS owner, ts AS taken_at, event_type AS kind, event_type = 'purchase' AS favorite,
    value AS score, CAST(1.0 + event_id % 10 AS DOUBLE) AS duration, 640 * (1 + event_id % 6) AS width, 360 * (1 + event_id % 6) AS height,
    1000000 * (event_id % 50) AS bitrate, event_id % 3 = 0 AS tagged, props,
    CASE WHEN (day(ts) + user_id) % 10 < 5 THEN 50.8468 ELSE 41.38 + (event_id % 5) * 0.01 END::DOUBLE AS lat,
    CASE WHEN (day(ts) + user_id) % 10 < 5 THEN 4.3525 ELSE 2.17 + (event_id % 7) * 0.01 END::DOUBLE AS lon
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_home = (F.dayofmonth("ts") + F.col("user_id")) % 10 < 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("asset_id"),
        F.col("user_id").alias("owner"),
        F.col("ts").alias("taken_at"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") == "purchase").alias("favorite"),
        F.col("value").alias("score"),
        (1.0 + F.col("event_id") % 10).alias("duration"),
        (640 * (1 + F.col("event_id") % 6)).alias("width"),
        (360 * (1 + F.col("event_id") % 6)).alias("height"),
        (1_000_000 * (F.col("event_id") % 50)).alias("bitrate"),
        (F.col("event_id") % 3 == 0).alias("tagged"),
        "props",
        F.when(at_home, HOME[0]).otherwise(41.38 + (F.col("event_id") % 5) * 0.01).alias("lat"),
        F.when(at_home, HOME[1]).otherwise(2.17 + (F.col("event_id") % 7) * 0.01).alias("lon"),
    )


HASHES_SQL = """h AS (
  SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)), lambda x, y: x + y)::UBIGINT AS bits
  FROM embeddings)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_bits(F.col("embedding")).alias("bits"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


MONTHS_SQL = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)"
