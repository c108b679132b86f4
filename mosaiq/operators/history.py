"""Caches, runs and attempts as snapshots: joins, streaks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def uncached(assets: DataFrame, cache: DataFrame, key: str, checksum: str) -> DataFrame:
    """Assets without a cached row, or with one of another checksum."""
    held = cache.select(F.col(key).alias("__key"), F.col(checksum).alias("__sum"))
    joined = assets.join(held, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__key").isNull() | ~F.col(checksum).eqNullSafe(F.col("__sum"))).drop("__key", "__sum")


def failure_streaks(attempts: DataFrame, key: str, order: list[Column], failed: Column, completed: Column, time: str) -> DataFrame:
    """Failures per key since its last success, and when the last one was; keys without any are left out.

    The last success of each key is found first, so a key's rows are not gone through again for each of them.
    order: columns that ascend.
    """
    at = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    marked = attempts.select(key, F.col(time).alias("__time"), at.alias("__at"), failed.alias("__failed"), completed.alias("__completed"))
    done = marked.where("__completed").groupBy(F.col(key).alias("__key")).agg(F.max("__at").alias("__done"))
    since = marked.where("__failed").join(done, F.col(key).eqNullSafe(F.col("__key")), "left").where(F.col("__done").isNull() | (F.col("__at") > F.col("__done")))
    return since.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.max("__time").alias("last_failed_at"))


def upserted(table: DataFrame, rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The table after rows replaced whole rows of the same key, the newest of each key."""
    return latest_per(table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1))), key, [F.desc("__new"), *version]).drop("__new")


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti"))


def merged(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with values of rows of the same key where they aren't null, and rows of new keys."""
    others = [c for c in table.columns if c not in key]
    new = rows.select(*key, *[F.col(c).alias(f"__{c}") for c in others if c in rows.columns])
    joined = table.join(new, key, "full")
    return joined.select(*key, *[F.coalesce(f"__{c}", c).alias(c) if c in rows.columns else F.col(c) for c in others])


def transitioned(table: DataFrame, key: str, requested: DataFrame, status: str, allowed: str, to: str) -> DataFrame:
    """The table with requested rows moved from the allowed status; applied tells which rows moved, null where none was asked."""
    asked = requested.select(F.col(key)).distinct().withColumn("__asked", F.lit(True))
    joined = table.join(asked, key, "left")
    moves = F.when(F.col("__asked"), F.col(status) == allowed)
    return joined.withColumn("applied", moves).withColumn(status, F.when(moves, to).otherwise(F.col(status))).drop("__asked")


def without_parents(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children after a delete that cascades."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def payload_or_null(payload: Column) -> Column:
    """A struct, or null where all of its fields are; fields are told apart by their JSON, which leaves nulls out."""
    return F.when(F.to_json(payload) != "{}", payload)


def replaced(status: Column, old: str, new: str) -> Column:
    return F.when(status == old, new).otherwise(status)
