"""Moments, series, clusters and trips: groups of rows that lie close in time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mosaiq.functions import geo


def seconds_between(early: Column, late: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 1e6


def moments(df: DataFrame, time: str, gap_s: float, by: list[str], tie: str, out: str = "moment") -> DataFrame:
    """Numbers the moments of each key: a gap of more than gap_s starts another; rows without a time stand alone."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(time), tie)
    starts = F.col(time).isNull() | F.lag(time).over(w).isNull() | (seconds_between(F.lag(time).over(w), F.col(time)) > gap_s)
    return df.withColumn("__starts", starts.cast("int")).withColumn(out, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__starts")


def best_per_moment(df: DataFrame, time: str, gap_s: float, by: list[str], favorite: str, score: str, tie: str) -> DataFrame:
    """One row a moment: a favorite first, then the best score, then the smallest tie."""
    w = Window.partitionBy(*by, "moment").orderBy(F.desc(favorite), F.desc(score), tie)
    return moments(df, time, gap_s, by, tie).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def chunked_series(df: DataFrame, time: str, gap_s: float, by: list[str], tie: str, size: int = 4) -> DataFrame:
    """Moments cut into chunks of a size; mode is collage where a chunk has two rows or more."""
    marked = moments(df, time, gap_s, by, tie, "series")
    w = Window.partitionBy(*by, "series").orderBy(time, tie)
    chunked = marked.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "series", "chunk"))
    return chunked.withColumn("mode", F.when(n >= 2, "collage").otherwise("single"))


def trim_points(df: DataFrame, time: str, length: str, by: list[str], tie: str) -> DataFrame:
    """trim_start and trim_end in seconds, so that neighbours that overlap meet half way."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    before = F.greatest(F.lit(0.0), F.lag(length).over(w) - seconds_between(F.lag(time).over(w), F.col(time)))
    after = F.greatest(F.lit(0.0), F.col(length) - seconds_between(F.col(time), F.lead(time).over(w)))
    return df.withColumn("trim_start", F.coalesce(before / 2, F.lit(0.0))).withColumn("trim_end", F.col(length) - F.coalesce(after / 2, F.lit(0.0)))


def trips(df: DataFrame, time: str, lat: str, lon: str, by: list[str], tie: str, home: tuple[float, float], km: float = 50.0, gap_days: float = 2.0, least_days: int = 2) -> DataFrame:
    """Runs of rows away from home without a gap of more than gap_days, of least_days calendar days or more.

    The centre leaves out coordinates of exactly zero, each axis for itself.
    """
    far = df.where(geo.away(F.col(lat), F.col(lon), home, km))
    grouped = moments(far, time, gap_days * 86400, by, tie, "trip").groupBy(*by, "trip").agg(
        F.min(time).cast("date").alias("start_date"),
        F.max(time).cast("date").alias("end_date"),
        F.count(F.lit(1)).alias("n_assets"),
        F.avg(F.nullif(F.col(lat), F.lit(0.0))).alias("lat"),
        F.avg(F.nullif(F.col(lon), F.lit(0.0))).alias("lon"),
    )
    return grouped.withColumn("days", (F.datediff("end_date", "start_date") + 1).cast("int")).where(F.col("days") >= least_days)


def neighbours(df: DataFrame, tagged: Column, time: str, window_s: float, by: list[str]) -> DataFrame:
    """Tagged rows, and rows within so many seconds of a tagged one, found in both directions in one sort."""
    w = Window.partitionBy(*by).orderBy(time)
    when = F.when(tagged, F.col(time))
    last = F.last(when, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    following = F.first(when, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = (seconds_between(last, F.col(time)) <= window_s) | (seconds_between(F.col(time), following) <= window_s)
    return df.withColumn("__near", tagged | F.coalesce(near, F.lit(False))).where("__near").drop("__near")


def bursts(df: DataFrame, time: str, hash_bits: str, score: str, by: list[str], tie: str, window_s: float = 300, most_bits: int = 8) -> DataFrame:
    """Of each burst the best row: rows within a window of the burst's first row whose hash is near the first's.

    Rows without a hash stand alone. Islands without a gap of more than the window are dealt to tasks and streamed in
    order; a queue holds the bursts that are open, and those whose window is over leave it, so a row meets open bursts only.
    """
    islands = moments(df, time, window_s, by, tie, "__island")
    keys = [F.hash(*by, "__island").alias("__key"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62))).alias("__t")]
    sent = islands.select(*by, "__island", *keys, F.col(hash_bits).alias("__h"), F.col(score).cast("double").alias(score), F.col(tie).alias(tie))
    order = [*by, "__island", "__t", tie]
    schema = StructType([*[df.schema[c] for c in by], df.schema[tie]]).add(score, "double")
    window, n = int(window_s * 1e6), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_bursts = None, deque()  # bursts are [time, hash, row]
        for batch in batches:
            done: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, island, _, t, h, s, i in zip(*columns, strict=True):
                if (key, island) != now:
                    done += [b[2] for b in open_bursts]
                    open_bursts.clear()
                    now = (key, island)
                while open_bursts and t - open_bursts[0][0] > window:
                    done.append(open_bursts.popleft()[2])
                row = (*key, i, s)
                if h is None:
                    done.append(row)
                    continue
                held = next((b for b in open_bursts if ((b[1] ^ h) & 0xFFFFFFFFFFFFFFFF).bit_count() <= most_bits), None)
                if held is None:
                    open_bursts.append([t, h, row])
                elif s is not None and (held[2][-1] is None or s > held[2][-1]):
                    held[2] = row
            yield from rows_of(done)
        yield from rows_of([b[2] for b in open_bursts])

    def rows_of(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            kinds = to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], type=kinds.field(k).type) for k in range(n + 2)], schema=kinds)

    return sent.repartition("__key").sortWithinPartitions(*order).mapInArrow(run, schema)


def same_moment(df: DataFrame, time: str, window_s: float, by: list[str], chosen: Column, tie: str) -> DataFrame:
    """Adds same_moment: another chosen row lies within so many seconds, both ends included; found in both directions in one sort."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    when = F.when(chosen, F.col(time))
    last = F.last(when, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(when, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = (seconds_between(last, F.col(time)) <= window_s) | (seconds_between(F.col(time), following) <= window_s)
    return df.withColumn("same_moment", F.coalesce(near, F.lit(False)))
