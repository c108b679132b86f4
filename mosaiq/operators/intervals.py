"""Interval analytics: islands, gaps, overlaps and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, start: str, end: str, by: list[str], buffer: float = 0.0) -> DataFrame:
    """Unions of intervals, each widened by the buffer; intervals that touch become one."""
    wide = df.select(*by, (F.col(start) - buffer).alias("start"), (F.col(end) + buffer).alias("end"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    heads = wide.withColumns({"__reach": reach, "__last": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where(F.col("__reach").isNull() | (F.col("start") > F.col("__reach")))
    following = F.lead("__reach").over(w)  # what an island reaches is known to the head of the next one
    return heads.select(*by, "start", F.when(F.lead(F.lit(1)).over(w).isNull(), F.col("__last")).otherwise(following).alias("end"))


def gaps(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """What lies between the merged intervals."""
    w = Window.partitionBy(*by).orderBy("start")
    return merged(df, start, end, by).select(*by, F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where("end is not null")


def union_length(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """The seconds that intervals cover, overlaps once."""
    return merged(df, start, end, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) that overlap, and for how long; width bounds right's lengths.

    Both sides are joined by bins of that width, so only neighbours meet.
    """
    bins = F.sequence(F.floor(F.col("start") / width) - 1, F.floor(F.col("end") / width))
    binned = left.withColumn("__bin", F.explode(bins))
    met = binned.join(right.withColumn("__bin", F.floor(F.col("r_start") / width)), [*by, "__bin"])
    held = met.where((F.col("r_end") > F.col("start")) & (F.col("r_start") < F.col("end")))
    return held.withColumn("overlap", F.least("end", "r_end") - F.greatest("start", "r_start")).drop("__bin")


def runs_where(df: DataFrame, holds: Column, time: str, step: float, by: list[str], least: float) -> DataFrame:
    """Runs of rows for which a condition holds, as intervals of at least so many seconds."""
    w = Window.partitionBy(*by).orderBy(time)
    marked = df.withColumn("__holds", holds).withColumn("__new", (~F.coalesce(F.lag("__holds").over(w) == F.col("__holds"), F.lit(False))).cast("int"))
    numbered = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.where("__holds").groupBy(*by, "__run").agg(F.min(time).alias("start"), (F.max(time) + step).alias("end")).drop("__run")
    return found.where(F.col("end") - F.col("start") >= least)


def sliding_segments(df: DataFrame, length: str, size: float, overlap: float, tail: float = 0.5) -> DataFrame:
    """Windows over a source of some length; a last partial one stays if it has enough of the size."""
    step = size - overlap
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.col(length) - tail * size, F.lit(0.0)) / step).cast("int")), lambda k: k * F.lit(step))
    cut = df.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size, F.col(length)))
    return cut.where(F.col("end") - F.col("start") >= tail * size)


def nearest(points: Column, target: Column) -> Column:
    """The point of an array that is nearest to the target; the smaller of two equally near."""
    return F.array_min(F.transform(points, lambda p: F.struct(F.abs(p - target).alias("d"), p.alias("p"))))["p"]


def nearest_of_length(points: DataFrame, time: str, starts: DataFrame, start: str, length: int, tie: str, by: list[str]) -> DataFrame:
    """by and time (as __ and the name), distance and tie of the nearest interval of each different time: of the intervals that hold it, or else of the nearest ones before and after it, the one with the smallest tie.

    Times and starts are whole numbers, and all intervals are of one length. A time or a start that is null is at no distance from all.
    Intervals of one start count once, and a start meets the times that it holds; the neighbours come from windows, so nothing is paired with all.
    """
    keys = [f"__{b}" for b in by]
    different = points.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(time).alias("__t")).distinct()
    first = starts.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(start).alias("__lo")).agg(F.min(tie).alias(tie))
    known = first.where("__lo is not null")
    held = known.select(*keys, F.explode(F.sequence("__lo", F.col("__lo") + length)).alias("__t"), tie).groupBy(*keys, "__t").agg(F.min(tie).alias("__in"))
    everywhere = first.groupBy(*keys).agg(F.min(F.when(F.col("__lo").isNull(), F.col(tie))).alias("__always"), F.min(tie).alias("__any"))
    met = different.join(held, [*keys, "__t"], "left").join(everywhere, keys)

    none = F.lit(None).cast("long")
    marks = met.select(*keys, "__t", none.alias("__start"), none.alias("__end"), F.lit(None).cast(starts.schema[tie].dataType).alias(tie), "__in", "__always", "__any", F.lit(1).alias("__point"))
    for edge in ("__start", "__end"):
        at = F.col("__lo") + (length if edge == "__end" else 0)
        marks = marks.unionByName(known.select(*keys, at.alias("__t"), at.alias(edge), tie, F.lit(0).alias("__point")), allowMissingColumns=True)
    whole = Window.partitionBy(*keys)
    neighbour = lambda edge: F.when(F.col(edge).isNotNull(), F.struct(F.col(edge).alias("at"), F.col(tie).alias(tie)))
    before = F.last(neighbour("__end"), ignorenulls=True).over(whole.orderBy(F.asc_nulls_first("__t"), "__point").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(neighbour("__start"), ignorenulls=True).over(whole.orderBy(F.desc_nulls_first("__t"), "__point").rowsBetween(Window.unboundedPreceding, 0))
    option = lambda holds, distance, name: F.when(holds, F.struct(distance.cast("long").alias("distance"), name.alias(tie)))
    beside = marks.withColumns({"__b": before, "__a": after}).where("__point = 1")
    zero = [option(F.col(c).isNotNull(), F.lit(0), F.col(c)) for c in ("__in", "__always")] + [option(F.col("__t").isNull(), F.lit(0), F.col("__any"))]
    apart = [option(F.col("__b").isNotNull(), F.col("__t") - F.col("__b.at"), F.col(f"__b.{tie}")), option(F.col("__a").isNotNull(), F.col("__a.at") - F.col("__t"), F.col(f"__a.{tie}"))]
    best = F.array_min(F.array_compact(F.array(*zero, *[F.when(F.coalesce(x["distance"] > 0, F.lit(False)), x) for x in apart])))
    return beside.withColumn("__best", best).select(*keys, "__t", F.col("__best.distance").alias("distance"), F.col(f"__best.{tie}").alias(tie))


def between_points(points: DataFrame, time: str, audio: str, by: list[str], least: float, most: float) -> DataFrame:
    """start and end of pairs of cut points so far apart, and kind: 1 between audio points, 2 with one, 3 without."""
    a, b = points.alias("a"), points.alias("b")
    apart = F.col(f"b.{time}") - F.col(f"a.{time}")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [apart.between(least, most)])
    edges = F.col(f"a.{audio}").cast("int") + F.col(f"b.{audio}").cast("int")
    return met.select(*[F.col(f"a.{k}").alias(k) for k in by], F.col(f"a.{time}").alias("start"), F.col(f"b.{time}").alias("end"), (3 - edges).alias("kind"))


def by_precedence(segments: DataFrame, by: list[str], best: float, most: int) -> DataFrame:
    """Of each key the segments of its best kind; of those with one audio edge the most whose length is nearest to the best."""
    kept = segments.withColumn("__kind", F.min("kind").over(Window.partitionBy(*by))).where("kind = __kind").drop("__kind")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(F.col("end") - F.col("start") - best), "start", "end"))
    return kept.withColumn("__n", place).where((F.col("kind") != 2) | (F.col("__n") <= most)).drop("__n")
