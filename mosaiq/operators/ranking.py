"""Ranks, quotas and selections by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint_rank(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """0 to 1 by rank, equal values share the middle of their ranks; a single row has 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value))
    return df.withColumn(out, F.when(n > 1, (rank - 1 + (ties - 1) / 2) / (n - 1)).otherwise(1.0))


def fill_until_crossed(df: DataFrame, amount: str, limit: Column, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in order until their sum crosses the limit; the row that crosses it is in."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(amount).over(w), F.lit(0))).where(F.col("__before") < limit).drop("__before")


def top_per(df: DataFrame, by: list[str], order: list[Column], most: Column | int) -> DataFrame:
    """The first rows of each key; most may depend on the row."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, by, order, 1)


def trailing_burst(df: DataFrame, period: str, count: str, by: list[str], threshold: float = 2.0, rows: int = 12) -> DataFrame:
    """Periods whose count is over threshold times the average of the periods before, up to so many present rows."""
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(-rows, -1)
    return df.withColumn("average", F.avg(count).over(w)).withColumn("ratio", F.col(count) / F.col("average")).where(F.col("ratio") > threshold)


def evict_to_budget(df: DataFrame, size: str, budget: Column | int, order: list[Column], by: list[str]) -> DataFrame:
    """The oldest rows that go until what is left fits the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size).over(Window.partitionBy(*by))
    return df.withColumn("__left", total - F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("__left") > budget).drop("__left")


def event_periods(df: DataFrame, period: str, by: list[str], tagged: Column, factor: float = 3.0, share: float = 0.1, most: int = 2) -> DataFrame:
    """The largest periods: at least factor times the upper median of sizes, with enough tagged rows."""
    sizes = df.groupBy(*by, period).agg(F.count(F.lit(1)).alias("n"), F.avg(tagged.cast("double")).alias("share"))
    median = sizes.groupBy(*by).agg(F.array_sort(F.array_agg("n")).alias("all")).select(*by, F.element_at("all", F.floor(F.size("all") / 2).cast("int") + 1).alias("median"))
    held = sizes.join(median, by).where((F.col("n") >= factor * F.col("median")) & (F.col("share") >= share))
    return top_per(held, by, [F.desc("n"), F.col(period)], most)


def ratio_cap(df: DataFrame, capped: Column, ratio: float, by: list[str], order: list[Column]) -> DataFrame:
    """Capped rows are at most so much of the whole: int(v * r / (1 - r)) beside v others; the first in order stay."""
    others = F.sum((~capped).cast("int")).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by, "__capped").orderBy(*order))
    marked = df.withColumn("__capped", capped).withColumn("__most", F.floor(others * ratio / (1 - ratio))).withColumn("__place", place)
    return marked.where(~F.col("__capped") | (F.col("__place") <= F.col("__most"))).drop("__capped", "__most", "__place")


def even_sample(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """k of n rows in even steps, first and last included: the rows at round(i * (n - 1) / (k - 1))."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    numbered = df.withColumn("__n", n).withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(1, k - 1))).cast("int"))
    return numbered.where((F.col("__n") <= k) | F.array_contains(wanted, F.col("__at"))).drop("__n", "__at")


def greedy_fit(df: DataFrame, amount: str, budget: Column | float, by: list[str], order: list[Column], tie: str) -> DataFrame:
    """Rows in order that still fit the budget (the same in all rows of a key); one that doesn't is skipped and later, smaller ones may follow.

    A fold in the order of the rows, per key; each key's rows meet in one task.
    """
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    row = F.struct("__n", F.col(amount).cast("double").alias("amount"), F.col(tie).alias("id"))
    kind = f"array<{df.schema[tie].dataType.simpleString()}>"
    first = F.struct(F.lit(0.0).alias("used"), F.array().cast(kind).alias("ids"))

    def step(a: Column, r: Column) -> Column:
        fits = a["used"] + r["amount"] <= F.col("__budget")
        return F.struct(F.when(fits, a["used"] + r["amount"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["ids"], F.array(r["id"]))).otherwise(a["ids"]).alias("ids"))

    folded = ranked.groupBy(*by).agg(F.array_sort(F.array_agg(row)).alias("rows"), F.max(budget if isinstance(budget, Column) else F.lit(float(budget))).alias("__budget")).select(*by, F.aggregate("rows", first, step, lambda a: a["ids"]).alias("ids"))
    return folded.select(*by, F.explode("ids").alias(tie))


def judged_out(df: DataFrame, score: str, favorite: str, time: str, by: list[str], tie: str, floor: float = 0.3, share: float = 0.6) -> DataFrame:
    """Rows that fail the gate: scores under the floor, and a weak last row; favorites are exempt."""
    w = Window.partitionBy(*by)
    last = F.row_number().over(w.orderBy(F.desc_nulls_last(time), F.col(tie))) == 1
    weakest = F.col(score) == F.min(score).over(w)
    weak_end = (F.count(F.lit(1)).over(w) > 2) & last & weakest & (F.col(score) < share * F.avg(score).over(w))
    return df.withColumn("__out", ~F.col(favorite) & ((F.col(score) < floor) | weak_end)).where("__out").drop("__out")


def dominant(counts: DataFrame, by: list[str], value: str, n: str, first: str, share: float) -> DataFrame:
    """by and dominant: the most frequent value (of equal ones the first) where it has the share, else null."""
    total = F.sum(n).over(Window.partitionBy(*by))
    best = first_per(counts.withColumn("__total", total), by, [F.desc(n), F.col(first)])
    return best.select(*by, F.when(F.col(n) >= share * F.col("__total"), F.col(value)).alias("dominant"))
