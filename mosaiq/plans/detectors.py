"""Queries that find candidates for stories, and the ranking of what they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar, scores
from mosaiq.operators import history, ranking, sessions

COLUMNS = ("memory_type", "key", "start_date", "end_date", "n_assets", "score")


def candidates(df: DataFrame, kind: str, key: Column, start: Column, end: Column, n: Column, score: Column) -> DataFrame:
    values = (F.lit(kind), key, start, end, n, score)
    kinds = ("string", "string", "date", "date", "bigint", "double")
    return df.select(*[v.cast(k).alias(c) for c, v, k in zip(COLUMNS, values, kinds, strict=True)])


def monthly(df: DataFrame, time: str, today: str) -> DataFrame:
    """The latest completed month with rows."""
    months = df.groupBy(F.trunc(F.col(time).cast("date"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n")).where(F.add_months("m", 1) <= F.lit(today).cast("date"))
    latest = months.orderBy(F.desc("m")).limit(1)
    return candidates(latest, "monthly", F.date_format("m", "yyyy-MM"), F.col("m"), F.last_day("m"), F.col("n"), 0.6 * F.least(F.lit(1.0), F.col("n") / 100.0))


def yearly(df: DataFrame, time: str, today: str) -> DataFrame:
    """Completed years; their worth decays with the years that passed, to 0.3 of it at least."""
    years = df.groupBy(F.year(time).alias("y")).agg(F.count(F.lit(1)).alias("n")).where(F.make_date("y", F.lit(12), F.lit(31)) < F.lit(today).cast("date"))
    decay = F.greatest(F.lit(0.3), 1 - 0.1 * (F.year(F.lit(today).cast("date")) - F.col("y") - 1))
    return candidates(years, "yearly", F.col("y").cast("string"), F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)), F.col("n"), 0.7 * decay * F.least(F.lit(1.0), F.col("n") / 500.0))


def people(df: DataFrame, time: str, person: str, most: int = 5) -> DataFrame:
    """The people with most rows, by their share of the largest."""
    counts = df.groupBy(person).agg(F.count(F.lit(1)).alias("n"), F.min(time).cast("date").alias("lo"), F.max(time).cast("date").alias("hi"))
    top = counts.orderBy(F.desc("n"), person).limit(most)
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))  # over so many rows
    return candidates(top, "person", F.concat(F.lit("p"), F.col(person).cast("string")), F.col("lo"), F.col("hi"), F.col("n"), 0.5 * F.col("n") / largest)


def pairs_of_people(df: DataFrame, time: str, person: str, most: int = 10) -> DataFrame:
    """Pairs among the people with most rows, with a guess of what they share."""
    counts = df.groupBy(person).agg(F.count(F.lit(1)).alias("n"), F.min(time).cast("date").alias("lo"), F.max(time).cast("date").alias("hi")).orderBy(F.desc("n"), person).limit(most)
    a, b = counts.alias("a"), counts.alias("b")
    met = a.join(b, F.col(f"a.{person}") < F.col(f"b.{person}"))
    shared = scores.shared_estimate(F.col("a.n"), F.col("b.n"))
    key = F.concat_ws("+", F.col(f"a.{person}").cast("string"), F.col(f"b.{person}").cast("string"))
    return candidates(met, "multi_person", key, F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi"), shared, 0.55 * F.least(F.lit(1.0), shared / 500.0))


def bursts(df: DataFrame, time: str, threshold: float) -> DataFrame:
    """Months far over the months before."""
    months = df.groupBy(F.trunc(F.col(time).cast("date"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    found = ranking.trailing_burst(months, "m", "n", ["all"], threshold)
    return candidates(found, "burst", F.date_format("m", "yyyy-MM"), F.col("m"), F.last_day("m"), F.col("n"), F.lit(0.7))


def trip_candidates(df: DataFrame, time: str, lat: str, lon: str, by: str, tie: str, home: tuple[float, float], today: str, gap_days: float = 2.0) -> DataFrame:
    """Trips that ended a week ago or earlier."""
    found = sessions.trips(df, time, lat, lon, [by], tie, home, gap_days=gap_days).where(F.datediff(F.lit(today).cast("date"), "end_date") >= 7)
    return candidates(found, "trip", F.concat_ws(":", F.col(by).cast("string"), F.col("start_date").cast("string")), F.col("start_date"), F.col("end_date"), F.col("n_assets"), scores.trip_score(F.col("days"), F.col("n_assets")))


#: How many candidates of a type are suggested; others have 3.
CAPS = {"on_this_day": 1, "multi_person": 2}


def ranked(found: list[DataFrame], today: str, generated: DataFrame, last_runs: DataFrame) -> DataFrame:
    """All candidates with adjusted scores: one row a key, at most so many a type.

    generated: keys made before; last_runs: memory_type and last_run.
    """
    whole = reduce(DataFrame.unionByName, found)
    known = whole.join(generated.select("key").distinct().withColumn("__made", F.lit(True)), "key", "left").join(last_runs, "memory_type", "left")
    now = F.lit(today).cast("date")
    score = scores.candidate_score(F.col("score"), F.col("__made").isNull(), F.datediff(now, "end_date"), F.col("n_assets"), F.datediff(now, "last_run"))
    adjusted = known.withColumn("score", F.round(score, 6)).select(*COLUMNS)
    single = ranking.first_per(adjusted, ["memory_type", "key"], [F.desc("score"), F.col("start_date")])
    cap = F.lit(3)
    for kind, most in CAPS.items():
        cap = F.when(F.col("memory_type") == kind, most).otherwise(cap)
    return ranking.top_per(single, ["memory_type"], [F.desc("score"), F.col("key")], cap)


def birthdays(df: DataFrame, born: DataFrame, time: str, person: str, today: str, soon: int = 7, ago: tuple[int, int] = (2, 60)) -> DataFrame:
    """People whose birthday (born: person and birth_date) is within days to come, or was some days ago: their year up to it."""
    now = F.lit(today).cast("date")
    counts = df.groupBy(person).agg(F.count(F.lit(1)).alias("n"))
    met = born.join(counts, person)
    this_year, last_year = (calendar.anniversary(F.col("birth_date"), F.year(now) - k) for k in (0, 1))
    days = F.datediff(now, F.when(this_year <= F.date_add(now, soon), this_year).otherwise(last_year))
    at = F.date_sub(now, days)
    near = met.withColumns({"__at": at, "__days": days}).where(F.col("__days").between(-soon, 0) | F.col("__days").between(*ago))
    worth = F.when(F.col("__days") <= 0, 0.9).otherwise(0.8) * F.least(F.lit(1.0), F.col("n") / 20.0)
    return candidates(near, "birthday", F.concat(F.lit("b"), F.col(person).cast("string"), F.lit(":"), F.year("__at").cast("string")), F.date_add(F.add_months("__at", -12), 1), F.col("__at"), F.col("n"), worth)


def without_birthdays(found: DataFrame, born: DataFrame, person: str, today: str, soon: int = 7) -> DataFrame:
    """Spotlights on people, without those whose birthday comes within days: they wait for it."""
    now = F.lit(today).cast("date")
    coming = F.array(*[calendar.anniversary(F.col("birth_date"), F.year(now) + k) for k in (0, 1)])
    waiting = born.where(F.exists(coming, lambda d: F.datediff(d, now).between(0, soon))).select(F.concat(F.lit("p"), F.col(person).cast("string")).alias("key")).distinct()
    return found.join(waiting, "key", "left_anti").select(*COLUMNS)


def backed_off(found: DataFrame, runs: DataFrame, today: str) -> DataFrame:
    """Candidates whose key isn't waiting after failures in a row since its last success (runs: key, status, ran, run_id)."""
    streaks = history.failure_streaks(runs, "key", [F.col("ran"), F.col("run_id")], F.col("status") == "failed", F.col("status") == "completed", "ran")
    waits = sessions.seconds_between(F.col("last_failed_at"), F.lit(today).cast("timestamp_ntz")) / 3600 < scores.backoff_hours(F.col("failures"))
    return found.join(streaks.where(waits).select("key"), "key", "left_anti").select(*COLUMNS)


def people_in(kind: Column, key: Column) -> Column:
    """The people of a candidate or run, by its kind and key: one of a spotlight or birthday, both of a pair."""
    return F.when(kind == "multi_person", F.split(key, r"\+")).when(kind.isin("person", "birthday"), F.array(F.regexp_extract(key, r"^[pb](\d+)", 1))).otherwise(F.array().cast("array<string>"))


def varied(found: DataFrame, runs: DataFrame, today: str, last: int = 6) -> DataFrame:
    """Candidates with rule: the first rule of variety that they break beside the last completed runs, null if none.

    Not the kind of the run before; no kind for the third time in six; one monthly a month; nobody of the last two runs that had people. The six runs are read on the driver.
    """
    done = runs.where("status = 'completed'").orderBy(F.desc("ran"), F.desc("run_id")).limit(last).select("memory_type", "ran", people_in(F.col("memory_type"), F.col("key")).alias("people")).collect()
    kinds = [r["memory_type"] for r in done]
    often = sorted({k for k in kinds if kinds.count(k) >= 2})
    month = any(r["memory_type"] == "monthly" and f"{r['ran']:%Y-%m}" == today[:7] for r in done)
    recent = sorted({p for r in [r for r in done if r["people"]][:2] for p in r["people"]})
    kind = F.col("memory_type")
    known = F.array(*[F.lit(p) for p in recent]).cast("array<string>")
    rule = F.when(kind == F.lit(kinds[0] if kinds else None), "same_category_as_previous").when(kind.isin(often), "category_limit_two_of_six").when((kind == "monthly") & F.lit(month), "monthly_review_already_completed_this_month")
    return found.withColumn("rule", rule.when(F.arrays_overlap(people_in(kind, F.col("key")), known), "person_in_last_two_person_runs"))


def suggested(found: list[DataFrame], runs: DataFrame, today: str, limit: int = 10) -> DataFrame:
    """The best candidates of all detectors: none that waits after failures or breaks a rule of variety, ranked by ranked, `limit` at most.

    runs: run_id, memory_type, key, status and ran (when) of earlier runs, before today.
    """
    kept = varied(backed_off(reduce(DataFrame.unionByName, found), runs, today), runs, today).where("rule is null").drop("rule")
    done = runs.where("status = 'completed'")
    lasts = done.groupBy("memory_type").agg(F.max("ran").cast("date").alias("last_run"))
    best = ranked([kept], today, done.select("key"), lasts)
    return best.orderBy(F.desc("score"), "memory_type", "key").limit(limit)
