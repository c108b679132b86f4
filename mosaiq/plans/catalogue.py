"""The registered queries: an operator each over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar, geo, hashing, scores, text
from mosaiq.operators import history, intervals, ranking, sessions, similarity
from mosaiq.plans import fold_sql
from mosaiq.plans.adapters import ASSETS_SQL, HASHES_SQL, HOME, MONTHS_SQL, assets, hashes, monthly_orders, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is some."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- moments and sessions


@query(f"""WITH {ASSETS_SQL}, s AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS moment
  FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM a))
SELECT owner, CAST(moment AS INTEGER) AS moment, asset_id, favorite, score FROM s
QUALIFY row_number() OVER (PARTITION BY owner, moment ORDER BY favorite DESC, score DESC, asset_id) = 1""")
def moments_best_per_session(spark, d):
    best = sessions.best_per_moment(assets(spark, d), "taken_at", 1800, ["owner"], "favorite", "score", "asset_id")
    return best.select("owner", "moment", "asset_id", "favorite", "score")


@query(f"""WITH {ASSETS_SQL}, s AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS series
  FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM a)),
c AS (SELECT *, (row_number() OVER (PARTITION BY owner, series ORDER BY taken_at, asset_id) - 1) // 4 AS chunk FROM s)
SELECT asset_id, CAST(series AS INTEGER) AS series, CAST(chunk AS INTEGER) AS chunk,
  CASE WHEN count(*) OVER (PARTITION BY owner, series, chunk) >= 2 THEN 'collage' ELSE 'single' END AS mode FROM c""")
def series_chunks_of_four(spark, d):
    return sessions.chunked_series(assets(spark, d), "taken_at", 3600, ["owner"], "asset_id").select("asset_id", "series", "chunk", "mode")


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT *, duration * 600 AS len FROM a),
g AS (SELECT *, lag(len) OVER w - epoch_us(taken_at - lag(taken_at) OVER w) / 1e6 AS before, len - epoch_us(lead(taken_at) OVER w - taken_at) / 1e6 AS after
  FROM b WINDOW w AS (PARTITION BY owner ORDER BY taken_at, asset_id))
SELECT asset_id, round(CAST(coalesce(greatest(0, before) / 2, 0) AS DOUBLE), 4) AS trim_start, round(CAST(len - coalesce(greatest(0, after) / 2, 0) AS DOUBLE), 4) AS trim_end FROM g""")
def burst_trim_points(spark, d):
    trimmed = sessions.trim_points(assets(spark, d).withColumn("len", F.col("duration") * 600), "taken_at", "len", ["owner"], "asset_id")
    return trimmed.select("asset_id", F.round("trim_start", 4).alias("trim_start"), F.round("trim_end", 4).alias("trim_end"))


@query(f"""WITH {ASSETS_SQL}, k AS (SELECT *, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({HOME[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - lon) / 2), 2)))) AS km FROM a),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS trip
  FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM k WHERE km >= 50))
SELECT owner, CAST(trip AS INTEGER) AS trip, CAST(min(taken_at) AS DATE) AS start_date, CAST(max(taken_at) AS DATE) AS end_date, count(*) AS n_assets,
  round(avg(nullif(lat, 0)) + 1e-8, 4) AS lat, round(avg(nullif(lon, 0)) + 1e-8, 4) AS lon, CAST(date_diff('day', min(taken_at)::DATE, max(taken_at)::DATE) + 1 AS INTEGER) AS days
FROM s GROUP BY owner, trip HAVING date_diff('day', min(taken_at)::DATE, max(taken_at)::DATE) + 1 >= 2""")
def trips(spark, d):
    found = sessions.trips(assets(spark, d), "taken_at", "lat", "lon", ["owner"], "asset_id", HOME)
    return found.withColumn("lat", F.round(F.col("lat") + 1e-8, 4)).withColumn("lon", F.round(F.col("lon") + 1e-8, 4))


@query(f"""WITH {ASSETS_SQL} SELECT x.asset_id, x.owner FROM a x WHERE x.tagged OR EXISTS (
  SELECT 1 FROM a y WHERE y.owner = x.owner AND y.tagged AND abs(epoch_us(y.taken_at) - epoch_us(x.taken_at)) <= 3600000000)""")
def neighbor_expansion(spark, d):
    return sessions.neighbours(assets(spark, d), F.col("tagged"), "taken_at", 3600, ["owner"]).select("asset_id", "owner")


@query(f"""WITH {ASSETS_SQL}, p AS (SELECT * FROM a WHERE kind = 'view'), m AS (SELECT * FROM a WHERE kind = 'click')
SELECT asset_id, owner FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner = p.owner AND abs(epoch_us(m.taken_at) - epoch_us(p.taken_at)) <= 7200000000)""")
def photo_motion_suppression(spark, d):
    a = assets(spark, d)
    photos, motion = a.where("kind = 'view'"), a.where("kind = 'click'")
    both = sessions.neighbours(photos.unionByName(motion), F.col("kind") == "click", "taken_at", 7200, ["owner"]).where("kind = 'view'")
    return photos.join(both.select("asset_id"), "asset_id", "left_anti").select("asset_id", "owner")


@query(fold_sql.BURSTS)
def burst_dedup(spark, d):
    a = assets(spark, d).withColumn("bits", F.when(F.col("asset_id") % 11 > 0, F.conv(F.substring(F.md5(F.floor(F.col("asset_id") / 5).cast("string")), 1, 15), 16, 10).cast("long")))
    return sessions.bursts(a, "taken_at", "bits", "score", ["owner"], "asset_id", 1800, 30)


@query(f"""WITH {ASSETS_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY owner, date_trunc('hour', taken_at), CAST(duration AS INTEGER)) AS n,
  row_number() OVER (PARTITION BY owner, date_trunc('hour', taken_at), CAST(duration AS INTEGER) ORDER BY width * height DESC, bitrate DESC, asset_id) AS place FROM a)
SELECT asset_id, place > 1 AS lower_quality FROM g WHERE n > 1""")
def exact_duplicates(spark, d):
    key = [F.col("owner"), F.date_trunc("hour", "taken_at"), F.col("duration").cast("int")]
    w = Window.partitionBy(*key)
    marked = assets(spark, d).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(F.col("width") * F.col("height")), F.desc("bitrate"), "asset_id")))
    return marked.where("n > 1").select("asset_id", (F.col("place") > 1).alias("lower_quality"))


# --- ranks, quotas and budgets


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT *, strftime(taken_at, '%G-W%V') AS week FROM a), q AS (
  SELECT *, count(*) OVER (PARTITION BY owner, week) * 120.0 / count(*) OVER (PARTITION BY owner) AS quota FROM b),
r AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY owner, week ORDER BY favorite DESC, score DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT asset_id, week, round(quota, 6) AS quota FROM r WHERE before < quota""")
def density_bucket_quota(spark, d):
    a = assets(spark, d).withColumn("week", calendar.iso_week(F.col("taken_at")))
    n = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by))
    quota = a.withColumn("quota", n("owner", "week") * 120.0 / n("owner"))
    kept = ranking.fill_until_crossed(quota, "duration", F.col("quota"), ["owner", "week"], [F.desc("favorite"), F.desc("score"), F.col("asset_id")])
    return kept.select("asset_id", "week", F.round("quota", 6).alias("quota"))


@query(f"""WITH {ASSETS_SQL}, z AS (SELECT owner, CAST(taken_at AS DATE) AS day, count(*) AS n, avg(CASE WHEN tagged THEN 1.0 ELSE 0.0 END) AS share FROM a GROUP BY 1, 2),
m AS (SELECT owner, list_sort(list(n)) AS ns FROM z GROUP BY 1)
SELECT z.owner, day, n FROM z JOIN m USING (owner) WHERE n >= 1.5 * ns[len(ns) // 2 + 1] AND share >= 0.1
QUALIFY row_number() OVER (PARTITION BY z.owner ORDER BY n DESC, day) <= 2""")
def event_days(spark, d):
    a = assets(spark, d).withColumn("day", F.to_date("taken_at"))
    return ranking.event_periods(a, "day", ["owner"], F.col("tagged"), 1.5).select("owner", "day", "n")


@query(f"""WITH {ASSETS_SQL}, z AS (SELECT *, CAST(taken_at AS DATE) AS day FROM a), n AS (SELECT day, count(*) AS c FROM z GROUP BY 1), t AS (SELECT avg(c) AS mean FROM n)
SELECT asset_id, z.day FROM z JOIN n USING (day), t
QUALIFY row_number() OVER (PARTITION BY z.day ORDER BY score DESC, asset_id) <= CASE WHEN c > 1.02 * mean THEN 12 ELSE 4 END""")
def top_per_day_with_event_cap(spark, d):
    a = assets(spark, d).withColumn("day", F.to_date("taken_at"))
    counts = a.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    mean = F.avg("c").over(Window.partitionBy(F.lit(0)))  # over as many rows as there are days
    caps = counts.select("day", F.when(F.col("c") > 1.02 * mean, 12).otherwise(4).alias("cap"))
    return ranking.top_per(a.join(caps, "day"), ["day"], [F.desc("score"), F.col("asset_id")], F.col("cap")).select("asset_id", "day")


@query(f"""WITH {ASSETS_SQL}, c AS (SELECT *, kind = 'view' AS capped, count(*) FILTER (WHERE kind <> 'view') OVER (PARTITION BY owner) AS others FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY owner, capped ORDER BY favorite DESC, score DESC, asset_id) AS place FROM c)
SELECT asset_id FROM p WHERE NOT capped OR place <= floor(others * 0.1 / 0.9)""")
def ratio_cap(spark, d):
    return ranking.ratio_cap(assets(spark, d), F.col("kind") == "view", 0.1, ["owner"], [F.desc("favorite"), F.desc("score"), F.col("asset_id")]).select("asset_id")


@query(f"""WITH {ASSETS_SQL}, w AS (SELECT *, date_trunc('day', taken_at)::DATE AS day FROM a), f AS (SELECT owner, min(day) AS lo, max(day) AS hi FROM w WHERE favorite GROUP BY 1),
covered AS (SELECT DISTINCT owner, day FROM w WHERE favorite)
SELECT w.asset_id, w.day FROM w JOIN f USING (owner) LEFT JOIN covered c ON c.owner = w.owner AND c.day = w.day
WHERE w.day BETWEEN lo AND hi AND c.day IS NULL QUALIFY row_number() OVER (PARTITION BY w.owner, w.day ORDER BY score DESC, asset_id) <= 2""")
def gap_period_fill(spark, d):
    a = assets(spark, d).withColumn("day", F.to_date("taken_at"))
    fav = a.where("favorite")
    span = fav.groupBy("owner").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    open_days = a.join(span, "owner").where("day between lo and hi").join(fav.select("owner", "day").distinct(), ["owner", "day"], "left_anti")
    return ranking.top_per(open_days, ["owner", "day"], [F.desc("score"), F.col("asset_id")], 2).select("asset_id", "day")


@query(f"""WITH {MONTHS_SQL}, w AS (SELECT *, avg(n) OVER (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS average FROM m)
SELECT month, n, round(average, 4) AS average, round(n / average, 4) AS ratio FROM w WHERE n / average > 1.05""")
def activity_bursts(spark, d):
    months = monthly_orders(spark, d).withColumn("all", F.lit(1))
    found = ranking.trailing_burst(months, "month", "n", ["all"], 1.05)
    return found.select("month", "n", F.round("average", 4).alias("average"), F.round("ratio", 4).alias("ratio"))


@query("""WITH r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, count(*) OVER (PARTITION BY p_brand, p_size) AS ties, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, round(CASE WHEN n > 1 THEN (rk - 1 + (ties - 1) / 2) / (n - 1) ELSE 1.0 END, 6) AS "rank" FROM r""")
def frame_quality_rank(spark, d):
    return ranking.midpoint_rank(table(spark, d, "part"), "p_size", ["p_brand"]).select("p_partkey", F.round("rank", 6).alias("rank"))


@query("""WITH r AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT doc_id, source FROM r WHERE total - freed > 50000""")
def lru_eviction(spark, d):
    return ranking.evict_to_budget(table(spark, d, "documents"), "n_chars", 50000, [F.col("lang"), F.col("doc_id")], ["source"]).select("doc_id", "source")


@query(f"""WITH {ASSETS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) - 1 AS place, count(*) OVER (PARTITION BY owner) AS n FROM a)
SELECT asset_id, owner FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), place)""")
def even_sample(spark, d):
    return ranking.even_sample(assets(spark, d), 5, ["owner"], [F.col("taken_at"), F.col("asset_id")]).select("asset_id", "owner")


@query(fold_sql.GREEDY_FIT.format(assets=ASSETS_SQL, source="a", order="favorite DESC, score DESC, asset_id", budget=60))
def budget_fit_skip(spark, d):
    return ranking.greedy_fit(assets(spark, d), "duration", 60.0, ["owner"], [F.desc("favorite"), F.desc("score"), F.col("asset_id")], "asset_id")


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT *, score / 100.0 AS s FROM a), w AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY taken_at DESC, asset_id) AS back, count(*) OVER p AS n, min(s) OVER p AS lo, avg(s) OVER p AS mean FROM b WINDOW p AS (PARTITION BY owner))
SELECT asset_id, owner FROM w WHERE NOT favorite AND (s < 0.3 OR (n > 2 AND back = 1 AND s = lo AND s < 0.6 * mean))""")
def judge_sweep(spark, d):
    a = assets(spark, d).withColumn("s", F.col("score") / 100.0)
    return ranking.judged_out(a, "s", "favorite", "taken_at", ["owner"], "asset_id").select("asset_id", "owner")


@query("""WITH q AS (SELECT source, quantile_cont(n_chars, 0.5) FILTER (WHERE lang = 'en') AS good, quantile_cont(n_chars, 0.5) AS whole, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT d.*, coalesce(good, whole) AS bar, greatest(1, round_even(0.1 * n, 0)) AS most, row_number() OVER (PARTITION BY d.source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents d JOIN q USING (source))
SELECT doc_id, lang FROM r WHERE lang = 'en' OR (lang = 'de' AND n_chars >= bar) OR (lang = 'fr' AND place <= most) OR (lang = 'es' AND n_chars >= bar AND place <= most)""")
def subject_quota(spark, d):
    docs = table(spark, d, "documents")
    bars = docs.groupBy("source").agg(F.coalesce(F.percentile(F.when(F.col("lang") == "en", F.col("n_chars")), 0.5), F.percentile("n_chars", 0.5)).alias("bar"), F.count(F.lit(1)).alias("n"))
    ranked = docs.join(bars, "source").withColumn("place", F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")))
    most, high = F.col("place") <= scores.quota_for(0.1, F.col("n")), F.col("n_chars") >= F.col("bar")
    lang = F.col("lang")
    return ranked.where((lang == "en") | ((lang == "de") & high) | ((lang == "fr") & most) | ((lang == "es") & high & most)).select("doc_id", "lang")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS kind, count(*) AS n, max(o_orderdate)::DATE AS last, sum(o_totalprice) / 1e7 AS base FROM orders GROUP BY 1, 2),
s AS (SELECT *, least(1.0, base) AS b, CAST(date_diff('day', last, DATE '2001-08-01') AS DOUBLE) AS ago FROM o),
f AS (SELECT *, b * CASE WHEN o_custkey % 2 = 0 THEN 1.2 ELSE 1.0 END * greatest(0.5, 1 - ago / 365.0) AS fresh, least(1.0, ln(greatest(1, n)) / ln(1000.0)) AS rich FROM s),
x AS (SELECT o_custkey, kind, greatest(0.0, least(1.0, (fresh * 0.7 + fresh * 0.3 * rich) * CASE WHEN ago <= 7 THEN 0.3 WHEN ago <= 30 THEN 0.7 ELSE 1.0 END)) AS score FROM f)
SELECT o_custkey, kind, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(score, 6) DESC, o_custkey) <= 3""")
def candidate_rank(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last"), (F.sum("o_totalprice") / 1e7).alias("base"))
    ago = F.datediff(F.lit("2001-08-01").cast("date"), F.col("last")).cast("double")
    score = scores.candidate_score(F.least(F.lit(1.0), F.col("base")), F.col("o_custkey") % 2 == 0, ago, F.col("n"), ago)
    return ranking.top_per(o.select("o_custkey", "kind", F.round(score, 6).alias("score")), ["kind"], [F.desc("score"), F.col("o_custkey")], 3)


# --- history and caches


@query("""SELECT o_orderpriority AS kind, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_run_per_type(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderpriority", "kind")
    return history.latest_per(done, ["kind"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("kind", "o_orderkey", "o_orderdate")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS seconds, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean FROM orders""")
def run_aggregate_stats(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"),
        F.round(F.coalesce(F.sum(F.when(done, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("seconds"), F.round(F.avg(F.when(done, F.col("o_totalprice"))), 4).alias("mean"),
    )


@query("""SELECT round(avg(q), 4) AS seconds FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)""")
def avg_run_seconds(spark, d):
    runs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(runs, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).agg(F.round(F.avg("q"), 4).alias("seconds"))


@query("""SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c.c_custkey = o.o_custkey WHERE o.o_custkey IS NULL OR p IS DISTINCT FROM '5-LOW'""")
def uncached_assets(spark, d):
    cache = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("sum"))
    return history.uncached(table(spark, d, "customer").withColumn("sum", F.lit("5-LOW")), cache, "c_custkey", "sum").select("c_custkey")


@query("""WITH c AS (SELECT o_custkey, max(o_orderdate) AS seen, count(*) % 4 AS version FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN seen IS NULL THEN 'missing' WHEN version <> 1 THEN 'version' ELSE 'age' END AS reason FROM customer LEFT JOIN c ON c_custkey = o_custkey WHERE seen IS NULL OR version <> 1 OR seen < TIMESTAMP '2001-01-01'""")
def stale_assets(spark, d):
    cache = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), (F.count(F.lit(1)) % 4).alias("version"))
    joined = table(spark, d, "customer").join(cache, F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = F.when(F.col("at").isNull(), "missing").when(F.col("version") != 1, "version").when(F.col("at") < F.lit("2001-01-01").cast("timestamp"), "age")
    return joined.select("c_custkey", reason.alias("reason")).where("reason is not null")


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, max(CASE WHEN kind = 'purchase' THEN asset_id END) OVER (PARTITION BY owner) AS done FROM a)
SELECT owner, count(*) AS failures, max(taken_at) AS last_failed_at FROM s WHERE kind = 'error' AND (done IS NULL OR asset_id > done) GROUP BY 1""")
def failure_streaks(spark, d):
    return history.failure_streaks(assets(spark, d), "owner", [F.col("asset_id")], F.col("kind") == "error", F.col("kind") == "purchase", "taken_at")


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, max(CASE WHEN kind = 'purchase' THEN asset_id END) OVER (PARTITION BY owner) AS done FROM a),
f AS (SELECT owner, count(*) AS failures, max(taken_at) AS seen FROM s WHERE kind = 'error' AND (done IS NULL OR asset_id > done) GROUP BY 1)
SELECT owner, failures FROM f WHERE epoch_us(TIMESTAMP '2024-01-30' - seen) / 3.6e9 < CASE WHEN failures = 2 THEN 24 WHEN failures = 3 THEN 72 WHEN failures > 3 THEN 168 END""")
def backoff_suppressed(spark, d):
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    waits = sessions.seconds_between(F.col("last_failed_at"), now) / 3600 < scores.backoff_hours(F.col("failures"))
    return failure_streaks(spark, d).where(waits).select("owner", "failures")


@query(f"""WITH {ASSETS_SQL} SELECT owner, kind, asset_id, score FROM a QUALIFY row_number() OVER (PARTITION BY owner, kind ORDER BY CASE WHEN taken_at >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END DESC, asset_id DESC) = 1""")
def upsert_latest_snapshot(spark, d):
    a, late = assets(spark, d), F.col("taken_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
    old, new = (a.where(c).select("owner", "kind", "asset_id", "score") for c in (~late, late))
    return history.upserted(old, new, ["owner", "kind"], [F.desc("asset_id")])


@query("""SELECT n_nationkey, coalesce(s.name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey""")
def merge_partial(spark, d):
    news = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("n_name"))
    return history.merged(table(spark, d, "nation"), news, ["n_nationkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus = 'O' END AS applied FROM orders""")
def guarded_transition(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return history.transitioned(o, "o_orderkey", o.where("o_orderpriority = '5-LOW'"), "o_orderstatus", "O", "F").select("o_orderkey", "o_orderstatus", "applied")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, d):
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    _, left = history.without_parents(o, items, "o_orderkey", o.where("o_orderstatus = 'P'").select("o_orderkey"))
    return left.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def run_listing_page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_custkey")


# --- sets and scans


@query(f"""WITH {ASSETS_SQL} SELECT asset_id, owner FROM a WHERE owner IN (1, 3, 5)""")
def people_union(spark, d):
    a = assets(spark, d)
    parts = [a.where(F.col("owner") == p) for p in (1, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["asset_id"]).select("asset_id", "owner")


@query(f"""WITH {ASSETS_SQL} SELECT CAST(taken_at AS DATE) AS day FROM a WHERE owner IN (1, 3) GROUP BY 1 HAVING count(DISTINCT owner) = 2""")
def people_intersection(spark, d):
    return assets(spark, d).where(F.col("owner").isin(1, 3)).groupBy(F.to_date("taken_at").alias("day")).agg(F.countDistinct("owner").alias("n")).where("n = 2").select("day")


@query(f"""WITH {ASSETS_SQL} SELECT strftime(taken_at, '%Y-%m-%d') AS bucket, kind, count(*) AS n FROM a GROUP BY 1, 2""")
def timeline_buckets(spark, d):
    return assets(spark, d).groupBy(F.date_format("taken_at", "yyyy-MM-dd").alias("bucket"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def available_years(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query(f"""WITH {ASSETS_SQL} SELECT asset_id FROM a WHERE kind = 'view' AND taken_at >= TIMESTAMP '2024-01-05' AND taken_at < TIMESTAMP '2024-01-11' AND owner = 7""")
def metadata_search(spark, d):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-10"))
    return assets(spark, d).where((F.col("kind") == "view") & (F.col("owner") == 7) & F.col("taken_at").between(lo, calendar.day_end(hi).cast("timestamp_ntz"))).select("asset_id")


@query(f"""WITH {ASSETS_SQL} SELECT CASE WHEN kind IN ('view', 'click') THEN 'video' WHEN tagged THEN 'live' ELSE 'still' END AS pool, count(*) AS n FROM a GROUP BY 1""")
def pool_split(spark, d):
    pool = F.when(F.col("kind").isin("view", "click"), "video").when(F.col("tagged"), "live").otherwise("still")
    return assets(spark, d).groupBy(pool.alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ASSETS_SQL} SELECT round(lat, 2) AS lat, round(lon, 2) AS lon, min(taken_at) AS first_at FROM a GROUP BY 1, 2""")
def distinct_places(spark, d):
    return assets(spark, d).groupBy(F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon")).agg(F.min("taken_at").alias("first_at"))


# --- similarity


@query(f"""WITH {HASHES_SQL} SELECT a.vec_id AS id1, b.vec_id AS id2, CAST(bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) <= 18""")
def hash_pairs(spark, d):
    return similarity.similar_pairs(hashes(spark, d), "vec_id", "bits", 18)


@query(f"""WITH {HASHES_SQL}, c AS (SELECT vec_id, bits, i, (bits >> (16 * i)) & 65535 AS chunk FROM h, (SELECT unnest(range(4))::INTEGER AS i))
SELECT DISTINCT a.vec_id AS id1, b.vec_id AS id2, CAST(bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) AS INTEGER) AS distance FROM c a JOIN c b ON a.i = b.i AND a.chunk = b.chunk AND a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) <= 26""")
def hash_chunk_candidates(spark, d):
    chunks = F.array(*[F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(65535)) for k in range(4)])
    return similarity.chunk_candidates(hashes(spark, d), "vec_id", chunks, 26, "bits")


@query(f"""WITH RECURSIVE {HASHES_SQL}, e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM h a JOIN h b ON a.vec_id <> b.vec_id AND bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) <= 18),
r(node, seen) AS (SELECT vec_id, vec_id FROM h UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
SELECT node AS vec_id, min(seen) AS component FROM r GROUP BY 1""")
def duplicate_components(spark, d):
    h = hashes(spark, d)
    return similarity.similar_groups(h, "vec_id", "bits", 18)


# --- intervals


@query(f"""WITH {ASSETS_SQL}, i AS (SELECT owner, epoch_us(taken_at) / 1e6 AS s, epoch_us(taken_at) / 1e6 + score * 60 AS e FROM a),
r AS (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY s, e) AS island FROM r)
SELECT owner, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM g GROUP BY owner, island""")
def interval_merge(spark, d):
    return intervals.merged(_spans(spark, d), "s", "e", ["owner"]).select("owner", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _spans(spark, d):
    at = F.unix_micros(F.col("taken_at").cast("timestamp")) / 1e6
    return assets(spark, d).select("owner", "asset_id", "kind", at.alias("s"), (at + F.col("score") * 60).alias("e"))


@query(SQL["interval_merge"].replace('SELECT owner, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM g GROUP BY owner, island', """, u AS (SELECT owner, min(s) AS s, max(e) AS e FROM g GROUP BY owner, island)
SELECT owner, round(e, 3) AS "start", round(nxt, 3) AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY owner ORDER BY s) AS nxt FROM u) WHERE nxt IS NOT NULL"""))
def interval_gaps(spark, d):
    return intervals.gaps(_spans(spark, d), "s", "e", ["owner"]).select("owner", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(SQL["interval_merge"].replace('SELECT owner, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM g GROUP BY owner, island', "SELECT owner, round(sum(e - s), 2) AS covered FROM (SELECT owner, min(s) AS s, max(e) AS e FROM g GROUP BY owner, island) GROUP BY 1"))
def union_length(spark, d):
    return intervals.union_length(_spans(spark, d), "s", "e", ["owner"]).select("owner", F.round("covered", 2).alias("covered"))


@query(f"""WITH {ASSETS_SQL}, i AS (SELECT owner, asset_id, kind, epoch_us(taken_at) / 1e6 AS s, epoch_us(taken_at) / 1e6 + score * 60 AS e FROM a)
SELECT x.asset_id, y.asset_id AS other_id, round(least(x.e, y.e) - greatest(x.s, y.s), 3) AS overlap FROM i x JOIN i y ON x.owner = y.owner AND y.e > x.s AND y.s < x.e WHERE x.kind = 'view' AND y.kind = 'click'""")
def overlap_seconds(spark, d):
    i = _spans(spark, d)
    left = i.where("kind = 'view'").select("owner", "asset_id", F.col("s").alias("start"), F.col("e").alias("end"))
    right = i.where("kind = 'click'").select("owner", F.col("asset_id").alias("other_id"), F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    return intervals.overlaps(left, right, ["owner"], 60000.0).select("asset_id", "other_id", F.round("overlap", 3).alias("overlap"))


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT owner, asset_id, score < 40 AS quiet FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY asset_id) - row_number() OVER (PARTITION BY owner, quiet ORDER BY asset_id) AS grp FROM b)
SELECT owner, CAST(min(asset_id) AS DOUBLE) AS "start", CAST(max(asset_id) + 1 AS DOUBLE) AS "end" FROM g WHERE quiet GROUP BY owner, grp HAVING max(asset_id) + 1 - min(asset_id) >= 50""")
def silence_islands(spark, d):
    a = assets(spark, d).withColumn("at", F.col("asset_id").cast("double"))
    return intervals.runs_where(a, F.col("score") < 40, "at", 1.0, ["owner"], 50.0)


@query("""SELECT p_partkey, CAST(s AS DOUBLE) AS "start", CAST(least(s + 5, p_size) AS DOUBLE) AS "end" FROM (SELECT p_partkey, p_size, unnest(range(0, 60, 4)) AS s FROM part) WHERE least(s + 5, p_size) - s >= 2.5""")
def sliding_segments(spark, d):
    cut = intervals.sliding_segments(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("len")), "len", 5.0, 1.0)
    return cut.select("p_partkey", F.col("start").cast("double").alias("start"), "end")


# --- scores, text and calendar


@query(f"""WITH {ASSETS_SQL} SELECT asset_id, round(0.4 * least(1.0, width * height / 8294400.0) + 0.4 * CASE WHEN bitrate > 0 THEN least(1.0, bitrate / 5e7) ELSE 0.5 END + 0.2 * least(1.0, duration / 60.0), 6) AS quality,
  round(exp(-pow(duration - 5, 2) / 18.0), 6) AS preference, round(greatest(30.0, least(600.0, (-20 * pow(greatest(1, asset_id % 400) / 30.0, 2) + 800 * (greatest(1, asset_id % 400) / 30.0) - 120) / 11)), 4) AS seconds FROM a""")
def clip_scores(spark, d):
    c = F.col
    return assets(spark, d).select("asset_id", F.round(scores.clip_quality(c("width"), c("height"), c("bitrate"), c("duration")), 6).alias("quality"), F.round(scores.duration_preference(c("duration"), F.lit(5.0)), 6).alias("preference"), F.round(scores.range_duration(c("asset_id") % 400), 4).alias("seconds"))


@query(f"""WITH {ASSETS_SQL} SELECT asset_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({HOME[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - lon) / 2), 2)))), 4) AS km,
  round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2, 8) AS y FROM a""")
def distance_from_home(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return assets(spark, d).select("asset_id", F.round(geo.haversine_km(lat, lon, F.lit(HOME[0]), F.lit(HOME[1])), 4).alias("km"), F.round(geo.mercator_y(lat), 8).alias("y"))


@query("""SELECT event_id, CAST(greatest(0, least(50, CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS DOUBLE) AS k FROM events""")
def tolerant_json(spark, d):
    noisy = F.concat(F.lit("<think>{x}</think>```json\n"), F.regexp_replace("props", r"\}$", ""), F.lit("\n"))
    return table(spark, d, "events").select("event_id", text.json_number(noisy, "k", 0.0, 50.0).alias("k"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-W%W') AS monday_week, strftime(o_orderdate, '%G-W%V') AS iso_week, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) < 6 THEN 'spring' WHEN month(o_orderdate) < 9 THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def calendar_keys(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", calendar.monday_week(at).alias("monday_week"), calendar.iso_week(at).alias("iso_week"), calendar.month_key(at).alias("month"), calendar.season(at).alias("season"))


@query("""SELECT y AS year, CAST(e AS DATE) AS easter FROM (VALUES (1995, '1995-04-16'), (1996, '1996-04-07'), (1997, '1997-03-30'), (1998, '1998-04-12'), (1999, '1999-04-04'), (2000, '2000-04-23'), (2001, '2001-04-15')) t(y, e) WHERE y IN (SELECT year(o_orderdate) FROM orders)""")
def easter_dates(spark, d):
    return available_years(spark, d).select("year", calendar.easter(F.col("year")).alias("easter"))


@query("""SELECT DISTINCT y AS year, make_date(y, 11, 1) + CAST((3 - (isodow(make_date(y, 11, 1)) - 1) + 7) % 7 + 21 AS INTEGER) AS thanksgiving FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)""")
def nth_weekdays(spark, d):
    return available_years(spark, d).select("year", calendar.nth_weekday(F.col("year"), 11, 3, 4).alias("thanksgiving"))


@query("""WITH w AS (SELECT y, make_date(y, 12, 25) AS day FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders))
SELECT o_orderkey, y AS holiday_year FROM orders JOIN w ON o_orderdate::DATE BETWEEN day - 2 AND day + 2""")
def holiday_windows(spark, d):
    o = table(spark, d, "orders")
    windows = available_years(spark, d).select(F.col("year").alias("holiday_year"), F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.date_add(F.make_date("year", F.lit(12), F.lit(25)), k))).alias("day"))
    return o.join(windows, F.col("o_orderdate").cast("date") == F.col("day")).select("o_orderkey", "holiday_year")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN DATE '2001-02-28' ELSE make_date(2001, CAST(month(o_orderdate) AS INTEGER), CAST(day(o_orderdate) AS INTEGER)) END AS day FROM orders""")
def birthday_years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", calendar.anniversary(F.col("o_orderdate"), F.lit(2001)).alias("day"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 6 MONTH WHEN 1 THEN INTERVAL 14 DAY ELSE INTERVAL 1 YEAR END - INTERVAL 1 DAY AS until FROM orders""".replace("CAST(o_orderdate AS DATE) + CASE", "CAST(CAST(o_orderdate AS DATE) + CASE").replace("- INTERVAL 1 DAY AS until", "- INTERVAL 1 DAY AS DATE) AS until"))
def period_ends(spark, d):
    period = F.get(F.array(F.lit("6m"), F.lit(" 2W "), F.lit("1y")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", calendar.end_of_period(F.col("o_orderdate").cast("date"), period).alias("until"))


@query("""SELECT a.c_custkey AS id1, b.c_custkey AS id2, CASE WHEN length(a.h) <> length(b.h) THEN 64 ELSE CAST(bit_count(xor(CAST('0x' || a.h AS UBIGINT), CAST('0x' || b.h AS UBIGINT))::UBIGINT::BIT) AS INTEGER) END AS distance
FROM (SELECT c_custkey, left(md5(c_name), 15 + CAST(c_custkey % 2 AS INTEGER)) AS h FROM customer) a JOIN (SELECT c_custkey, left(md5(c_name), 15 + CAST(c_custkey % 2 AS INTEGER)) AS h FROM customer) b ON b.c_custkey = a.c_custkey + 1 + a.c_custkey % 2""")
def hamming_of_hex(spark, d):
    h = table(spark, d, "customer").select("c_custkey", F.md5("c_name").substr(F.lit(1), (15 + F.col("c_custkey") % 2).cast("int")).alias("h"))
    other = h.select(F.col("c_custkey").alias("id2"), F.col("h").alias("h2"))
    return h.join(other, F.col("id2") == F.col("c_custkey") + 1 + F.col("c_custkey") % 2).select(F.col("c_custkey").alias("id1"), "id2", hashing.hamming_hex(F.col("h"), F.col("h2")).alias("distance"))
