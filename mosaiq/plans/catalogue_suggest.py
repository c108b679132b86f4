"""Registered queries on suggestions: all detectors, what waits after failures, variety, and the ranking, over orders as a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans import detectors
from mosaiq.plans.adapters import HOME, table
from mosaiq.plans.catalogue import query

TODAY = "2001-08-01"
KINDS = ("yearly", "monthly", "person", "burst", "trip", "birthday")

#: Runs stand for every seventh order; birth dates and places follow from keys.
RUNS_SQL = f"""runs AS (SELECT * FROM (SELECT o_orderkey AS run_id, [{", ".join(f"'{k}'" for k in KINDS)}][o_orderkey % 6 + 1] AS memory_type, o_orderdate AS ran, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN 'p' || o_custkey WHEN 4 THEN o_custkey || ':' || CAST(o_orderdate AS DATE) WHEN 5 THEN 'b' || o_custkey || ':' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m') END AS key FROM orders WHERE o_orderkey % 7 = 0) WHERE ran < TIMESTAMP '{TODAY}')"""
BORN_SQL = "born AS (SELECT c_custkey AS p, DATE '1990-01-01' + CAST(c_custkey % 366 AS INTEGER) AS birth_date FROM customer)"
ANNIVERSARY = "coalesce(try_cast({y} || strftime(birth_date, '-%m-%d') AS DATE), make_date({y}, 2, 28))"
PEOPLE = "CASE WHEN memory_type = 'multi_person' THEN string_split(key, '+') WHEN memory_type IN ('person', 'birthday') THEN [regexp_extract(key, '^[pb](\\d+)', 1)] ELSE []::VARCHAR[] END"
FOUND_SQL = f"""o AS (SELECT o_orderdate AS t, o_custkey AS p, o_orderkey AS id, o_orderstatus = 'F' AS away FROM orders), {BORN_SQL}, {RUNS_SQL},
m AS (SELECT 'monthly' AS memory_type, strftime(t, '%Y-%m') AS key, date_trunc('month', t)::DATE AS start_date, last_day(t::DATE) AS end_date, count(*) AS n_assets, 0.6 * least(1.0, count(*) / 100.0) AS score FROM o WHERE date_trunc('month', t) + INTERVAL 1 MONTH <= DATE '{TODAY}' GROUP BY 1, 2, 3, 4 ORDER BY 3 DESC LIMIT 1),
y AS (SELECT 'yearly', CAST(year(t) AS VARCHAR), make_date(year(t), 1, 1), make_date(year(t), 12, 31), count(*), 0.7 * greatest(0.3, 1 - 0.1 * (2001 - year(t) - 1)) * least(1.0, count(*) / 500.0) FROM o WHERE year(t) < 2001 GROUP BY year(t)),
c AS (SELECT p, count(*) AS n, min(t)::DATE AS lo, max(t)::DATE AS hi FROM o GROUP BY 1), c5 AS (SELECT * FROM c ORDER BY n DESC, p LIMIT 5), c10 AS (SELECT * FROM c ORDER BY n DESC, p LIMIT 10),
soon AS (SELECT p FROM born WHERE date_diff('day', DATE '{TODAY}', {ANNIVERSARY.format(y=2001)}) BETWEEN 0 AND 7 OR date_diff('day', DATE '{TODAY}', {ANNIVERSARY.format(y=2002)}) BETWEEN 0 AND 7),
pe AS (SELECT 'person', 'p' || p, lo, hi, n, 0.5 * n / (SELECT max(n) FROM c5) FROM c5 WHERE p NOT IN (SELECT p FROM soon)),
mp AS (SELECT 'multi_person', a.p || '+' || b.p, greatest(a.lo, b.lo), least(a.hi, b.hi), CAST(floor(least(a.n, b.n) * 0.3) AS BIGINT), 0.55 * least(1.0, floor(least(a.n, b.n) * 0.3) / 500.0) FROM c10 a JOIN c10 b ON a.p < b.p),
mo AS (SELECT date_trunc('month', t)::DATE AS m, count(*) AS n FROM o GROUP BY 1), b AS (SELECT 'burst', strftime(m, '%Y-%m'), m, last_day(m), n, 0.7 FROM (SELECT *, avg(n) OVER (ORDER BY m ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS av FROM mo) WHERE n / av > 1.05),
tg AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY p ORDER BY t, id) IS NULL OR epoch_us(t - lag(t) OVER (PARTITION BY p ORDER BY t, id)) / 1e6 > 40 * 86400 THEN 1 ELSE 0 END AS starts FROM o WHERE away AND t >= TIMESTAMP '2000-08-01'), tn AS (SELECT *, sum(starts) OVER (PARTITION BY p ORDER BY t, id) AS trip FROM tg),
tr AS (SELECT p, trip, min(t)::DATE AS lo, max(t)::DATE AS hi, count(*) AS n FROM tn GROUP BY 1, 2), tq AS (SELECT *, date_diff('day', lo, hi) + 1 AS days FROM tr),
tc AS (SELECT 'trip', p || ':' || lo, lo, hi, n, 0.75 * least(1.0, days / 14.0) * least(1.0, n / 200.0) FROM tq WHERE days >= 2 AND date_diff('day', hi, DATE '{TODAY}') >= 7),
ba AS (SELECT p, n, CASE WHEN {ANNIVERSARY.format(y=2001)} <= DATE '{TODAY}' + 7 THEN {ANNIVERSARY.format(y=2001)} ELSE {ANNIVERSARY.format(y=2000)} END AS born_again FROM born JOIN c USING (p)), bd AS (SELECT *, date_diff('day', born_again, DATE '{TODAY}') AS ago FROM ba),
bi AS (SELECT 'birthday', 'b' || p || ':' || year(born_again), CAST(born_again - INTERVAL 12 MONTH AS DATE) + 1, born_again, n, CASE WHEN ago <= 0 THEN 0.9 ELSE 0.8 END * least(1.0, n / 20.0) FROM bd WHERE ago BETWEEN -7 AND 0 OR ago BETWEEN 2 AND 60),
w AS (SELECT * FROM m UNION ALL SELECT * FROM y UNION ALL SELECT * FROM pe UNION ALL SELECT * FROM mp UNION ALL SELECT * FROM b UNION ALL SELECT * FROM tc UNION ALL SELECT * FROM bi),
rs AS (SELECT *, max(CASE WHEN status = 'completed' THEN struct_pack(ran := ran, id := run_id) END) OVER (PARTITION BY key) AS done FROM runs), st AS (SELECT key, count(*) AS failures, max(ran) AS seen FROM rs WHERE status = 'failed' AND (done IS NULL OR struct_pack(ran := ran, id := run_id) > done) GROUP BY 1),
bo AS (SELECT * FROM w WHERE key NOT IN (SELECT key FROM st WHERE epoch_us(TIMESTAMP '{TODAY}' - seen) / 3.6e9 < CASE WHEN failures = 2 THEN 24 WHEN failures = 3 THEN 72 WHEN failures > 3 THEN 168 END)),
la AS (SELECT *, {PEOPLE} AS people, row_number() OVER (ORDER BY ran DESC, run_id DESC) AS place FROM runs WHERE status = 'completed' ORDER BY ran DESC, run_id DESC LIMIT 6),
lp AS (SELECT unnest(people) AS person FROM (SELECT people FROM la WHERE len(people) > 0 ORDER BY place LIMIT 2)),
va AS (SELECT *, CASE WHEN memory_type = (SELECT memory_type FROM la WHERE place = 1) THEN 'same_category_as_previous' WHEN memory_type IN (SELECT memory_type FROM la GROUP BY 1 HAVING count(*) >= 2) THEN 'category_limit_two_of_six'
  WHEN memory_type = 'monthly' AND EXISTS (SELECT 1 FROM la WHERE memory_type = 'monthly' AND strftime(ran, '%Y-%m') = '{TODAY[:7]}') THEN 'monthly_review_already_completed_this_month' WHEN list_has_any({PEOPLE}, (SELECT coalesce(list(person), []) FROM lp)) THEN 'person_in_last_two_person_runs' END AS rule FROM bo)"""


def library(spark, d) -> tuple[list[DataFrame], DataFrame]:
    """The candidates of all detectors, and earlier runs."""
    o, day = table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd")
    born = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int")).alias("birth_date"))
    away = F.col("o_orderstatus") == "F"
    points = o.where("o_orderdate >= timestamp_ntz'2000-08-01'").withColumns({"lat": F.when(away, 41.38).otherwise(HOME[0]), "lon": F.when(away, 2.17).otherwise(HOME[1])})
    kind = (F.col("o_orderkey") % 6).cast("int")
    person, year = F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")
    key = F.when(kind == 0, year).when(kind == 2, F.concat(F.lit("p"), person)).when(kind == 4, F.concat_ws(":", person, day)).when(kind == 5, F.concat(F.lit("b"), person, F.lit(":"), year)).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    runs = o.where(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("run_id"), F.get(F.array(*[F.lit(k) for k in KINDS]), kind).alias("memory_type"), key.alias("key"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("ran")).where(f"ran < timestamp_ntz'{TODAY}'")
    found = [
        detectors.monthly(o, "o_orderdate", TODAY), detectors.yearly(o, "o_orderdate", TODAY), detectors.without_birthdays(detectors.people(o, "o_orderdate", "o_custkey"), born, "o_custkey", TODAY), detectors.pairs_of_people(o, "o_orderdate", "o_custkey"),
        detectors.bursts(o, "o_orderdate", 1.05), detectors.trip_candidates(points, "o_orderdate", "lat", "lon", "o_custkey", "o_orderkey", HOME, TODAY, 40.0), detectors.birthdays(o, born, "o_orderdate", "o_custkey", TODAY),
    ]
    return found, runs


@query(f"""WITH {FOUND_SQL}, gk AS (SELECT DISTINCT key FROM runs WHERE status = 'completed'), lr AS (SELECT memory_type, date_diff('day', max(ran)::DATE, DATE '{TODAY}') AS since FROM runs WHERE status = 'completed' GROUP BY 1),
f AS (SELECT v.*, score * CASE WHEN key IN (SELECT key FROM gk) THEN 1.0 ELSE 1.2 END * greatest(0.5, 1 - date_diff('day', end_date, DATE '{TODAY}') / 365.0) AS fresh, least(1.0, ln(greatest(1, n_assets)) / ln(1000.0)) AS rich, CASE WHEN since <= 7 THEN 0.3 WHEN since <= 30 THEN 0.7 ELSE 1.0 END AS cool FROM va v LEFT JOIN lr USING (memory_type) WHERE rule IS NULL),
x AS (SELECT memory_type, key, start_date, end_date, n_assets, round(CAST(greatest(0, least(1, (fresh * 0.7 + fresh * 0.3 * rich) * cool)) AS DOUBLE), 6) AS score FROM f),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY memory_type ORDER BY score DESC, key) <= CASE WHEN memory_type = 'multi_person' THEN 2 WHEN memory_type = 'on_this_day' THEN 1 ELSE 3 END) SELECT * FROM k ORDER BY score DESC, memory_type, key LIMIT 10""")
def suggest(spark, d):
    """The ten best stories to tell: trips, birthdays, months, years, people and pairs, without what waits or repeats."""
    found, runs = library(spark, d)
    return detectors.suggested(found, runs, TODAY)


@query(f"WITH {FOUND_SQL} SELECT memory_type, key, rule FROM va")
def variety_rules(spark, d):
    """Which rule of variety each candidate breaks beside the last six completed runs."""
    found, runs = library(spark, d)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return detectors.varied(detectors.backed_off(whole, runs, TODAY), runs, TODAY).select("memory_type", "key", "rule")
