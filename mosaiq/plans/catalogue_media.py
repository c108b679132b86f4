"""Registered queries on properties of clips, boundaries, coverage of joins, and state transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar, geo, media, scores
from mosaiq.operators import history, intervals, ranking
from mosaiq.plans.adapters import ASSETS_SQL, HOME, assets, table
from mosaiq.plans.catalogue import query


@query(f"""WITH {ASSETS_SQL}, p AS (SELECT *, ['smpte2084', 'arib-std-b67', 'bt709', NULL][1 + asset_id % 4] AS tr, [0, 90, 180, 270][1 + asset_id % 4] AS rot, CASE WHEN asset_id % 3 > 0 THEN 'Apple' ELSE '' END AS make FROM a)
SELECT asset_id, coalesce(tr IN ('smpte2084', 'arib-std-b67', 'smpte428'), false) AS hdr, CASE tr WHEN 'smpte2084' THEN 'HDR10' WHEN 'arib-std-b67' THEN 'HLG' ELSE 'SDR' END AS format,
  CAST(CASE WHEN rot IN (90, 270) THEN height ELSE width END AS BIGINT) AS seen_width, round(width / height, 4) AS ratio, make <> '' AS camera, least(width, height) >= 1080 OR make <> '' AS usable,
  favorite OR (make <> '' AND greatest(width, height) >= 1080) AS gate, CASE WHEN width >= 3840 OR height >= 2160 THEN '4K' WHEN width >= 1920 OR height >= 1080 THEN 'HD' ELSE '' END AS size FROM p""")
def clip_properties(spark, d):
    pick = lambda *xs: F.get(F.array(*xs), (F.col("asset_id") % 4).cast("int"))
    a = assets(spark, d).withColumn("tr", pick(F.lit("smpte2084"), F.lit("arib-std-b67"), F.lit("bt709"), F.lit(None))).withColumn("rot", pick(*[F.lit(r) for r in (0, 90, 180, 270)]))
    w, h, camera = F.col("width"), F.col("height"), media.camera_original(F.when(F.col("asset_id") % 3 > 0, "Apple").otherwise(""), F.lit(None).cast("string"))
    return a.select(
        "asset_id", media.is_hdr(F.col("tr")).alias("hdr"), media.hdr_format(F.col("tr")).alias("format"), media.displayed(w, h, F.col("rot"))[0].alias("seen_width"), F.round(media.aspect_ratio(w, h), 4).alias("ratio"), camera.alias("camera"),
        media.usable_source(w, h, camera, 1080).alias("usable"), media.passes_quality_gate(F.col("favorite"), camera, w, h, 2160).alias("gate"), F.array_join(media.badges(w, h, F.lit(False)), ",").alias("size"),
    )


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT *, (score % 10) / 10 AS v, (score % 7) / 7 AS u, asset_id % 2 = 0 AS good, score AS len FROM a), s AS (SELECT *, v * 0.7 + u * 0.15 + v * 0.15 AS base FROM b),
t AS (SELECT *, base + greatest(0, u - 0.5) * 0.4 + v * 0.15 + CASE WHEN good THEN 0.1 ELSE 0 END AS total FROM s)
SELECT asset_id, round(CAST(CASE WHEN base < 0.7 THEN least(total, 0.8) ELSE total END AS DOUBLE) + 1e-9, 5) AS score,
  round(CAST(CASE WHEN len <= 15 THEN len WHEN len <= 60 THEN least(15 * CASE WHEN good THEN 1.15 ELSE 1.0 END, len) ELSE greatest(15, least(len * 0.2, 15 * CASE WHEN good THEN 1.15 ELSE 1.0 END)) END AS DOUBLE) + 1e-9, 5) AS longest FROM t""")
def segment_scores(spark, d):
    v, u, good = F.col("score") % 10 / 10, F.col("score") % 7 / 7, F.col("asset_id") % 2 == 0
    return assets(spark, d).select("asset_id", F.round(media.segment_score(v, u, v, u, v, good) + 1e-9, 5).alias("score"), F.round(media.longest_segment(F.col("score"), 15.0, good) + 1e-9, 5).alias("longest"))


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT owner, count(*) AS n, count(DISTINCT strftime(taken_at, '%Y-%m-%d')) AS days, sum(duration) AS target FROM a GROUP BY 1)
SELECT owner, round(CAST(least(greatest(0, 7.5 + days * 2.0 - (n % 30 + 1) * 0.25 * CAST(n % 30 > 0 AS INTEGER)), target * 0.2) AS DOUBLE), 4) AS overhead, round(CAST(greatest(least(greatest(0, 7.5 + days * 2.0 - (n % 30 + 1) * 0.25 * CAST(n % 30 > 0 AS INTEGER)), target * 0.3), target * 0.1) AS DOUBLE), 4) AS trip_overhead FROM t""")
def title_overheads(spark, d):
    t = assets(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("taken_at")).alias("days"), F.sum("duration").alias("target"))
    of = lambda trip: F.round(media.title_overhead(3.5, 4.0, F.col("days"), 2.0, F.col("n") % 30, F.col("target"), trip), 4)
    return t.select("owner", of(False).alias("overhead"), of(True).alias("trip_overhead"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN q > 30 + greatest(10, 7.5) THEN 'refused' WHEN q > 30 + greatest(2, 1.5) THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def overruns(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", media.overrun(F.col("l_quantity"), F.lit(30.0)).alias("verdict"))


@query("""WITH p AS (SELECT l_orderkey AS video, l_quantity AS t, bool_or(l_linenumber % 2 = 0) AS audio FROM lineitem GROUP BY 1, 2),
c AS (SELECT a.video, a.t AS "start", b.t AS "end", CAST(a.audio AS INTEGER) + CAST(b.audio AS INTEGER) AS edges FROM p a JOIN p b ON a.video = b.video AND b.t - a.t BETWEEN 2 AND 15 WHERE a.audio OR b.audio)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY video ORDER BY edges DESC, abs("end" - "start" - 5), "start", "end") <= 20""")
def mixed_boundary_segments(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_quantity").alias("t")).agg(F.bool_or(F.col("l_linenumber") % 2 == 0).alias("audio"))
    a, b = p.alias("a"), p.alias("b")
    met = a.join(b, (F.col("a.video") == F.col("b.video")) & (F.col("b.t") - F.col("a.t")).between(2, 15) & (F.col("a.audio") | F.col("b.audio")))
    found = met.select("a.video", F.col("a.t").alias("start"), F.col("b.t").alias("end"), (F.col("a.audio").cast("int") + F.col("b.audio").cast("int")).alias("edges"))
    return ranking.top_per(found, ["video"], [F.desc("edges"), F.abs(F.col("end") - F.col("start") - 5), F.col("start"), F.col("end")], 20)


@query("""WITH g AS (SELECT l_orderkey AS video, l_quantity AS s, l_quantity + l_discount * 10 AS e FROM lineitem WHERE l_discount * 10 >= 0.3 AND abs(l_quantity + l_discount * 5 - 25) <= 10)
SELECT video, s AS "start", round(e, 4) AS "end" FROM g QUALIFY row_number() OVER (PARTITION BY video ORDER BY round(e - s, 4) DESC, s) = 1""")
def boundary_candidates(spark, d):
    gaps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_quantity").alias("start"), F.round(F.col("l_quantity") + F.col("l_discount") * 10, 4).alias("end"), "l_discount")
    near = gaps.where((F.col("l_discount") * 10 >= 0.3) & (F.abs(F.col("start") + F.col("l_discount") * 5 - 25) <= 10))
    return ranking.first_per(near, ["video"], [F.desc(F.round(F.col("end") - F.col("start"), 4)), F.col("start")]).select("video", "start", "end")


@query("""WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS len, CASE WHEN p_size < 5 THEN 0 WHEN p_size <= 15 THEN 1 ELSE CAST(ceil(p_size / 10.0) AS INTEGER) END AS n FROM part)
SELECT p_partkey, round(k * len / n, 4) AS "start", round((k + 1) * len / n, 4) AS "end" FROM (SELECT *, unnest(range(n)) AS k FROM s WHERE n > 0)""")
def scene_segments(spark, d):
    n = F.when(F.col("p_size") < 5, 0).when(F.col("p_size") <= 15, 1).otherwise(F.ceil(F.col("p_size") / 10.0).cast("int"))
    s = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("len"), n.alias("n")).where("n > 0")
    return s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("p_partkey", F.round(F.col("k") * F.col("len") / F.col("n"), 4).alias("start"), F.round((F.col("k") + 1) * F.col("len") / F.col("n"), 4).alias("end"))


@query(f"""WITH {ASSETS_SQL}, k AS (SELECT owner, kind, asset_id, score > 50 AS on_air, score FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY asset_id) - row_number() OVER (PARTITION BY owner, kind, on_air ORDER BY asset_id) AS grp FROM k)
SELECT owner, kind, CAST(min(asset_id) AS DOUBLE) AS "start", CAST(max(asset_id) + 1 AS DOUBLE) AS "end" FROM g WHERE on_air GROUP BY owner, kind, grp""")
def event_runs_per_class(spark, d):
    return intervals.runs_where(assets(spark, d).withColumn("at", F.col("asset_id").cast("double")), F.col("score") > 50, "at", 1.0, ["owner", "kind"], 0.0)


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT owner, avg(score) AS m, stddev_pop(score) AS sd FROM a GROUP BY 1)
SELECT asset_id, CASE WHEN score > m + 2.5 * sd THEN 'peak' ELSE 'raised' END AS event FROM a JOIN s USING (owner) WHERE score > m + 1.5 * sd""")
def energy_events(spark, d):
    w = Window.partitionBy("owner")
    a = assets(spark, d).withColumn("m", F.avg("score").over(w)).withColumn("sd", F.stddev_pop("score").over(w)).where("score > m + 1.5 * sd")
    return a.select("asset_id", F.when(F.col("score") > F.col("m") + 2.5 * F.col("sd"), "peak").otherwise("raised").alias("event"))


@query(f"""WITH {ASSETS_SQL}, e AS (SELECT owner, kind, sum(score * duration) / sum(duration) AS s, max(CASE WHEN favorite THEN 1 ELSE 0 END) AS f FROM a GROUP BY 1, 2)
SELECT owner, round(avg(s), 4) AS score, max(f) = 1 AS laughter, count(*) AS classes FROM e GROUP BY 1""")
def weighted_audio(spark, d):
    e = assets(spark, d).groupBy("owner", "kind").agg((F.sum(F.col("score") * F.col("duration")) / F.sum("duration")).alias("s"), F.bool_or("favorite").alias("f"))
    return e.groupBy("owner").agg(F.round(F.avg("s"), 4).alias("score"), F.bool_or("f").alias("laughter"), F.count(F.lit(1)).alias("classes"))


@query(f"""WITH {ASSETS_SQL}, b AS (SELECT *, sum(duration) OVER (PARTITION BY owner ORDER BY score, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS freed, sum(duration) OVER (PARTITION BY owner) AS total FROM a WHERE kind = 'view')
SELECT asset_id FROM b WHERE total - coalesce(freed, 0) <= 0.9 * 200""")
def budget_unified_videos(spark, d):
    a = assets(spark, d).where("kind = 'view'")
    gone = ranking.evict_to_budget(a.withColumn("d", F.col("duration").cast("long")), "d", 180, [F.col("score"), F.col("asset_id")], ["owner"])
    return a.join(gone.select("asset_id"), "asset_id", "left_anti").select("asset_id")


@query(f"""WITH {ASSETS_SQL}, k AS (SELECT *, CAST(taken_at AS DATE) AS day FROM a WHERE kind <> 'view') SELECT asset_id, day FROM k WHERE day NOT IN (SELECT CAST(taken_at AS DATE) FROM a WHERE kind = 'view' AND score > 150)
QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, asset_id) <= 2""")
def budget_unified_photos(spark, d):
    a = assets(spark, d).withColumn("day", F.to_date("taken_at"))
    photos = a.where("kind <> 'view'").join(a.where("kind = 'view' and score > 150").select("day").distinct(), "day", "left_anti")
    return ranking.top_per(photos, ["day"], [F.desc("score"), F.col("asset_id")], 2).select("asset_id", "day")


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT owner, CAST(taken_at AS DATE) AS day, min_by(struct_pack(la := lat, lo := lon), (taken_at, asset_id)) AS p FROM a GROUP BY 1, 2)
SELECT owner, count(*) AS days, round(max(p.la) - min(p.la), 4) AS lat_span, round(avg(p.la) + 1e-8, 4) AS lat, round(avg(p.lo) + 1e-8, 4) AS lon FROM t GROUP BY 1""")
def map_viewports(spark, d):
    first = assets(spark, d).groupBy("owner", F.to_date("taken_at").alias("day")).agg(F.min_by(F.struct("lat", "lon"), F.struct("taken_at", "asset_id")).alias("p"))
    return first.groupBy("owner").agg(F.count(F.lit(1)).alias("days"), F.round(F.max("p.lat") - F.min("p.lat"), 4).alias("lat_span"), F.round(F.avg("p.lat") + 1e-8, 4).alias("lat"), F.round(F.avg("p.lon") + 1e-8, 4).alias("lon"))


@query(f"""WITH {ASSETS_SQL}, k AS (SELECT owner, asset_id, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({HOME[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - lon) / 2), 2)))) AS km FROM a)
SELECT asset_id, km >= 50 AS away FROM k""")
def away_flags(spark, d):
    return assets(spark, d).select("asset_id", geo.away(F.col("lat"), F.col("lon"), HOME, 50.0).alias("away"))


@query("""SELECT o_orderkey, coalesce(x.extra, o_totalprice) AS score FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS extra FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON l_orderkey = o_orderkey""")
def score_with_fallback(spark, d):
    extra = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("extra"))
    return table(spark, d, "orders").join(extra, "o_orderkey", "left").select("o_orderkey", F.coalesce("extra", "o_totalprice").alias("score"))


@query("""WITH t AS (SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation), m AS (SELECT *, CASE WHEN CAST(id AS VARCHAR) = 'nation_7' THEN 0 WHEN name = 'nation_7' THEN 1 WHEN lower(name) = 'nation_7' THEN 2 END AS tier FROM t)
SELECT id, name, n FROM m WHERE tier = (SELECT min(tier) FROM m)""")
def resolve_album(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tier = F.when(F.col("id").cast("string") == "nation_7", 0).when(F.col("name") == "nation_7", 1).when(F.lower("name") == "nation_7", 2)
    tiers = t.withColumn("tier", tier).where("tier is not null")
    return ranking.top_per(tiers.withColumn("all", F.lit(1)).withColumn("least", F.min("tier").over(Window.partitionBy("all"))).where("tier = least"), ["all"], [F.desc("n"), F.col("id")], 1_000).select("id", "name", "n")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' ELSE o_orderstatus END AS status, greatest(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_custkey % 3) AS phase FROM orders""")
def phase_updates(spark, d):
    phase = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "interrupted").otherwise(F.col("o_orderstatus")).alias("status"), F.greatest(phase, F.col("o_custkey") % 3).alias("phase"))


@query("""WITH b AS (SELECT c_custkey, DATE '1990-01-01' + CAST(c_custkey % 366 AS INTEGER) AS born FROM customer), u AS (SELECT c_custkey, make_date(2023, CAST(month(born) AS INTEGER), CAST(day(born) AS INTEGER)) AS next FROM b)
SELECT c_custkey, next, CAST(date_diff('day', DATE '2023-03-01', next) AS INTEGER) AS in_days FROM u WHERE next BETWEEN DATE '2023-03-01' AND DATE '2023-03-08'""")
def upcoming_birthdays(spark, d):
    born = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int"))
    due = table(spark, d, "customer").select("c_custkey", calendar.anniversary(born, F.lit(2023)).alias("next"))
    return due.withColumn("in_days", F.datediff("next", F.lit("2023-03-01").cast("date"))).where("in_days between 0 and 7")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) < 6 THEN 'spring' WHEN month(o_orderdate) < 9 THEN 'summer' ELSE 'autumn' END || ' ' || CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END AS VARCHAR) AS label,
  CAST(DATE_TRUNC('year', o_orderdate) AS DATE) AS year_start, last_day(o_orderdate::DATE) AS month_end FROM orders""")
def season_labels(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", calendar.season(at), calendar.season_year(at).cast("string")).alias("label"), F.trunc(at.cast("date"), "year").alias("year_start"), F.last_day(at.cast("date")).alias("month_end"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tries FROM orders)
SELECT o_orderkey, tries >= 3 AS abandoned FROM s WHERE o_orderstatus = 'P'""")
def attempt_abandonment(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    tries = table(spark, d, "orders").withColumn("tries", F.count_if(F.col("o_orderstatus") == "P").over(w))
    return tries.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("tries") >= 3).alias("abandoned"))


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT 'all' AS stage, 0 AS step, count(*) AS n, count(*) FILTER (WHERE favorite) AS favorites FROM a UNION ALL SELECT 'long', 1, count(*), count(*) FILTER (WHERE favorite) FROM a WHERE duration >= 3 UNION ALL SELECT 'good', 2, count(*), count(*) FILTER (WHERE favorite) FROM a WHERE duration >= 3 AND score >= 50)
SELECT stage, n, favorites, coalesce(lag(n) OVER (ORDER BY step) - n, 0) AS dropped FROM s""")
def selection_funnel(spark, d):
    a = assets(spark, d)
    steps = (("all", F.lit(True)), ("long", F.col("duration") >= 3), ("good", (F.col("duration") >= 3) & (F.col("score") >= 50)))
    one = a.agg(*[x for name, c in steps for x in (F.count_if(c).alias(name), F.count_if(c & F.col("favorite")).alias(f"{name}_f"))])
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("n"), F.col(f"{name}_f").alias("favorites"), ((F.col(steps[k - 1][0]) - F.col(name)) if k else F.lit(0).cast("long")).alias("dropped")) for k, (name, _) in enumerate(steps)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query("""SELECT p_partkey, round(CAST(CASE WHEN p_size = 0 THEN 0 ELSE least(300.0, greatest(60.0, 30.0 + 10.0 * p_size)) END AS DOUBLE), 4) AS trip, round(CAST(least(1.0, least(p_size / 100.0 / 0.15, 1.0) + least(0.1 * (p_partkey % 5), 0.3)) AS DOUBLE), 6) AS face, CAST(floor(least(p_size, p_partkey % 50) * 0.3) AS BIGINT) AS shared FROM part""")
def planning_scores(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(F.when(s == 0, 0.0).otherwise(scores.trip_duration(s)), 4).alias("trip"), F.round(scores.face_score(s / 100.0, F.col("p_partkey") % 5), 6).alias("face"), scores.shared_estimate(s, F.col("p_partkey") % 50).alias("shared"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN n ON o_custkey = c_custkey AND k = 1""")
def newest_run_per_folder(spark, d):
    runs = history.latest_per(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, d, "customer").join(runs, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
