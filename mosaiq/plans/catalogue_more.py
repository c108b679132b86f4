"""More registered queries: groups, coverage, aggregates, detectors, planning and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar, geo, hashing, scores, text
from mosaiq.operators import folds, history, intervals, ranking, sessions
from mosaiq.plans import fold_sql
from mosaiq.plans.adapters import ASSETS_SQL, HOME, assets, table
from mosaiq.plans.catalogue import available_years, query


def n_over(*by):
    return F.count(F.lit(1)).over(Window.partitionBy(*by))


# --- groups and their best


@query(f"""WITH {ASSETS_SQL} SELECT owner, CAST(taken_at AS DATE) AS day, asset_id, round(q, 6) AS quality FROM (SELECT *, 0.4 * least(1.0, width * height / 8294400.0) + 0.3 * least(1.0, bitrate / 5e7) + 0.2 * least(1.0, duration / 60.0) + 0.05 AS q FROM a)
QUALIFY row_number() OVER (PARTITION BY owner, CAST(taken_at AS DATE) ORDER BY round(q, 6) DESC, asset_id) = 1""")
def best_of_group(spark, d):
    c = F.col
    quality = F.round(scores.group_quality(c("width"), c("height"), c("bitrate"), c("duration"), F.lit(None).cast("double")), 6)
    a = assets(spark, d).select("owner", F.to_date("taken_at").alias("day"), "asset_id", quality.alias("quality"))
    return ranking.first_per(a, ["owner", "day"], [F.desc("quality"), c("asset_id")])


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS cluster
  FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM a WHERE kind <> 'error')),
t AS (SELECT *, sum(CASE WHEN gap2 IS NULL OR gap2 >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY owner, cluster ORDER BY taken_at, asset_id) AS part
  FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner, cluster ORDER BY taken_at, asset_id)) / 1e6 AS gap2 FROM s))
SELECT owner, CAST(cluster AS INTEGER) AS cluster, CAST(part AS INTEGER) AS part, count(*) AS n, bool_or(favorite) AS favorite, min_by(asset_id, (taken_at, asset_id)) AS head, string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY taken_at, asset_id) AS ids FROM t GROUP BY 1, 2, 3""")
def live_clusters(spark, d):
    a = sessions.moments(assets(spark, d).where("kind <> 'error'"), "taken_at", 7200, ["owner"], "asset_id", "cluster")
    parts = sessions.moments(a, "taken_at", 1799.9999995, ["owner", "cluster"], "asset_id", "part")
    row = F.struct("taken_at", "asset_id")
    grouped = parts.groupBy("owner", "cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.bool_or("favorite").alias("favorite"), F.min(row)["asset_id"].alias("head"), F.array_sort(F.array_agg(row)).alias("rows"))
    return grouped.select("owner", "cluster", "part", "n", "favorite", "head", F.array_join(F.transform("rows", lambda r: r["asset_id"].cast("string")), ",").alias("ids"))


@query(fold_sql.OVERNIGHT)
def overnight_bases(spark, d):
    a = assets(spark, d).where(geo.away(F.col("lat"), F.col("lon"), HOME, 50.0))
    stops = folds.overnight_stops(a, "taken_at", "lat", "lon", ["owner"], "asset_id", 2.0)
    return stops.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(fold_sql.HOME_BASES)
def home_bases(spark, d):
    """The places of each owner's days away, within 2 km of their seeds, and which of them are bases."""
    a = assets(spark, d).where(geo.away(F.col("lat"), F.col("lon"), HOME, 50.0))
    places = folds.places_of_days(a, "taken_at", "lat", "lon", ["owner"], "asset_id", 2.0)
    return places.select("owner", "place", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.size("days").alias("n_days"), "n", "span", "is_base")


@query(fold_sql.SCENE_CUTS)
def scene_cuts(spark, d):
    cuts = assets(spark, d).where("score > 60").withColumn("at", F.unix_micros(F.col("taken_at").cast("timestamp")) / 1e6)
    return folds.spaced(cuts, "at", 3600.0, ["owner"])


@query(fold_sql.BOUNDARY_MERGE)
def boundary_merge(spark, d):
    a = assets(spark, d).withColumn("at", F.dayofmonth("taken_at") * 10.0 + F.col("duration") / 10).withColumn("len", F.lit(400.0))
    return folds.boundaries(a.where("kind = 'view'"), a.where("kind = 'click'"), "at", ["owner"], "len", 0.2)


@query(fold_sql.DAY_SLOTS)
def day_slot_allocation(spark, d):
    return folds.day_slots(assets(spark, d).withColumn("day", F.to_date("taken_at")), "day", ["owner"], 40)


@query(fold_sql.FARTHEST)
def farthest_day_select(spark, d):
    return folds.farthest_days(assets(spark, d).withColumn("budget", F.lit(60.0)), "taken_at", "duration", "favorite", "score", ["owner"], "asset_id", "budget")


@query(fold_sql.INTERLEAVED)
def interleave_types(spark, d):
    return folds.interleaved(assets(spark, d).select("owner", "asset_id", "kind", "taken_at"), "kind", ["owner"], ["taken_at", "asset_id"])


# --- ranks and coverage


@query("""WITH r AS (SELECT *, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / (count(*) OVER (PARTITION BY p_brand) - 1) AS a,
  (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2) / (count(*) OVER (PARTITION BY p_brand) - 1) AS b, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, round(CAST(0.65 * 0.5 + 0.35 * 0.8 * (CASE WHEN n > 1 THEN 0.6 * a + 0.2 * b + 0.2 * b ELSE 1.0 END) AS DOUBLE), 6) AS score FROM r""")
def frame_quality_blend(spark, d):
    p = ranking.midpoint_rank(ranking.midpoint_rank(table(spark, d, "part"), "p_size", ["p_brand"], "sharp"), "p_retailprice", ["p_brand"], "contrast")
    blend = 0.6 * F.col("sharp") + 0.2 * F.col("contrast") + 0.2 * F.col("contrast")
    return p.select("p_partkey", F.round(0.65 * 0.5 + 0.35 * 0.8 * blend, 6).alias("score"))


@query(f"""WITH {ASSETS_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) - 1) // greatest(1, count(*) OVER (PARTITION BY owner) // 8) AS bucket FROM a),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY owner, bucket ORDER BY score DESC, asset_id) = 1)
SELECT owner, CAST(bucket AS INTEGER) AS bucket, asset_id FROM b WHERE bucket < 8""")
def distributed_photos(spark, d):
    w = Window.partitionBy("owner").orderBy("taken_at", "asset_id")
    size = F.greatest(F.lit(1), F.floor(n_over("owner") / 8))
    bucketed = assets(spark, d).withColumn("bucket", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return ranking.first_per(bucketed, ["owner", "bucket"], [F.desc("score"), F.col("asset_id")]).where("bucket < 8").select("owner", "bucket", "asset_id")


@query(f"""WITH {ASSETS_SQL}, f AS (SELECT *, count(*) FILTER (WHERE favorite) OVER (PARTITION BY owner) AS favs, row_number() OVER (PARTITION BY owner, favorite ORDER BY width * height DESC, asset_id) AS place FROM a)
SELECT asset_id FROM f WHERE favorite OR place <= greatest(0, 30 - favs)""")
def analysis_cap(spark, d):
    a = assets(spark, d).withColumn("favs", F.sum(F.col("favorite").cast("int")).over(Window.partitionBy("owner")))
    ranked = a.withColumn("place", F.row_number().over(Window.partitionBy("owner", "favorite").orderBy(F.desc(F.col("width") * F.col("height")), "asset_id")))
    return ranked.where(F.col("favorite") | (F.col("place") <= F.greatest(F.lit(0), 30 - F.col("favs")))).select("asset_id")


@query(f"""WITH {ASSETS_SQL}, w AS (SELECT *, strftime(taken_at, '%G-W%V') AS week FROM a), c AS (SELECT owner, week, count(*) AS n FROM w WHERE favorite GROUP BY 1, 2)
SELECT asset_id FROM w LEFT JOIN c USING (owner, week) WHERE NOT favorite QUALIFY row_number() OVER (PARTITION BY w.owner ORDER BY round(score / 100 - 0.1 * coalesce(n, 0), 6) DESC, asset_id) <= 5""")
def remaining_slots(spark, d):
    a = assets(spark, d).withColumn("week", calendar.iso_week(F.col("taken_at")))
    chosen = a.where("favorite").groupBy("owner", "week").agg(F.count(F.lit(1)).alias("n"))
    worth = F.round(F.col("score") / 100 - 0.1 * F.coalesce("n", F.lit(0)), 6)
    rest = a.where("not favorite").join(chosen, ["owner", "week"], "left").withColumn("worth", worth)
    return ranking.top_per(rest, ["owner"], [F.desc("worth"), F.col("asset_id")], 5).select("asset_id")


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT owner, CAST(taken_at AS DATE) AS day, count(*) AS n FROM a GROUP BY 1, 2), s AS (SELECT *, greatest(1, floor(40 * n / sum(n) OVER (PARTITION BY owner))) AS share FROM t),
l AS (SELECT *, 40 - sum(share) OVER (PARTITION BY owner) AS spare, row_number() OVER (PARTITION BY owner ORDER BY n DESC, day) AS place FROM s)
SELECT owner, day, CAST(share + CASE WHEN place <= spare THEN 1 ELSE 0 END AS INTEGER) AS clips FROM l""")
def trip_clip_budget(spark, d):
    days = assets(spark, d).groupBy("owner", F.to_date("taken_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("owner")
    share = days.withColumn("share", F.greatest(F.lit(1), F.floor(40 * F.col("n") / F.sum("n").over(w))))
    spare = share.withColumn("spare", 40 - F.sum("share").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "day")))
    return spare.select("owner", "day", (F.col("share") + (F.col("place") <= F.col("spare")).cast("int")).cast("int").alias("clips"))


@query(f"""WITH {ASSETS_SQL}, w AS (SELECT *, date_trunc('week', taken_at)::DATE AS week FROM a), f AS (SELECT owner, min(week) AS lo, max(week) AS hi FROM w WHERE favorite GROUP BY 1),
e AS (SELECT owner, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS week FROM f), o AS (SELECT * FROM e ANTI JOIN (SELECT DISTINCT owner, week FROM w WHERE favorite AND score > 40) k USING (owner, week))
SELECT w.asset_id, w.week FROM w JOIN o USING (owner, week) QUALIFY row_number() OVER (PARTITION BY w.owner, w.week ORDER BY score DESC, asset_id) <= 2""")
def fill_empty_weeks(spark, d):
    a = assets(spark, d).withColumn("week", F.trunc(F.to_date("taken_at"), "week"))
    span = a.where("favorite").groupBy("owner").agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    weeks = span.select("owner", F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week"))
    empty = weeks.join(a.where("favorite and score > 40").select("owner", "week").distinct(), ["owner", "week"], "left_anti")
    return ranking.top_per(a.join(empty, ["owner", "week"]), ["owner", "week"], [F.desc("score"), F.col("asset_id")], 2).select("asset_id", "week")


@query(f"""WITH {ASSETS_SQL}, w AS (SELECT owner, strftime(taken_at, '%G-W%V') AS week, count(*) FILTER (WHERE favorite) AS favs, count(*) AS n FROM a GROUP BY 1, 2)
SELECT owner, week, favs, favs >= 1.5 * avg(favs) OVER (PARTITION BY owner) OR week = min(week) OVER (PARTITION BY owner) OR week = max(week) OVER (PARTITION BY owner) AS protected FROM w""")
def protected_weeks(spark, d):
    weeks = assets(spark, d).groupBy("owner", calendar.iso_week(F.col("taken_at")).alias("week")).agg(F.count_if("favorite").alias("favs"))
    w = Window.partitionBy("owner")
    held = (F.col("favs") >= 1.5 * F.avg("favs").over(w)) | (F.col("week") == F.min("week").over(w)) | (F.col("week") == F.max("week").over(w))
    return weeks.select("owner", "week", "favs", held.alias("protected"))


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')) = 1 AS sole FROM orders""")
def sole_representatives(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (n_over("o_custkey", calendar.month_key(F.col("o_orderdate"))) == 1).alias("sole"))


@query("""SELECT o_orderkey, CASE WHEN s <= 30 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN s <= 90 THEN strftime(o_orderdate, '%G-W%V') WHEN s <= 365 THEN strftime(o_orderdate, '%Y-%m') ELSE year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS period
FROM (SELECT *, date_diff('day', min(o_orderdate::DATE) OVER (PARTITION BY o_custkey), max(o_orderdate::DATE) OVER (PARTITION BY o_custkey)) AS s FROM orders)""")
def adaptive_periods(spark, d):
    w = Window.partitionBy("o_custkey")
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", calendar.period_key(F.col("o_orderdate"), F.datediff(F.max(day).over(w), F.min(day).over(w))).alias("period"))


# --- aggregates


@query("""SELECT count(*) AS n, count(p_name) AS named, count(DISTINCT p_brand) AS brands, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part""")
def cache_stats(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count("p_name").alias("named"), F.countDistinct("p_brand").alias("brands"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))


@query("""SELECT t.class, coalesce(n, 0) AS n, coalesce(round(bytes, 2), 0.0) AS bytes FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(class) LEFT JOIN (SELECT o_orderstatus AS class, count(*) AS n, sum(o_totalprice) AS bytes FROM orders GROUP BY 1) s ON s.class = t.class""")
def storage_summary(spark, d):
    sums = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))
    classes = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "class string")
    return classes.join(sums, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0.0)).alias("bytes"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment AS segment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM c)
SELECT c_nationkey, segment, n >= 0.25 * total AS dominant FROM t QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) = 1""")
def mode_first_seen(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy("c_nationkey")))
    best = ranking.first_per(total, ["c_nationkey"], [F.desc("n"), F.col("first")])
    return best.select("c_nationkey", "segment", (F.col("n") >= 0.25 * F.col("total")).alias("dominant"))


@query(f"""WITH {ASSETS_SQL}, c AS (SELECT owner, CAST(taken_at AS DATE) AS day, sum(duration) FILTER (WHERE kind = 'view') AS v, count(*) FILTER (WHERE kind <> 'view') AS p FROM a GROUP BY 1, 2)
SELECT owner, floor(sum(least(30, coalesce(v, 0) + least(p, 4) * 4.0)) / 5) * 5 AS seconds, count(*) AS days FROM c GROUP BY 1""")
def active_day_capacity(spark, d):
    days = assets(spark, d).groupBy("owner", F.to_date("taken_at").alias("day")).agg(F.coalesce(F.sum(F.when(F.col("kind") == "view", F.col("duration"))), F.lit(0.0)).alias("v"), F.count_if(F.col("kind") != "view").alias("p"))
    capacity = F.least(F.lit(30.0), F.col("v") + F.least(F.col("p"), F.lit(4)) * 4.0)
    return days.groupBy("owner").agg((F.floor(F.sum(capacity) / 5) * 5.0).alias("seconds"), F.count(F.lit(1)).alias("days"))


@query(f"""WITH {ASSETS_SQL}, m AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM a WINDOW w AS (PARTITION BY owner ORDER BY taken_at, asset_id))
SELECT owner, count(DISTINCT strftime(taken_at, '%Y-%m-%d')) - 1 AS day_dividers, CAST(count(*) FILTER (WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) > 30) AS BIGINT) AS place_dividers FROM m GROUP BY 1""")
def divider_counts(spark, d):
    w = Window.partitionBy("owner").orderBy("taken_at", "asset_id")
    a = assets(spark, d).withColumn("km", geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    return a.groupBy("owner").agg((F.countDistinct(F.to_date("taken_at")) - 1).alias("day_dividers"), F.count_if(F.col("km") > 30).alias("place_dividers"))


@query(f"""WITH {ASSETS_SQL} SELECT owner, CASE WHEN count(*) FILTER (WHERE asset_id % 7 < 3) > count(*) FILTER (WHERE asset_id % 7 >= 3) THEN 'portrait' ELSE 'landscape' END AS orientation,
  CASE WHEN count(*) FILTER (WHERE height >= 2160) * 2 > count(*) THEN '4k' WHEN count(*) FILTER (WHERE height >= 1080) * 2 > count(*) THEN '1080p' ELSE '720p' END AS tier FROM a GROUP BY 1""")
def canvas_votes(spark, d):
    tall = F.col("asset_id") % 7 < 3
    over = lambda h: F.count_if(F.col("height") >= h) * 2 > F.count(F.lit(1))
    return assets(spark, d).groupBy("owner").agg(F.when(F.count_if(tall) > F.count_if(~tall), "portrait").otherwise("landscape").alias("orientation"), F.when(over(2160), "4k").when(over(1080), "1080p").otherwise("720p").alias("tier"))


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) SELECT o_orderpriority AS category, count(*) AS n FROM s WHERE back <= 6 GROUP BY 1""")
def recent_category_counts(spark, d):
    recent = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(6)
    return recent.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) + 1e-5, 3) AS eta FROM orders""")
def rolling_eta(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, -1)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).over(w) + 1e-5, 3).alias("eta"))


@query("""SELECT label, bit, count(*) FILTER (WHERE x > 0) * 2 > count(*) AS is_set FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS bit FROM embeddings) GROUP BY 1, 2""")
def majority_bits(spark, d):
    bits = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("bit", "x"))
    return bits.groupBy("label", F.col("bit").cast("bigint").alias("bit")).agg((F.count_if(F.col("x") > 0) * 2 > F.count(F.lit(1))).alias("is_set"))


# --- detectors


@query("""SELECT CAST(y AS INTEGER) AS past_year, count(o_orderkey) AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) LEFT JOIN orders ON o_orderdate::DATE BETWEEN make_date(y, 6, 15) - 1 AND make_date(y, 6, 15) + 1 GROUP BY 1""")
def on_this_day(spark, d):
    days = available_years(spark, d).select(F.col("year").alias("past_year"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.date_add(F.make_date("year", F.lit(6), F.lit(15)), k))).alias("day"))
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return days.join(o, "day", "left").groupBy("past_year").agg(F.count("o_orderkey").alias("n"))


# --- planning, segments and text


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, sum(duration) OVER (PARTITION BY owner) AS total FROM a) SELECT asset_id, round(CASE WHEN total > 90 THEN duration * 90 / total ELSE duration END, 6) AS seconds FROM s""")
def proportional_trim(spark, d):
    total = F.sum("duration").over(Window.partitionBy("owner"))
    return assets(spark, d).select("asset_id", F.round(F.when(total > 90, F.col("duration") * 90 / total).otherwise(F.col("duration")), 6).alias("seconds"))


@query("""WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS target, list(l_quantity) OVER (PARTITION BY l_orderkey) AS points FROM lineitem)
SELECT l_orderkey, target, list_min(list_transform(points, lambda q: struct_pack(d := abs(q - target), p := q))).p AS nearest FROM p""")
def nearest_cut_points(spark, d):
    items = table(spark, d, "lineitem")
    points = items.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("points"))
    return items.join(points, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("double").alias("target"), intervals.nearest(F.col("points"), F.col("l_linenumber").cast("double")).alias("nearest"))


@query("""SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS name, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
  regexp_replace(regexp_replace(lower(trim(c_mktsegment || ' & ' || c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN lower(c_mktsegment) LIKE '%house%' THEN 'home' WHEN lower(c_mktsegment) LIKE '%auto%' THEN 'car' END AS category,
  'trip:' || c_mktsegment AS key FROM customer""")
def names_and_keys(spark, d):
    c = F.col
    return table(spark, d, "customer").select(
        "c_custkey", hashing.normal_name(c("c_name")).alias("name"), text.ordinal(c("c_custkey")).alias("nth"), text.slug(F.concat_ws(" & ", "c_mktsegment", "c_name")).alias("slug"),
        text.first_category(c("c_mktsegment"), {"house": "home", "auto": "car"}).alias("category"), F.concat(F.lit("trip:"), c("c_mktsegment")).alias("key"),
    )


@query("""SELECT event_id, CAST(event_id % 24 AS DOUBLE) * 3600 + CAST(event_id % 60 AS DOUBLE) * 60 + CAST(event_id % 7 AS DOUBLE) AS hms, CAST(event_id % 60 AS DOUBLE) * 60 + 1.5 AS ms, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END AS s FROM events""")
def wire_durations(spark, d):
    i = F.col("event_id")
    hms = F.format_string("%d:%02d:%d", i % 24, i % 60, i % 7)
    return table(spark, d, "events").select("event_id", text.wire_duration(hms).alias("hms"), text.wire_duration(F.format_string("%d:01.5", i % 60)).alias("ms"), text.wire_duration(F.when(i % 5 == 0, "x1").otherwise((i % 90).cast("string"))).alias("s"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def tolerant_dates(spark, d):
    at = F.col("o_orderdate")
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "yyyy/M/d")).when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "d/M/yyyy")).otherwise("next week")
    return table(spark, d, "orders").select("o_orderkey", calendar.parsed_date(forms).alias("day"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(left(text, 40), '\\s+\\S*$', '') || '…' END AS head FROM documents""")
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 40).alias("head"))


@query("""SELECT p_partkey, round(CAST(CASE WHEN p_size < 1 THEN 0.3 WHEN p_size < 5 THEN 0.5 + (p_size - 1) * 0.125 WHEN p_size < 15 THEN 1.0 - (p_size - 5) * 0.05 ELSE 0.3 END AS DOUBLE), 6) AS motion, round(CAST(greatest(0, 1 - p_size / 20.0) AS DOUBLE), 6) AS stability,
  round(CAST(least(1.0, 0.15 + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_partkey % 4 > 0 THEN 0.15 + least(0.1, 0.1 * (p_partkey % 4) / 3) ELSE 0 END + 0.05 + 0.15) * 0.8 AS DOUBLE), 6) AS photo, round(CAST(0.75 * least(1.0, p_size / 14.0) * least(1.0, p_retailprice / 2000.0) AS DOUBLE) + 1e-9, 6) AS trip FROM part""")
def metadata_scores(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", F.round(scores.motion_score(c("p_size")), 6).alias("motion"), F.round(scores.stability_score(c("p_size")), 6).alias("stability"),
        F.round(scores.photo_score(c("p_partkey") % 2 == 0, c("p_partkey") % 4, F.lit(True), 0.2), 6).alias("photo"), F.round(scores.trip_score(c("p_size"), c("p_retailprice") / 10) + 1e-9, 6).alias("trip"),
    )


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 20""")
def insert_new_rows(spark, d):
    n = table(spark, d, "nation")
    return history.inserted(n.where("n_nationkey < 20"), n.where("n_nationkey >= 10"), ["n_nationkey"])


@query("""SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL""")
def distinct_people(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).where("name is not null").distinct()


@query("""SELECT o_orderkey, count(l_linenumber) AS phases, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def runs_with_phases(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    return table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("phases"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
