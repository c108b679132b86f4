"""Registered queries on assignments, validation, planning and eviction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import scores, text
from mosaiq.operators import history, intervals, ranking, selection, sessions
from mosaiq.plans import fold_sql
from mosaiq.plans.adapters import ASSETS_SQL, HOME, assets, table
from mosaiq.plans.catalogue import query


@query("""WITH b AS (SELECT s_suppkey AS base, s_nationkey AS g, floor(s_acctbal / 100) AS lo, floor(s_acctbal / 100) + 20 AS hi FROM supplier),
p AS (SELECT c_custkey, c_nationkey AS g, floor(c_acctbal / 100) AS t FROM customer), j AS (SELECT c_custkey, base, greatest(lo - t, t - hi, 0) AS dist FROM p JOIN b USING (g))
SELECT c_custkey, base FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, base) = 1""")
def assign_to_bases(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("base"), F.col("s_nationkey").alias("g"), F.floor(F.col("s_acctbal") / 100).alias("lo"))
    p = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.floor(F.col("c_acctbal") / 100).alias("t"))
    placed = p.join(intervals.nearest_of_length(p, "t", b, "lo", 20, "base", ["g"]), (p["g"] == F.col("__g")) & p["t"].eqNullSafe(F.col("__t")))
    return placed.groupBy("c_custkey").agg(F.min(F.struct("distance", "base"))["base"].alias("base"))


@query("""WITH e AS (SELECT l_orderkey AS v, l_linenumber AS k, l_quantity AS q FROM lineitem), x AS (SELECT a.v, a.q AS s, b.q AS e, a.k + b.k AS rank FROM e a JOIN e b ON a.v = b.v AND b.q > a.q)
SELECT v, s AS "start", e AS "end" FROM x QUALIFY row_number() OVER (PARTITION BY v ORDER BY rank, e - s, s) = 1""")
def best_placement(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    a, b = e.alias("a"), e.alias("b")
    met = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("b.q") > F.col("a.q")))
    best = F.struct((F.col("a.k") + F.col("b.k")).alias("rank"), (F.col("b.q") - F.col("a.q")).alias("span"), F.col("a.q").alias("start"), F.col("b.q").alias("end"))
    return met.groupBy(F.col("a.v").alias("v")).agg(F.min(best).alias("best")).select("v", "best.start", "best.end")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(date_diff('day', o_orderdate::DATE, DATE '1998-06-15')), o_orderkey) = 1""")
def closest_to_date(spark, d):
    away = F.abs(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-06-15").cast("date")))
    return ranking.first_per(table(spark, d, "orders"), ["o_custkey"], [away, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"""WITH {ASSETS_SQL}, r AS (SELECT *, CAST(taken_at AS DATE) AS day FROM a) SELECT asset_id FROM r WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-08' OR day BETWEEN DATE '2024-01-06' AND DATE '2024-01-12'""")
def union_of_ranges(spark, d):
    ranges = spark.createDataFrame([("2024-01-03", "2024-01-08"), ("2024-01-06", "2024-01-12")], "lo string, hi string")
    days = ranges.select(F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias("day")).distinct()
    return assets(spark, d).withColumn("day", F.to_date("taken_at")).join(days, "day").select("asset_id")


@query("""SELECT c_nationkey AS country, min(c_custkey) AS first FROM customer GROUP BY 1""")
def countries_by_first_appearance(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.min("c_custkey").alias("first"))


@query("""SELECT l_partkey, max(l_quantity) AS total, max(l_discount) AS face, max(l_tax) AS motion FROM lineitem GROUP BY 1""")
def best_scores_per_asset(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("total"), F.max("l_discount").alias("face"), F.max("l_tax").alias("motion"))


@query("""WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS bucket, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT month, max_by(n, bucket) AS n FROM b GROUP BY 1)
SELECT left(month, 4) AS year, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1""")
def year_rollup(spark, d):
    b = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("month").agg(F.max_by("n", "bucket").alias("n")).groupBy(F.substring("month", 1, 4).alias("year")).agg(F.sum("n").alias("n"))


@query(f"""WITH {ASSETS_SQL}, x AS (SELECT owner, min(lat) AS a, max(lat) AS b, min_by(lon, (lat, asset_id)) AS la, max_by(lon, (lat, -asset_id)) AS lb FROM a GROUP BY 1)
SELECT owner, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(lb - la) / 2), 2)))), 3) AS km FROM x""")
def spread_km(spark, d):
    from mosaiq.functions import geo

    x = assets(spark, d).groupBy("owner").agg(F.min(F.struct("lat", "asset_id", "lon")).alias("s"), F.max(F.struct(F.col("lat"), (-F.col("asset_id")).alias("id"), F.col("lon"))).alias("n"))
    return x.select("owner", F.round(geo.haversine_km(F.col("s.lat"), F.col("s.lon"), F.col("n.lat"), F.col("n.lon")), 3).alias("km"))


@query(f"""WITH {ASSETS_SQL}, w AS (SELECT owner, epoch_us(taken_at) / 1e6 AS s, epoch_us(taken_at) / 1e6 + duration AS e FROM a WHERE kind = 'view') SELECT owner, round(sum(greatest(0, least(e, 1704500000.0) - greatest(s, 1704200000.0))), 3) AS voiced FROM w GROUP BY 1""")
def voiced_seconds(spark, d):
    s = F.unix_micros(F.col("taken_at").cast("timestamp")) / 1e6
    inside = F.greatest(F.lit(0.0), F.least(s + F.col("duration"), F.lit(1704500000.0)) - F.greatest(s, F.lit(1704200000.0)))
    return assets(spark, d).where("kind = 'view'").groupBy("owner").agg(F.round(F.sum(inside), 3).alias("voiced"))


@query("""SELECT p_brand, round(coalesce(avg(CASE WHEN p_size > 25 THEN p_size / 50.0 END), 0.0), 4) AS faces, round(coalesce(avg(CASE WHEN p_size > 100 THEN 1.0 END), 0.5), 4) AS motion FROM part GROUP BY 1""")
def scene_scores(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.coalesce(F.avg(F.when(F.col("p_size") > 25, F.col("p_size") / 50.0)), F.lit(0.0)), 4).alias("faces"), F.round(F.coalesce(F.avg(F.when(F.col("p_size") > 100, 1.0)), F.lit(0.5)), 4).alias("motion"))


@query("""WITH m AS (SELECT c_nationkey, CASE lower(trim(c_mktsegment)) WHEN 'automobile' THEN 'excited' WHEN 'building' THEN 'calm' WHEN 'household' THEN 'calm' END AS mood, c_custkey FROM customer), n AS (SELECT c_nationkey, mood, count(*) AS n, min(c_custkey) AS first FROM m WHERE mood IS NOT NULL GROUP BY 1, 2)
SELECT c_nationkey, mood FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) = 1""")
def dominant_mood(spark, d):
    words = F.create_map(*[F.lit(x) for pair in (("automobile", "excited"), ("building", "calm"), ("household", "calm")) for x in pair])
    m = table(spark, d, "customer").withColumn("mood", words[F.lower(F.trim("c_mktsegment"))]).where("mood is not null")
    n = m.groupBy("c_nationkey", "mood").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    return ranking.first_per(n, ["c_nationkey"], [F.desc("n"), F.col("first")]).select("c_nationkey", "mood")


@query("""WITH h AS (SELECT p_size // 8 AS r, CAST(floor(p_retailprice / 200) AS BIGINT) AS g, count(*) AS n FROM part GROUP BY 1, 2) SELECT CAST(r AS BIGINT) AS r, g, n FROM h ORDER BY n DESC, r, g LIMIT 5""")
def colour_histogram(spark, d):
    h = table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 8).alias("r"), F.floor(F.col("p_retailprice") / 200).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return h.orderBy(F.desc("n"), "r", "g").limit(5)


@query(f"""WITH RECURSIVE {ASSETS_SQL}, o AS (SELECT owner, CAST(taken_at AS DATE) AS day, lat, lon, CASE WHEN lat = 50.8468 THEN 'Home' ELSE 'Quarter ' || (asset_id % 5) END AS city,
  row_number() OVER (PARTITION BY owner, CAST(taken_at AS DATE) ORDER BY taken_at, asset_id) AS k FROM a),
f AS (SELECT owner, day, k, [struct_pack(city := city, lat := lat, lon := lon, n := 1)] AS places FROM o WHERE k = 1
  UNION ALL SELECT owner, day, k, CASE WHEN hit > 0 THEN list_transform(places, lambda p, i: struct_pack(city := p.city, lat := p.lat, lon := p.lon, n := p.n + CASE WHEN i = hit THEN 1 ELSE 0 END))
    ELSE list_append(places, struct_pack(city := city, lat := lat, lon := lon, n := 1)) END
  FROM (SELECT o.*, f.places, coalesce(list_position(list_transform(f.places, lambda p:
      2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(p.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - o.lon) / 2), 2)))) < 5.0), true), 0) AS hit
    FROM f JOIN o ON o.owner = f.owner AND o.day = f.day AND o.k = f.k + 1)),
l AS (SELECT owner, day, unnest(places) AS p, unnest(range(len(places))) AS i FROM f QUALIFY k = max(k) OVER (PARTITION BY owner, day))
SELECT owner, day, strftime(day, '%Y-%m-%d') || ': ' || string_agg(p.city || '(' || p.n || ')', ', ' ORDER BY p.n DESC, i) AS summary FROM l GROUP BY owner, day""")
def daily_place_summary(spark, d):
    """Per owner and day a line of the places of its rows, first come first served within 5 km, with counts."""
    from mosaiq.operators.folds import place_counts

    city = F.when(F.col("lat") == HOME[0], "Home").otherwise(F.concat(F.lit("Quarter "), (F.col("asset_id") % 5).cast("string")))
    a = assets(spark, d).withColumn("day", F.to_date("taken_at")).withColumn("city", city)
    parts = F.transform("places", lambda p: F.concat(p["city"], F.lit("("), p["n"].cast("string"), F.lit(")")))
    line = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(": "), F.array_join(parts, ", "))
    return place_counts(a, "lat", "lon", "city", ["owner", "day"], ["taken_at", "asset_id"]).select("owner", "day", line.alias("summary"))


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS period FROM (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM a)),
n AS (SELECT *, count(*) OVER (PARTITION BY owner, period) AS size FROM s), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY owner, period ORDER BY score DESC, asset_id) = 1)
SELECT owner, asset_id FROM b QUALIFY row_number() OVER (PARTITION BY owner ORDER BY size DESC, asset_id) <= 5""")
def densest_periods_first(spark, d):
    s = sessions.moments(assets(spark, d), "taken_at", 14400, ["owner"], "asset_id", "period").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("owner", "period")))
    best = ranking.first_per(s, ["owner", "period"], [F.desc("score"), F.col("asset_id")])
    return ranking.top_per(best, ["owner"], [F.desc("size"), F.col("asset_id")], 5).select("owner", "asset_id")


@query("""SELECT o_orderkey FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def oldest_pending_delivery(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").join(files, "o_orderkey", "left_semi").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""SELECT source AS folder, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def largest_folders(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("bytes"), "folder").limit(10)


@query(f"""WITH {ASSETS_SQL} SELECT owner, CAST(least(count(*), 3 * greatest(1, count(*) FILTER (WHERE favorite)), 200) AS BIGINT) AS shortlist FROM a GROUP BY 1""")
def shortlist_sizes(spark, d):
    return assets(spark, d).groupBy("owner").agg(F.least(F.count(F.lit(1)), 3 * F.greatest(F.lit(1), F.count_if("favorite")), F.lit(200)).cast("long").alias("shortlist"))


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT owner, sum(duration) AS d, count(*) AS n FROM a GROUP BY 1), f AS (SELECT owner, d, n, least(10, n) AS k FROM t)
SELECT owner, round(d - 0.5 * 0.7 * (k - 1), 4) AS seconds FROM f""")
def transition_overlap(spark, d):
    t = assets(spark, d).groupBy("owner").agg(F.sum("duration").alias("d"), F.count(F.lit(1)).alias("n"))
    return t.select("owner", F.round(F.col("d") - 0.5 * 0.7 * (F.least(F.lit(10), F.col("n")) - 1), 4).alias("seconds"))


@query("""SELECT p_partkey, round(CAST(least(1.0, greatest(0.0, (0.4 + 0.02 * (p_size % 20)) / 0.8 - 0.15 + 0.3 * (p_partkey % 11) / 10.0)) * 0.8 AS DOUBLE) + 1e-9, 5) AS blended, round(CAST(p_size / (p_size + p_partkey % 7 + 1.0) AS DOUBLE) + 1e-9, 5) AS weight,
  CASE WHEN p_partkey % 5 = 0 THEN 'people' WHEN p_type IN ('ECONOMY', 'PROMO') THEN lower(p_type) ELSE 'unknown' END AS subject FROM part""")
def photo_blend(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", F.round(scores.with_model_score(0.4 + 0.02 * (c("p_size") % 20), c("p_partkey") % 11 / 10.0, 0.2) + 1e-9, 5).alias("blended"),
        F.round(scores.normal_weights(c("p_size"), c("p_partkey") % 7 + 1.0)[0] + 1e-9, 5).alias("weight"), text.subject(c("p_partkey") % 5 == 0, F.lower("p_type"), ["economy", "promo"]).alias("subject"),
    )


@query("""SELECT event_id, CASE WHEN k >= 0 AND k <= 50 THEN k / 50.0 END AS strict, left(event_type, 3) AS short, least(1.0, greatest(0.0, k / 60.0)) AS confidence FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def field_validation(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").select("event_id", F.when((k >= 0) & (k <= 50), k / 50.0).alias("strict"), F.substring("event_type", 1, 3).alias("short"), scores.clamp(k / 60.0, 0.0, 1.0).alias("confidence"))


@query("""SELECT o_custkey, sha256(string_agg(strftime(o_orderdate, '%Y-%m-%d') || '=' || o_orderkey, ';' ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS fingerprint FROM orders GROUP BY 1""")
def source_fingerprint(spark, d):
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_agg(row)).alias("rows"))
    return rows.select("o_custkey", F.sha2(F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["day"], r["o_orderkey"].cast("string"))), ";"), 256).alias("fingerprint"))


@query("""SELECT y AS year, make_date(y, 6, 10) AS then_start, make_date(2001, 6, 10) AS now_start, make_date(y - 1, 6, 11) AS trailing_start FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) WHERE y < 2001""")
def then_and_now(spark, d):
    from mosaiq.plans.catalogue import available_years

    y = available_years(spark, d).where("year < 2001")
    day = F.make_date("year", F.lit(6), F.lit(10))
    return y.select("year", day.alias("then_start"), F.make_date(F.lit(2001), F.lit(6), F.lit(10)).alias("now_start"), F.date_add(F.add_months(day, -12), 1).alias("trailing_start"))


@query("""WITH e AS (SELECT l_orderkey AS v, l_quantity AS s, l_quantity + 1 + l_discount * 20 AS e FROM lineitem), r AS (SELECT *, max(e + 0.5) OVER (PARTITION BY v ORDER BY s - 0.5, e + 0.5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - 0.5 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY s - 0.5, e + 0.5) AS i FROM r) SELECT v, round(min(s - 0.5), 3) AS "start", round(max(e + 0.5), 3) AS "end" FROM g GROUP BY v, i""")
def protected_ranges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + 1 + F.col("l_discount") * 20).alias("e"))
    return intervals.merged(e, "s", "e", ["v"], 0.5).select("v", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("""WITH a AS (SELECT o_orderpriority AS k, o_orderkey, o_totalprice FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_totalprice DESC, o_orderkey) AS n FROM a) SELECT k, o_orderkey FROM x WHERE n = 1""")
def dedup_by_key_best(spark, d):
    return ranking.first_per(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "k"), ["k"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("k", "o_orderkey")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey, coalesce(o_orderstatus, 'none') AS last_status FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def latest_attempt(spark, d):
    last = history.latest_per(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderkey")])
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("last_status"))


@query(fold_sql.FAVORITES_THINNED)
def favorites_thinned(spark, d):
    a = assets(spark, d).where("favorite").withColumn("week", F.trunc(F.to_date("taken_at"), "week"))
    w = Window.partitionBy("owner")
    held = (F.col("week") == F.min("week").over(w)) | (F.col("week") == F.max("week").over(w))
    return selection.thinned_favorites(a.withColumn("held", held), ["owner"], "week", "held", "duration", "score", "asset_id", 40.0)


@query(fold_sql.JUDGED)
def judge_until_stable(spark, d):
    return selection.judged_until_stable(assets(spark, d).withColumn("s", F.col("score") / 100), ["owner"], "taken_at", "favorite", "s", "asset_id")


@query(fold_sql.TRANSITIONS)
def transition_plan(spark, d):
    a = assets(spark, d).withColumn("h", F.conv(F.substring(F.md5(F.col("asset_id").cast("string")), 1, 8), 16, 10).cast("long")).withColumn("title", F.col("kind") == "signup")
    return selection.transitions(a, ["owner"], "taken_at", "asset_id", "title", "h")


@query(f"""WITH {ASSETS_SQL}, n AS (SELECT owner, count(*) AS n FROM a WHERE duration >= 3 GROUP BY 1) SELECT owner, CAST(CASE WHEN n < 150 * 0.5 THEN greatest(n, 5) ELSE 150 END AS BIGINT) AS target FROM n""")
def adapted_targets(spark, d):
    n = assets(spark, d).where("duration >= 3").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return n.select("owner", F.when(F.col("n") < 150 * 0.5, F.greatest(F.col("n"), F.lit(5))).otherwise(150).cast("long").alias("target"))


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS g, c_mktsegment AS place FROM customer WHERE c_acctbal > 9000) SELECT c_custkey, CASE WHEN place IS NULL THEN 0.25 ELSE 0.0 END AS bonus FROM customer LEFT JOIN s ON c_nationkey = g AND c_mktsegment = place""".replace("0.25 ELSE 0.0 END", "0.25::DOUBLE ELSE 0.0::DOUBLE END"))
def diversity_bonus(spark, d):
    c = table(spark, d, "customer")
    seen = c.where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment").distinct().withColumn("seen", F.lit(True))
    return c.join(seen, ["c_nationkey", "c_mktsegment"], "left").select("c_custkey", F.when(F.col("seen").isNull(), 0.25).otherwise(0.0).alias("bonus"))


@query("""WITH b AS (SELECT c_custkey, DATE '1990-01-01' + CAST(c_custkey % 366 AS INTEGER) AS born, c_nationkey FROM customer), u AS (SELECT *, make_date(2001, CAST(month(born) AS INTEGER), CAST(least(day(born), 28) AS INTEGER)) AS last FROM b), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, last, n FROM u JOIN n ON o_custkey = c_custkey WHERE date_diff('day', last, DATE '2001-08-01') BETWEEN 2 AND 60""")
def birthday_candidates(spark, d):
    born = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int"))
    last = F.make_date(F.lit(2001), F.month(born), F.least(F.dayofmonth(born), F.lit(28)))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey", last.alias("last")).join(n, "c_custkey").where(F.datediff(F.lit("2001-08-01").cast("date"), "last").between(2, 60))
