"""Registered queries on scans, caches, lookups, counts and small rules.

Columns that the test tables lack are made up from those they have: people are the
owners, still and live photos are kinds of events, segments are order lines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar, hashing
from mosaiq.operators import history, ranking, sessions, similarity
from mosaiq.plans.adapters import ASSETS_SQL, HASHES_SQL, assets, hashes, table
from mosaiq.plans.catalogue import query
from mosaiq.operators.checkpoints import shared_dir
from mosaiq.sources import library

# --- scans of the library


def wire(spark, d):
    """The assets in the library's wire form: purchases are live photos, sign-ups stills, all others videos; an owner is a person."""
    kind = F.when(F.col("kind").isin("purchase", "signup"), "IMAGE").otherwise("VIDEO")
    who = F.col("owner").cast("string")
    return assets(spark, d).select(
        F.col("asset_id").cast("string").alias("id"), kind.alias("type"), F.col("taken_at").alias("file_created_at"), (F.col("taken_at") + F.expr("interval 1 day")).alias("updated_at"),
        F.array(F.struct(who.alias("id"), F.concat(F.lit("Person "), who).alias("name"))).alias("people"), F.when(F.col("kind") == "purchase", (F.col("asset_id") + 1).cast("string")).alias("live_photo_video_id"),
    )


WIRE_SQL = """{assets}, w AS (SELECT CAST(asset_id AS VARCHAR) AS id, CASE WHEN kind IN ('purchase', 'signup') THEN 'IMAGE' ELSE 'VIDEO' END AS type, taken_at AS file_created_at, taken_at + INTERVAL 1 DAY AS updated_at, owner,
  CASE WHEN kind = 'purchase' THEN CAST(asset_id + 1 AS VARCHAR) END AS live_photo_video_id FROM a)""".format(assets=ASSETS_SQL)


def day(text):
    return F.lit(text).cast("date")


@query("""SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS last FROM orders""")
def day_bounds(spark, d):
    at, form = F.col("o_orderdate").cast("date"), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return table(spark, d, "orders").select("o_orderkey", F.date_format(calendar.day_start(at), form).alias("first"), F.date_format(calendar.day_end(at), form).alias("last"))


@query(f"WITH {WIRE_SQL} SELECT id FROM w WHERE owner = 7 AND year(file_created_at) = 2024")
def person_year_scan(spark, d):
    return library.search(wire(spark, d), person="7", taken_from=day("2024-01-01"), taken_to=day("2024-12-31")).select("id")


@query(f"WITH {WIRE_SQL} SELECT id FROM w WHERE type = 'VIDEO' AND year(file_created_at) = 2024")
def year_videos(spark, d):
    return library.search(wire(spark, d), kind="VIDEO", taken_from=day("2024-01-01"), taken_to=day("2024-12-31")).select("id")


@query(f"WITH {WIRE_SQL} SELECT id, type FROM w WHERE owner = 9 AND file_created_at >= DATE '2024-01-04' AND file_created_at < DATE '2024-01-12'")
def person_range_scan(spark, d):
    return library.search(wire(spark, d), person="9", taken_from=day("2024-01-04"), taken_to=day("2024-01-11")).select("id", "type")


@query(f"WITH {WIRE_SQL} SELECT id, type FROM w WHERE owner IN (2, 4) AND file_created_at >= DATE '2024-01-20'")
def any_person_scan(spark, d):
    return library.search(wire(spark, d), persons=["2", "4"], taken_from=day("2024-01-20")).select("id", "type")


@query(f"WITH {WIRE_SQL} SELECT id, live_photo_video_id IS NOT NULL AS live FROM w WHERE type = 'IMAGE'")
def live_and_still_scan(spark, d):
    found = wire(spark, d)
    live, still = library.live_photos(found), library.stills(found)
    return live.select("id", F.lit(True).alias("live")).unionByName(still.select("id", F.lit(False).alias("live")))


@query(f"WITH {WIRE_SQL} SELECT id FROM w ORDER BY file_created_at DESC, id LIMIT 50")
def newest_of_album(spark, d):
    return library.newest(wire(spark, d), 50).select("id")


@query(f"WITH {WIRE_SQL} SELECT id FROM w WHERE strftime(file_created_at, '%Y-%m-%d') = '2024-01-15' AND type = 'VIDEO'")
def bucket_drilldown(spark, d):
    return library.bucket(wire(spark, d), "2024-01-15", "day").where("type = 'VIDEO'").select("id")


@query(f"WITH {WIRE_SQL} SELECT CAST(owner AS VARCHAR) AS person, 'Person ' || owner AS name, count(*) AS n, lower('PERSON 7') = lower('Person ' || owner) AS asked FROM w GROUP BY owner")
def people_counts(spark, d):
    found = library.people(wire(spark, d))
    return found.select("person", "name", "n", (F.lower("name") == F.lower(F.lit("PERSON 7"))).alias("asked"))


@query(f"WITH {WIRE_SQL} SELECT w.id FROM w WHERE type = 'VIDEO' AND id NOT IN (SELECT live_photo_video_id FROM w WHERE live_photo_video_id IS NOT NULL)")
def without_live_videos(spark, d):
    return library.without_live_components(wire(spark, d)).where("type = 'VIDEO'").select("id")


@query("""SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#1' OR (lower(p_type) LIKE '%steel%' AND p_size BETWEEN 10 AND 30)""")
def music_search(spark, d):
    """Tracks are parts: the mood is the brand, the genre the type, the length the size."""
    mood, genre = F.col("p_brand") == "Brand#1", F.lower("p_type").contains("steel")
    return table(spark, d, "part").where(mood | (genre & F.col("p_size").between(10, 30))).select("p_partkey", "p_name")


@query(f"WITH {WIRE_SQL} SELECT count(*) > 0 AS stale, TIMESTAMP '2024-01-30 12:00:00' AS snapshot FROM w WHERE updated_at > TIMESTAMP '2024-01-30 12:00:00'")
def snapshot_freshness(spark, d):
    at = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return wire(spark, d).where(F.col("updated_at") > at).agg((F.count(F.lit(1)) > 0).alias("stale")).withColumn("snapshot", at)


@query("""WITH s AS (SELECT o_custkey AS fingerprint, o_orderkey, CAST(o_orderdate AS DATE) AS stored, CAST(o_orderdate - INTERVAL 90 DAY AS DATE) AS lo, CAST(o_orderdate AS DATE) AS hi FROM orders)
SELECT fingerprint, o_orderkey FROM s WHERE date_diff('day', stored, DATE '1998-06-20') BETWEEN 0 AND 7 AND lo <= DATE '1998-04-01' AND hi >= DATE '1998-06-14'
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY stored DESC, o_orderkey) = 1""")
def usable_snapshots(spark, d):
    """Of each fingerprint the newest snapshot that is at most a week old and holds the range asked for."""
    at = F.col("o_orderdate").cast("date")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("fingerprint"), "o_orderkey", at.alias("stored"), F.date_sub(at, 90).alias("lo"), at.alias("hi"))
    return library.usable_snapshots(s, "fingerprint", day("1998-06-20"), day("1998-04-01"), day("1998-06-14"), "o_orderkey").select("fingerprint", "o_orderkey")


@query("""SELECT c_custkey, c_mktsegment, c_nationkey FROM customer""")
def json_export_and_import(spark, d):
    """A table written as JSON and read again with its schema."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    path = shared_dir(spark)
    library.export_json(rows, path)
    return library.import_json(spark, path, "c_custkey long, c_mktsegment string, c_nationkey " + rows.schema["c_nationkey"].dataType.simpleString())


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"note":"x"' ELSE '' END || '}' AS json FROM orders""")
def run_sidecars(spark, d):
    note = F.when(F.col("o_orderkey") % 3 == 0, "x")
    return library.sidecar(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", note.alias("note")))


# --- eligibility and caches


@query(f"""WITH {ASSETS_SQL} SELECT asset_id, CAST(taken_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_range, duration >= 3.0 AND (bitrate > 10000000 OR duration > 8) AS eligible, duration - 0.6 >= 1.5 AS analysable FROM a""")
def eligibility(spark, d):
    in_range = F.to_date("taken_at").between(day("2024-01-05"), day("2024-01-20"))
    hard = (F.coalesce("duration", F.lit(0.0)) >= 3.0) & ((F.col("bitrate") > 10_000_000) | (F.col("duration") > 8))
    return assets(spark, d).select("asset_id", in_range.alias("in_range"), hard.alias("eligible"), (F.col("duration") - 0.6 >= 1.5).alias("analysable"))


@query("""WITH s AS (SELECT l_orderkey AS asset, l_linenumber AS k, l_quantity AS total, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS description, CASE WHEN l_linenumber = 4 THEN l_tax END AS interest FROM lineitem),
c AS (SELECT o_orderkey AS asset, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 2 END AS version, CASE WHEN o_custkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model FROM orders),
b AS (SELECT asset, count(*) AS n, arg_min(k, (-coalesce(total, 0), k)) AS best, count(*) FILTER (WHERE description IS NOT NULL OR interest IS NOT NULL) AS described FROM s GROUP BY 1)
SELECT c.asset, n IS NOT NULL AND version = 3 AS reusable, n IS NOT NULL AND version = 3 AND model = 'm1' AS compatible, coalesce(described, 0) AS payloads, CAST(best AS BIGINT) AS best_segment FROM c LEFT JOIN b USING (asset)""")
def cache_reuse(spark, d):
    """What of cached analyses may be used again: the objective part, all of it, the segments with semantic fields, and the best segment."""
    lines = table(spark, d, "lineitem")
    payload = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("description"), F.when(F.col("l_linenumber") == 4, F.col("l_tax")).alias("interest"))
    segments = lines.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("total"), history.payload_or_null(payload).alias("payload"))
    best = segments.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min_by("k", F.struct(-F.coalesce(F.col("total").try_cast("double"), F.lit(0.0)), "k")).alias("best"), F.count("payload").alias("described"))
    version, model = F.when(F.col("o_orderstatus") == "F", 3).otherwise(2), F.when(F.col("o_custkey") % 2 == 0, "m1").otherwise("m2")
    cached = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset"), version.alias("version"), model.alias("model")).join(best, "asset", "left")
    reusable = F.col("n").isNotNull() & (F.col("version") == 3)
    return cached.select("asset", reusable.alias("reusable"), (reusable & (F.col("model") == "m1")).alias("compatible"), F.coalesce("described", F.lit(0)).alias("payloads"), F.col("best").cast("long").alias("best_segment"))


@query(f"""WITH {ASSETS_SQL}, m AS (SELECT owner, count(*) FILTER (WHERE asset_id % 4 > 0) AS misses FROM a GROUP BY 1)
SELECT asset_id FROM a JOIN m USING (owner) QUALIFY misses <= 55 OR row_number() OVER (PARTITION BY a.owner ORDER BY favorite DESC, score DESC, asset_id) <= 30""")
def analysis_depth(spark, d):
    """Everything of owners with few cache misses, a shortlist of others."""
    w = Window.partitionBy("owner")
    a = assets(spark, d).withColumn("misses", F.sum((F.col("asset_id") % 4 > 0).cast("int")).over(w))
    return ranking.top_per(a, ["owner"], [F.desc("favorite"), F.desc("score"), F.col("asset_id")], F.when(F.col("misses") <= 55, 1 << 30).otherwise(30)).select("asset_id")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 37 = 5)""")
def lookup_batch(spark, d):
    """Rows of a list of ids (another table's), and a column of one model only."""
    wanted = table(spark, d, "lineitem").where("l_partkey % 37 = 5").select(F.col("l_orderkey").alias("o_orderkey"))
    status = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus"))
    return table(spark, d, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice", status.alias("status"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def prefetch_list(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("""WITH m AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders WHERE month(o_orderdate) = 6 AND year(o_orderdate) = 1998 GROUP BY 1) SELECT o_custkey, CASE WHEN n = 1 THEN o_orderkey END AS o_orderkey, n = 1 AS exact FROM m""")
def exact_trip_match(spark, d):
    """The row that a request names, where exactly one does."""
    asked = table(spark, d, "orders").where((F.month("o_orderdate") == 6) & (F.year("o_orderdate") == 1998))
    n = asked.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("k"))
    return n.select("o_custkey", F.when(F.col("n") == 1, F.col("k")).alias("o_orderkey"), (F.col("n") == 1).alias("exact"))


# --- counts


@query("""SELECT DISTINCT o_custkey || ':' || o_orderpriority AS memory_key FROM orders WHERE o_orderstatus = 'F'""")
def memory_keys_done(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority").alias("memory_key")).distinct()


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS running FROM orders""")
def pending_deliveries(spark, d):
    return table(spark, d, "orders").agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW")).alias("pending"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))


@query(f"""WITH {ASSETS_SQL}, p AS (SELECT owner, strftime(taken_at, '%G-W%V') AS week, avg(CASE WHEN tagged THEN 1.0 ELSE 0.0 END) AS people_share, count(*) AS n FROM a GROUP BY 1, 2)
SELECT owner, week, round(people_share, 6) AS people_share FROM p""")
def people_share(spark, d):
    a = assets(spark, d).groupBy("owner", calendar.iso_week(F.col("taken_at")).alias("week")).agg(F.avg(F.col("tagged").cast("double")).alias("share"))
    return a.select("owner", "week", F.round("share", 6).alias("people_share"))


@query("""WITH n AS (SELECT o_custkey AS k, o_orderpriority AS country, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS total FROM n)
SELECT k, CASE WHEN n >= 0.5 * total THEN country END AS dominant FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, first) = 1""")
def dominant_country(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("country")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return ranking.dominant(n, ["k"], "country", "n", "first", 0.5).select("k", F.col("dominant"))


@query(f"""WITH {ASSETS_SQL} SELECT owner, CAST(greatest(1, round_even(60 / median(duration), 0)) AS BIGINT) AS clips FROM a GROUP BY 1""")
def expected_clips(spark, d):
    return assets(spark, d).groupBy("owner").agg(F.greatest(F.lit(1), F.bround(60 / F.median("duration"), 0)).cast("long").alias("clips"))


# --- groups of alike thumbnails


@query(f"""WITH RECURSIVE {HASHES_SQL}, e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM h a JOIN h b ON a.vec_id <> b.vec_id AND bit_count(xor(a.bits, b.bits)::UBIGINT::BIT) <= 18),
r(node, seen) AS (SELECT vec_id, vec_id FROM h UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u), c AS (SELECT node AS vec_id, min(seen) AS component FROM r GROUP BY 1),
k AS (SELECT c.*, h.bits, vec_id % 7 = 0 AS favorite, vec_id % 5 AS pixels, count(*) OVER (PARTITION BY component) AS size FROM c JOIN h USING (vec_id)),
b AS (SELECT component, first(vec_id ORDER BY favorite DESC, pixels DESC, vec_id) AS best, first(bits ORDER BY favorite DESC, pixels DESC, vec_id) AS best_bits FROM k GROUP BY 1)
SELECT vec_id, component, size, best, vec_id <> best AS excluded, CAST(bit_count(xor(bits, best_bits)::UBIGINT::BIT) AS INTEGER) AS distance FROM k JOIN b USING (component)""")
def thumbnail_clusters(spark, d):
    """Clusters of alike thumbnails: the representative (favorites, then pixels), who is left out for it, and the distance to it."""
    h = hashes(spark, d)
    linked = similarity.similar_groups(h, "vec_id", "bits", 18)
    k = h.join(linked, "vec_id").withColumns({"favorite": F.col("vec_id") % 7 == 0, "pixels": F.col("vec_id") % 5})
    best = k.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("vec_id", "bits"), F.struct(~F.col("favorite"), -F.col("pixels"), "vec_id")).alias("b"))
    return k.join(best, "component").select("vec_id", "component", "size", F.col("b.vec_id").alias("best"), (F.col("vec_id") != F.col("b.vec_id")).alias("excluded"), hashing.hamming_long(F.col("bits"), F.col("b.bits")).cast("int").alias("distance"))


@query(f"""WITH p AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: round((x + 1) * 100)) AS g FROM embeddings),
b AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: CASE WHEN g[i] > list_sum(g) / 64 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)), lambda x, y: x + y)::UBIGINT AS bits FROM p)
SELECT vec_id, lpad(lower(to_hex(bits)), 16, '0') AS hash FROM b""")
def average_hashes(spark, d):
    """Grey values are made of the first 64 numbers of a vector."""
    grey = F.transform(F.slice("embedding", 1, 64), lambda x: F.round((x + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", hashing.average_hash(grey).alias("hash"))


# --- order and nearness in time


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey) AS INTEGER) AS place FROM orders""")
def capture_order(spark, d):
    taken = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(taken.asc_nulls_first(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query(f"""WITH {ASSETS_SQL} SELECT x.asset_id, EXISTS (SELECT 1 FROM a y WHERE y.owner = x.owner AND y.favorite AND y.asset_id <> x.asset_id AND abs(epoch_us(y.taken_at) - epoch_us(x.taken_at)) <= 7200000000) AS same_moment FROM a x""")
def same_moment_flags(spark, d):
    """Whether another row of the owner that is chosen (a favorite) lies within two hours."""
    return sessions.same_moment(assets(spark, d), "taken_at", 7200, ["owner"], F.col("favorite"), "asset_id").select("asset_id", "same_moment")


# --- runs and schedules


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'I' ELSE o_orderstatus END AS status FROM orders""")
def runs_interrupted(spark, d):
    return table(spark, d, "orders").select("o_orderkey", history.replaced(F.col("o_orderstatus"), "O", "I").alias("status"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS generated, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1997-01-01') AS completed_run FROM customer""")
def identity_lookups(spark, d):
    """Whether a key was generated, and its newest completed run after a time."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    recent = F.max(F.when(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz"), F.col("o_orderkey")))
    known = done.groupBy(F.col("o_custkey").alias("c_custkey")).agg(recent.alias("completed_run"), F.lit(True).alias("known"))
    return table(spark, d, "customer").join(known, "c_custkey", "left").select("c_custkey", F.col("known").isNotNull().alias("generated"), "completed_run")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_subjects FROM events""")
def json_columns(spark, d):
    """JSON text as typed columns; text that isn't JSON is an empty list."""
    subjects = F.when(F.col("event_id") % 2 == 0, '["a", "b"]').otherwise("not json")
    read = table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.coalesce(F.from_json(subjects, "array<string>"), F.array().cast("array<string>")).alias("subjects"))
    return read.select("event_id", "k", F.size("subjects").alias("n_subjects"))


@query("""WITH f AS (SELECT o_orderkey, o_orderdate AS fire, CASE o_orderpriority WHEN '1-URGENT' THEN 'year_in_review' WHEN '2-HIGH' THEN 'monthly_highlights' WHEN '3-MEDIUM' THEN 'on_this_day' WHEN '5-LOW' THEN 'trip' ELSE 'season' END AS kind, CASE WHEN o_orderkey % 10 = 0 THEN 1990 END AS given FROM orders)
SELECT o_orderkey, kind, CAST(coalesce(given, CASE WHEN kind IN ('year_in_review', 'trip') THEN year(fire) - 1 WHEN kind = 'monthly_highlights' THEN year(fire - INTERVAL 1 MONTH) WHEN kind = 'on_this_day' THEN NULL ELSE year(fire) END) AS INTEGER) AS year,
  CAST(CASE WHEN kind = 'monthly_highlights' THEN month(fire - INTERVAL 1 MONTH) END AS INTEGER) AS month, CASE WHEN kind = 'on_this_day' THEN CAST(fire AS DATE) END AS target FROM f""")
def schedule_params(spark, d):
    """What a schedule leaves open, by its kind and the time it fires; given values stay."""
    kinds = {"1-URGENT": "year_in_review", "2-HIGH": "monthly_highlights", "3-MEDIUM": "on_this_day", "5-LOW": "trip"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("o_orderpriority")], F.lit("season"))
    f = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("fire"), kind.alias("kind"), F.when(F.col("o_orderkey") % 10 == 0, 1990).alias("given"))
    year, month, target = calendar.schedule_dates(F.col("kind"), F.col("fire"))
    return f.select("o_orderkey", "kind", F.coalesce("given", year).alias("year"), month.alias("month"), target.alias("target"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 20.0::DOUBLE + l_quantity AS len, l_quantity * 0.5 AS s, l_quantity * 0.5 + l_linenumber * 8 AS e FROM lineitem),
w AS (SELECT *, least(len, greatest((s + e) / 2 + 15, 30)) AS hi FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN e - s >= 30 THEN s WHEN len <= 30 THEN 0 ELSE hi - 30 END AS "from", CASE WHEN e - s >= 30 THEN e WHEN len <= 30 THEN len ELSE hi END AS "to" FROM w""")
def transcription_windows(spark, d):
    """The half minute of audio around a segment, slid into the file."""
    s, e = F.col("l_quantity") * 0.5, F.col("l_quantity") * 0.5 + F.col("l_linenumber") * 8
    window = calendar.slid_window(20.0 + F.col("l_quantity"), s, e, 30.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", window).select("l_orderkey", "l_linenumber", "window.from", "window.to")
