"""Registered queries on hashes of edits, broken answers, orders of moments and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import labels, ranges, scores, text
from mosaiq.operators import ranking
from mosaiq.operators.checkpoints import shared_dir
from mosaiq.plans.adapters import ASSETS_SQL, assets, table
from mosaiq.plans.catalogue import query
from mosaiq.sources import library


@query(f"""WITH {ASSETS_SQL}, c AS (SELECT owner, CASE WHEN owner % 5 > 0 THEN 'trip "' || owner || '"' END AS kind, min(CAST(taken_at AS DATE)) AS lo, max(CAST(taken_at AS DATE)) AS hi,
  string_agg('["' || asset_id || '",' || CAST(round(asset_id % 7 / 3.0::DOUBLE, 2) AS VARCHAR) || ',' || CAST(round(asset_id % 7 / 3.0::DOUBLE + duration, 2) AS VARCHAR) || ']', ',' ORDER BY taken_at, asset_id) AS clips FROM a WHERE score > 60 GROUP BY 1)
SELECT owner, left(sha256('{{"clips":[' || clips || '],"date_end":"' || hi || '","date_start":"' || lo || '","extras":{{"music":"' || owner % 2 || '","style":"wide"}},"memory_type":"' || coalesce(replace(kind, '"', '\\"'), '') || '","target_duration":60.0}}'), 8) AS recipe FROM c""")
def recipe_hashes(spark, d):
    """A short hash of each owner's edit: its clips in order, its range, length and settings."""
    a = assets(spark, d).where("score > 60").withColumn("from", F.col("asset_id") % 7 / 3.0)
    clip = F.struct("taken_at", "asset_id", F.col("asset_id").cast("string").alias("id"), F.col("from").alias("start"), (F.col("from") + F.col("duration")).alias("end"))
    edits = a.groupBy("owner").agg(F.min("taken_at").cast("date").alias("lo"), F.max("taken_at").cast("date").alias("hi"), F.array_sort(F.array_agg(clip)).alias("clips"))
    kind = F.when(F.col("owner") % 5 > 0, F.concat(F.lit('trip "'), F.col("owner").cast("string"), F.lit('"')))
    extras = F.create_map(F.lit("style"), F.lit("wide"), F.lit("music"), (F.col("owner") % 2).cast("string"))
    return edits.select("owner", text.recipe_hash(kind, F.col("lo"), F.col("hi"), F.lit(60.0), F.col("clips"), extras).alias("recipe"))


@query(r"""WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 4 > 0 THEN 'a "' || event_type || '" scene' END AS description, CASE k % 3 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN k >= 80 THEN 'joyful' WHEN k >= 60 THEN 'happy' WHEN k >= 40 THEN 'calm' WHEN k >= 20 THEN 'neutral' ELSE 'subdued' END ELSE '' END AS emotion,
  CASE WHEN k % 5 > 0 THEN k / 8.0 END::DOUBLE AS quality, CASE WHEN k % 2 = 0 THEN 'park, bench' END AS subjects, CASE WHEN k % 4 > 0 OR k % 3 < 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM k""")
def partial_extraction(spark, d):
    """What is left of answers whose JSON is broken, with words for emotions that are numbers."""
    k = F.get_json_object("props", "$.k").cast("int")
    emotion = F.when(k % 3 == 0, F.concat(F.lit('"emotion": "'), "event_type", F.lit('",'))).when(k % 3 == 1, F.concat(F.lit('"emotion" : '), (k / 100).cast("string"), F.lit(","))).otherwise("")
    said = F.when(k % 4 > 0, F.concat(F.lit('"description": "a \\"'), "event_type", F.lit('\\" scene", '))).otherwise("")
    quality = F.when(k % 5 > 0, F.concat(F.lit('"quality": '), (k / 8).cast("string"), F.lit(", "))).otherwise("")
    subjects = F.when(k % 2 == 0, F.lit("\"subjects\": [\"park\", '', 'bench'], ")).otherwise("")
    broken = F.concat(F.lit("Here it is: {"), said, emotion, quality, subjects, F.lit('"setting": '))
    p = table(spark, d, "events").select("event_id", text.partial_analysis(broken).alias("p"))
    return p.select("event_id", "p.description", "p.emotion", "p.quality", F.array_join("p.subjects", ", ").alias("subjects"), "p.confidence")


@query(f"""WITH {ASSETS_SQL}, m AS (SELECT owner, asset_id, round(score / 10) AS total, [score % 7 / 7, score % 5 / 5, score % 3 / 3] AS p, day(taken_at) * 10.0::DOUBLE AS lo, duration FROM a),
v AS (SELECT *, round(list_sum(list_transform(p, lambda x: (x - list_sum(p) / 3) * (x - list_sum(p) / 3))) / 3, 9) AS variance, round(abs(lo + duration / 2 - 155) / 155, 9) AS away FROM m)
SELECT owner, asset_id FROM v QUALIFY row_number() OVER (PARTITION BY owner ORDER BY total DESC, variance DESC, away, asset_id) = 1""")
def tie_break_best(spark, d):
    """The best moment of each owner; equal totals go by the variance of their parts, then by the distance from the middle."""
    s, start = F.col("score"), F.dayofmonth("taken_at") * 10.0
    order = scores.moment_order(F.round(s / 10), [s % 7 / 7, s % 5 / 5, s % 3 / 3], start, start + F.col("duration"), F.lit(310.0), F.col("asset_id"))
    return ranking.first_per(assets(spark, d).withColumn("order", order), ["owner"], [F.col("order")]).select("owner", "asset_id")


@query("""SELECT 'kind=' || event_type AS folder, CAST(1 AS BIGINT) AS files, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM events GROUP BY event_type""")
def folder_inventory(spark, d):
    """Files and bytes of each folder of a tree that is written from a table; contents are not read."""
    path = shared_dir(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("line"))
    rows.repartition("kind").write.partitionBy("kind").text(path)
    return library.inventory(spark, path)


SOUNDS = [*labels.SOUND_WEIGHTS, "Doorbell", "Siren"]
SOUNDS_SQL = ", ".join(f"({k}, '{name}', {labels.SOUND_WEIGHTS.get(name, labels.OTHER_SOUND)}::DOUBLE, {str(name in labels.PROTECTED_SOUNDS).lower()})" for k, name in enumerate(SOUNDS))


@query(f"""WITH w(k, kind, weight, protected) AS (VALUES {SOUNDS_SQL}) SELECT l_orderkey AS video, round(sum(weight * l_quantity), 4) AS interest, round(coalesce(sum(CASE WHEN protected THEN l_quantity END), 0), 4) AS protected_seconds, CAST(count(DISTINCT kind) AS BIGINT) AS kinds
FROM lineitem JOIN w ON k = l_partkey % {len(SOUNDS)} GROUP BY 1""")
def event_weights(spark, d):
    """The interest of each video's sounds by their lengths, and how much of them no cut should fall into."""
    kind = F.get(F.array(*[F.lit(s) for s in SOUNDS]), (F.col("l_partkey") % len(SOUNDS)).cast("int"))
    sounds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), kind.alias("kind"), F.col("l_quantity").cast("double").alias("seconds"))
    kept = F.sum(F.when(labels.is_protected(F.col("kind")), F.col("seconds")))
    return sounds.groupBy("video").agg(F.round(F.sum(labels.sound_weight(F.col("kind")) * F.col("seconds")), 4).alias("interest"), F.round(F.coalesce(kept, F.lit(0.0)), 4).alias("protected_seconds"), F.countDistinct("kind").alias("kinds"))


@query(r"""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE k % 3 WHEN 0 THEN 'happy' WHEN 1 THEN 'tender' ELSE 'calm' END AS primary_mood, CASE WHEN k % 2 = 0 THEN 'sad' END AS secondary_mood, CASE WHEN k % 4 = 1 THEN 'high' ELSE 'medium' END AS energy_level,
  CASE WHEN k % 5 = 0 THEN 'ambient' ELSE 'jazz,pop' END AS genres, CASE WHEN k % 7 = 0 THEN 0.7 ELSE greatest(0.0, least(1.0, k / 50.0)) END::DOUBLE AS confidence FROM k""")
def mood_validation(spark, d):
    """Moods from answers in JSON, some in fences, held to the lists of what may be."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda n, *words: F.get(F.array(*[F.lit(w) for w in words]), k % n)
    sure = F.when(k % 7 == 0, F.lit('"much"')).otherwise((k / 50).cast("string"))
    genres = F.when(k % 5 == 0, F.lit('["noise"]')).otherwise(F.lit('[" Jazz", "noise", "POP", "noise", "noise", "rock"]'))
    body = F.concat(F.lit('{"primary_mood": "'), pick(3, " HAPPY ", "tender", "grumpy"), F.lit('", "secondary_mood": "'), pick(2, "Sad", "odd"), F.lit('", "energy_level": "'), pick(4, "x", "High", "", "medium"), F.lit('", "genre_suggestions": '), genres, F.lit(', "confidence": '), sure, F.lit("}"))
    answer = F.when(k % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nthat is it"))).otherwise(body)
    m = table(spark, d, "events").select("event_id", labels.mood(answer).alias("m"))
    return m.select("event_id", "m.primary_mood", "m.secondary_mood", "m.energy_level", F.array_join("m.genres", ",").alias("genres"), "m.confidence")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS p, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 500 AS INTEGER) AS e, ['multi_person', 'trip', 'season', 'monthly_highlights', 'on_this_day', 'custom'][o_orderkey % 6 + 1] AS kind, o_orderkey % 5 AS n FROM orders),
y AS (SELECT *, CASE WHEN month(s) = 1 AND day(s) = 1 AND month(e) = 12 AND day(e) = 31 AND year(s) = year(e) THEN CAST(year(s) AS VARCHAR) WHEN year(s) = year(e) AND month(s) = month(e) THEN lower(strftime(s, '%B')) || '_' || year(s) WHEN year(s) = year(e) THEN lower(strftime(s, '%b')) || '-' || lower(strftime(e, '%b')) || '_' || year(s)
  ELSE strftime(s, '%Y%m%d') || '-' || strftime(e, '%Y%m%d') END AS range FROM x),
z AS (SELECT *, CASE WHEN kind = 'multi_person' AND n > 0 THEN array_to_string(['ann', 'bob', 'cy'][1:n], '_') || CASE WHEN n > 3 THEN '_and_others' ELSE '' END WHEN kind = 'trip' THEN 'trip' WHEN n > 0 THEN 'ann' WHEN p % 2 = 0 THEN 'zoe' ELSE 'everyone' END AS who,
  CASE kind WHEN 'trip' THEN CASE WHEN p % 3 = 0 THEN 'rio_de_janeiro' ELSE range END WHEN 'season' THEN CASE WHEN p % 2 = 0 THEN 'summer_' || year(s) ELSE CAST(year(s) AS VARCHAR) END WHEN 'monthly_highlights' THEN lower(strftime(s, '%B')) || '_' || year(s) WHEN 'on_this_day' THEN lower(strftime(s, '%B')) || '_' || day(s) ELSE range END AS "when" FROM y)
SELECT k AS o_orderkey, who || '_' || "when" || '_memories.mp4' AS name FROM z""")
def file_names(spark, d):
    """Names of files by kind, people, place and range."""
    p, start, k = F.col("o_custkey"), F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("multi_person", "trip", "season", "monthly_highlights", "on_this_day", "custom")]), (k % 6).cast("int"))
    names = F.slice(F.array(*[F.lit(x) for x in ("Ann", "Bob", "Cy", "Di")]), 1, (k % 5).cast("int"))
    name = labels.file_name(kind, names, F.when(p % 2 == 0, "Zoe"), start, F.date_add(start, (p % 500).cast("int")), F.year(start), F.month(start), F.when(p % 2 == 0, "summer"), F.when(p % 3 == 0, " Rio de Janeiro!"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS p, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) END AS m, ['spring', 'Autumn', 'winter', 'summer', 'wet'][o_custkey % 5 + 1] AS season,
  [NULL, NULL, 'season', 'monthly_highlights', 'person_spotlight', 'trip', 'on_this_day'][o_orderkey % 7 + 1] AS given, o_custkey % 4 = 0 AS person, o_custkey % 6 = 0 AS south, o_orderkey % 5 = 0 AS hand, o_orderkey % 11 = 0 AS album FROM orders),
t AS (SELECT *, CASE WHEN given IS NOT NULL OR album THEN given WHEN m IS NOT NULL THEN 'monthly_highlights' WHEN NOT person THEN 'year_in_review' END AS kind, make_date(1992, 2, 29) AS born FROM x),
s AS (SELECT *, CASE WHEN south THEN ['fall', 'spring', 'summer', 'winter', NULL][p % 5 + 1] ELSE ['spring', 'fall', 'winter', 'summer', NULL][p % 5 + 1] END AS northern FROM t),
r AS (SELECT *, CASE northern WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 WHEN 'fall' THEN 9 WHEN 'winter' THEN 12 END AS m1 FROM s),
o AS (SELECT *, CASE WHEN kind = 'season' THEN make_date(y, m1, 1) WHEN m IS NOT NULL THEN make_date(y, m, 1) WHEN kind IS DISTINCT FROM 'monthly_highlights' THEN make_date(y, 1, 1) END AS lo,
  CASE WHEN kind = 'season' THEN last_day(CAST(make_date(y, m1, 1) + INTERVAL 2 MONTH AS DATE)) WHEN m IS NOT NULL THEN last_day(make_date(y, m, 1)) WHEN kind IS DISTINCT FROM 'monthly_highlights' THEN make_date(y, 12, 31) END AS hi FROM r),
b AS (SELECT *, make_date(y, 2, CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END) AS b1, make_date(y + 1, 2, CASE WHEN (y + 1) % 4 = 0 THEN 29 ELSE 28 END) - 1 AS b2 FROM o),
f AS (SELECT k, kind, CASE WHEN kind IS NULL THEN CASE WHEN hand THEN d WHEN person THEN b1 ELSE make_date(y, 1, 1) END WHEN lo IS NOT NULL THEN CASE WHEN hand THEN d WHEN kind = 'person_spotlight' AND person THEN b1 ELSE lo END END AS "start",
  CASE WHEN kind IS NULL THEN CASE WHEN hand THEN CAST(d + INTERVAL 6 MONTH AS DATE) - 1 WHEN person THEN b2 ELSE make_date(y, 12, 31) END WHEN lo IS NOT NULL THEN CASE WHEN hand THEN CAST(d + INTERVAL 6 MONTH AS DATE) - 1 WHEN kind = 'person_spotlight' AND person THEN b2 ELSE hi END END AS "end" FROM b),
g AS (SELECT *, (year("end") - year("start")) * 12 + month("end") - month("start") + 1 AS span FROM f)
SELECT k AS o_orderkey, kind AS memory_type, "start", "end", CASE WHEN kind IN ('monthly_highlights', 'trip') THEN 'none' WHEN kind = 'on_this_day' THEN 'year' WHEN span IS NULL THEN 'month' WHEN span <= 3 THEN 'none' WHEN year("start") <> year("end") THEN 'year' ELSE 'month' END AS dividers FROM g""")
def type_inference(spark, d):
    """What requests mean: the type, the range by its precedence, and the dividers."""
    o, k, p, day = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    pick = lambda by, *words: F.get(F.array(*[F.lit(w).cast("string") for w in words]), by.cast("int"))
    year, month, season = F.year(day), F.when(k % 3 > 0, F.month(day)), pick(p % 5, "spring", "Autumn", "winter", "summer", "wet")
    birthday, album = F.when(p % 4 == 0, "1992-02-29"), F.when(k % 11 == 0, "album")
    given = pick(k % 7, None, None, "season", "monthly_highlights", "person_spotlight", "trip", "on_this_day")
    none = F.lit(None).cast("string")
    kind = ranges.inferred_type(given, year, month, p % 4 == 0, none, none, album)
    days = ranges.resolved(F.col("kind"), year, month, season, birthday, F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")), none, F.lit("6m"), p % 6 == 0)
    r = o.withColumn("kind", kind).withColumn("r", days)
    return r.select("o_orderkey", F.col("kind").alias("memory_type"), "r.start", "r.end", ranges.divider_mode(F.col("kind"), F.col("r.start"), F.col("r.end")).alias("dividers"))
