"""Registered queries on presets, candidate segments and their edges, timelines, budgets and whole selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import boundaries
from mosaiq.operators import folds, intervals, ranking, selection
from mosaiq.plans.adapters import ASSETS_SQL, assets, table
from mosaiq.plans.catalogue import query

# --- presets

#: Per kind of story its length in seconds and the weights of faces, motion, stability, audio, content and duration.
PRESETS = (
    ("year_in_review", 600, 0.4, 0.25, 0.2, 0.15, 0.0, 0.15),
    ("season", 135, 0.4, 0.35, 0.2, 0.15, 0.0, 0.15),
    ("person_spotlight", 120, 0.6, 0.15, 0.2, 0.15, 0.0, 0.15),
    ("multi_person", 300, 0.5, 0.2, 0.2, 0.15, 0.0, 0.15),
    ("monthly_highlights", 60, 0.4, 0.25, 0.2, 0.15, 0.0, 0.15),
    ("on_this_day", 45, 0.4, 0.25, 0.2, 0.15, 0.0, 0.15),
    ("trip", None, 0.2, 0.3, 0.1, 0.0, 0.3, 0.1),
    ("holiday", 60, 0.3, 0.25, 0.2, 0.15, 0.3, 0.15),
    ("then_and_now", 45, 0.4, 0.25, 0.2, 0.15, 0.3, 0.15),
)
WEIGHTS = ("face", "motion", "stability", "audio", "content", "duration")


def presets(spark) -> DataFrame:
    """The presets as a table: kind, seconds (null: by the trip's days) and a weight a column."""
    return spark.createDataFrame(PRESETS, "kind string, seconds int, " + ", ".join(f"{w} double" for w in WEIGHTS))


PRESET_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in p) + ")" for p in PRESETS)


@query(f"""WITH p(kind, seconds, face, motion, stability, audio, content, duration) AS (VALUES {PRESET_ROWS}), n AS (SELECT *, row_number() OVER (ORDER BY kind) - 1 AS k FROM p)
SELECT o_orderkey, kind, CAST(coalesce(seconds, least(300, greatest(60, 30 + 10 * (o_orderkey % 40)))) AS INTEGER) AS seconds, round((face * (o_orderkey % 7) + motion * (o_orderkey % 5) + stability * (o_orderkey % 3) + audio + content * (o_orderkey % 2) + duration * 2) / (face + motion + stability + audio + content + duration), 6) AS score
FROM orders JOIN n ON k = o_custkey % 9""")
def preset_scores(spark, d):
    """Segments scored by the weights of a story's preset, which sum to one after they are normalised, and the story's length."""
    k = F.row_number().over(Window.orderBy("kind")) - 1  # nine rows
    numbered = F.broadcast(presets(spark).withColumn("k", k))
    o, c = table(spark, d, "orders"), F.col
    values = {"face": c("o_orderkey") % 7, "motion": c("o_orderkey") % 5, "stability": c("o_orderkey") % 3, "audio": F.lit(1), "content": c("o_orderkey") % 2, "duration": F.lit(2)}
    score = sum(c(w) * v for w, v in values.items()) / sum(c(w) for w in WEIGHTS)
    by_days = F.least(F.lit(300), F.greatest(F.lit(60), 30 + 10 * (c("o_orderkey") % 40)))
    return o.join(numbered, c("o_custkey") % 9 == c("k")).select("o_orderkey", "kind", F.coalesce("seconds", by_days).cast("int").alias("seconds"), F.round(score, 6).alias("score"))


# --- candidate segments

POINTS = """p AS (SELECT l_orderkey AS video, l_quantity AS t, bool_or(l_linenumber % 3 = 0) AS audio FROM lineitem GROUP BY 1, 2),
c AS (SELECT a.video, a.t AS s, b.t AS e, CASE WHEN a.audio AND b.audio THEN 1 WHEN a.audio OR b.audio THEN 2 ELSE 3 END AS kind FROM p a JOIN p b ON a.video = b.video AND b.t - a.t BETWEEN 2 AND 15)"""


@query(f"""WITH {POINTS}, m AS (SELECT video, min(kind) AS kind FROM c GROUP BY 1)
SELECT c.video, s AS "start", e AS "end", c.kind FROM c JOIN m USING (video) WHERE c.kind = m.kind OR (m.kind = 2 AND c.kind = 2) QUALIFY c.kind <> 2 OR row_number() OVER (PARTITION BY c.video ORDER BY abs(e - s - 5), s, e) <= 20""")
def candidate_segments(spark, d):
    """Segments between cut points: between audio points where a source has any, else with one audio edge (the best 20), else between any."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_quantity").alias("t")).agg(F.bool_or(F.col("l_linenumber") % 3 == 0).alias("audio"))
    return intervals.by_precedence(intervals.between_points(p, "t", "audio", ["video"], 2, 15), ["video"], 5, 20).select("video", "start", "end", "kind")


GAPS = """g AS (SELECT l_orderkey AS video, l_quantity AS s, l_quantity + 0.1 + l_discount * 20 AS e FROM lineitem),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY s, e) AS n FROM (SELECT *, max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)),
u AS (SELECT video, min(s) AS s, max(e) AS e FROM i GROUP BY video, n), gaps AS (SELECT video, list(struct_pack(s := s, e := e) ORDER BY s) AS gaps FROM u GROUP BY video)"""


def sql_middles(low: str, high: str) -> str:
    clipped = f"list_transform(gaps, lambda g: struct_pack(s := greatest(g.s, {low}), e := least(g.e, {high})))"
    return f"list_transform(list_filter({clipped}, lambda g: g.e > g.s AND g.e - g.s >= 0.3), lambda g: struct_pack(w := g.e - g.s, t := (g.s + g.e) / 2))"


def sql_widest(found: str, target: str, reach: str) -> str:
    return f"list_min(list_transform(list_filter({found}, lambda m: abs(m.t - ({target})) <= {reach}), lambda m, k: struct_pack(w := -m.w, k := k, t := m.t))).t"


def sql_options(target: str, later: bool) -> str:
    ahead = sql_widest(sql_middles(target, f"{target} + 2.0"), target, "2.0")
    behind = sql_widest(sql_middles(f"{target} - 2.0", target), target, "2.0")
    stays = f"CASE WHEN list_bool_or(list_transform(gaps, lambda g: g.s + 0.15 <= {target} AND {target} <= g.e - 0.15)) THEN {target} END"
    escape = f"CASE WHEN NOT list_bool_or(list_transform(gaps, lambda g: g.s <= {target} AND {target} <= g.e)) THEN list_min(list_transform(gaps, lambda g, k: struct_pack(d := abs((g.s + g.e) / 2 - {target}), k := k, t := (g.s + g.e) / 2))).t END"
    return f"list_filter([{stays}, {', '.join((ahead, behind) if later else (behind, ahead))}, {escape}], lambda x: x IS NOT NULL)"


# options that equal an earlier one are left out, in order
UNIQUE = "list_filter({o}, lambda x, i: list_position({o}, x) = i)"


@query(f"""WITH {GAPS}, x AS (SELECT l_orderkey AS video, l_linenumber AS k, l_quantity * 0.8 + l_linenumber AS s, l_quantity * 0.8 + l_linenumber * 3 + 4 AS e, 60.0::DOUBLE AS len FROM lineitem),
j AS (SELECT x.*, gaps FROM x JOIN gaps USING (video)), o AS (SELECT *, {sql_options("j.s", True)} AS so, {sql_options("j.e", False)} AS eo FROM j),
q AS (SELECT * REPLACE ({UNIQUE.format(o="so")} AS so, {UNIQUE.format(o="eo")} AS eo) FROM o),
r AS (SELECT *, CASE WHEN len(so) = 0 THEN [s] ELSE so END AS ss, CASE WHEN len(eo) = 0 THEN [e] ELSE eo END AS ee FROM q),
b AS (SELECT *, list_min(list_filter(flatten(list_transform(ss, lambda a, m: list_transform(ee, lambda z, n: struct_pack(rank := m + n, span := least(len, z) - greatest(0, a), s := greatest(0, a), e := least(len, z))))), lambda p: p.span >= 2.0)) AS best FROM r),
m AS (SELECT *, CASE WHEN best IS NOT NULL AND len(so) + len(eo) > 0 THEN best.s ELSE s END AS ms, CASE WHEN best IS NOT NULL AND len(so) + len(eo) > 0 THEN best.e ELSE e END AS me FROM b),
f AS (SELECT *, {sql_middles("ms + 2.0", "ms + 8.0")} AS mids FROM m),
z AS (SELECT *, CASE WHEN me - ms > 8.0 THEN coalesce({sql_widest("mids", "ms + 8.0", "2.0")}, {sql_widest("mids", "ms + 8.0", "6.0")}, ms + 8.0) ELSE me END AS last FROM f)
SELECT video, k, CAST(len(so) AS INTEGER) AS start_options, CAST(len(eo) AS INTEGER) AS end_options, round(CASE WHEN last - ms >= 2.0 THEN ms WHEN last - ms > 0 THEN s END, 4) AS "start", round(CASE WHEN last - ms >= 2.0 THEN last WHEN last - ms > 0 THEN e END, 4) AS "end" FROM z""")
def audio_safe_segments(spark, d):
    """Candidates whose edges are moved into silences, with a most of 8 seconds, and how many placements each edge had."""
    lines = table(spark, d, "lineitem")
    gaps = lines.select(F.col("l_orderkey").alias("video"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + 0.1 + F.col("l_discount") * 20).alias("e"))
    merged = intervals.merged(gaps, "s", "e", ["video"]).groupBy("video").agg(F.array_sort(F.array_agg(F.struct("start", "end"))).alias("gaps"))
    x = lines.select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("k"), (F.col("l_quantity") * 0.8 + F.col("l_linenumber")).alias("s"), (F.col("l_quantity") * 0.8 + F.col("l_linenumber") * 3 + 4).alias("e"))
    g, s, e = F.col("gaps"), F.col("s"), F.col("e")
    placements = F.transform(F.array(F.lit(0)), lambda _: boundaries.options_of(g, s, e))[0]  # one expression, so that both uses share it
    found = x.join(merged, "video").withColumn("o", placements).withColumn("a", boundaries.adjusted(g, s, e, F.lit(60.0), 2.0, F.lit(8.0), F.col("o")))
    counts = [F.size(f"o.{side}").alias(name) for side, name in (("first", "start_options"), ("last", "end_options"))]
    return found.select("video", "k", *counts, F.round("a.start", 4).alias("start"), F.round("a.end", 4).alias("end"))


# --- timelines


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT owner, sum(duration) AS content, count(*) AS clips, count(DISTINCT CAST(taken_at AS DATE)) - 1 AS eligible, owner % 3 = 0 AS trip FROM a WHERE score > 60 GROUP BY 1),
p AS (SELECT *, 60.0::DOUBLE AS target, 3.5::DOUBLE + 4.0 AS ends, CASE WHEN trip THEN least(eligible, CAST(floor(greatest(0, 60 * 0.2 - 7.5) / 0.5) AS BIGINT)) ELSE eligible END AS asked FROM t),
q AS (SELECT *, greatest(64.0::DOUBLE, target + eligible * 0.5) AS soft, (clips + 2 + asked - 1) * 0.5 * 0.7 AS overlap FROM p),
r AS (SELECT *, CASE WHEN trip THEN asked WHEN content + ends + eligible * 0.5 - overlap <= soft THEN eligible ELSE 0 END AS chosen FROM q)
SELECT owner, CASE WHEN trip THEN 'capped' WHEN chosen = eligible AND content + ends + eligible * 0.5 - overlap <= soft THEN 'all' ELSE 'none' END AS policy, CAST(chosen AS BIGINT) AS dividers, round(ends + chosen * 0.5, 4) AS title_budget,
  round(greatest(0, target - ends - chosen * 0.5) + (clips + 2 + chosen - 1) * 0.5 * 0.7, 4) AS content_budget, round(CASE WHEN trip THEN target + chosen * 0.5 ELSE soft END, 4) AS soft_max FROM r""")
def finalized_timeline(spark, d):
    """After a selection: for trips as many dividers as a fifth of the target takes, else all of them or none; fades give time back."""
    t = assets(spark, d).where("score > 60").groupBy("owner").agg(F.sum("duration").alias("content"), F.count(F.lit(1)).alias("clips"), (F.countDistinct(F.to_date("taken_at")) - 1).alias("eligible"))
    return selection.finalized(t.withColumn("trip", F.col("owner") % 3 == 0), 60.0, 3.5, 4.0, 0.5, 64.0).select("owner", "policy", "dividers", "title_budget", "content_budget", "soft_max")


# --- budgets

SPREAD = """{name} AS (SELECT owner, [asset_id] AS ids, [t] AS times, budget - duration AS rest, 1 AS place, asset_id FROM {source} WHERE duration <= budget QUALIFY row_number() OVER (PARTITION BY owner ORDER BY favorite DESC, score DESC, asset_id) = 1
  UNION ALL SELECT f.owner, list_append(f.ids, d.asset_id), list_append(f.times, d.t), f.rest - d.duration, f.place + 1, d.asset_id FROM {name} f JOIN {source} d ON d.owner = f.owner AND d.duration <= f.rest AND NOT list_contains(f.ids, d.asset_id)
  QUALIFY row_number() OVER (PARTITION BY d.owner ORDER BY round_even(list_min(list_transform(f.times, lambda x: abs(x - d.t))) / 86400, 0) DESC, d.favorite DESC, d.score DESC, d.asset_id) = 1)"""


@query(f"""WITH RECURSIVE {ASSETS_SQL}, k AS (SELECT *, epoch_us(taken_at) / 1e6 AS t FROM a WHERE score > 40 AND (owner % 2 = 0 OR day(taken_at) <= 20)),
w AS (SELECT *, bool_or(favorite) OVER (PARTITION BY owner) AND bool_or(NOT favorite) OVER (PARTITION BY owner) AS mixed, floor((max(t) OVER (PARTITION BY owner) - min(t) OVER (PARTITION BY owner)) / 86400) AS span FROM k),
one AS (SELECT *, 80.0 * CASE WHEN mixed AND span > 14 THEN 0.7 ELSE 1.0 END::DOUBLE AS budget FROM w WHERE favorite OR NOT mixed), {SPREAD.format(name="f1", source="one")},
spent AS (SELECT owner, sum(duration) AS s FROM f1 JOIN k USING (owner, asset_id) GROUP BY 1), two AS (SELECT w.*, 80.0::DOUBLE - coalesce(s, 0) AS budget FROM w LEFT JOIN spent USING (owner) WHERE mixed AND NOT favorite), {SPREAD.format(name="f2", source="two")}
SELECT owner, asset_id FROM f1 UNION ALL SELECT owner, asset_id FROM f2""")
def protected_overflow(spark, d):
    """What is protected but doesn't fit: favorites first, with 70 % of the time where it spans more than two weeks, then the rest."""
    a = assets(spark, d).where("score > 40 and (owner % 2 = 0 or day(taken_at) <= 20)")
    return selection.fitted_protected(a, ["owner"], "taken_at", "duration", "favorite", "score", "asset_id", 80.0, 14).select("owner", "asset_id")


@query(f"""WITH RECURSIVE {ASSETS_SQL}, v AS (SELECT owner, count(*) AS videos, sum(duration) AS seconds FROM a WHERE kind = 'view' AND score > 30 GROUP BY 1),
p AS (SELECT a.*, CAST(taken_at AS DATE) AS day, row_number() OVER (PARTITION BY owner, CAST(taken_at AS DATE) ORDER BY score DESC, asset_id) AS nth FROM a WHERE kind <> 'view'),
t AS (SELECT *, 1 AS round FROM p WHERE nth = 1 UNION ALL SELECT *, 2 FROM p WHERE nth = 2 UNION ALL SELECT *, 3 FROM p),
o AS (SELECT owner, asset_id, duration, day, round, row_number() OVER (PARTITION BY owner ORDER BY round, CASE WHEN round < 3 THEN day END, CASE WHEN round = 3 THEN -score END, asset_id) AS k FROM t),
f AS (SELECT owner, 0::BIGINT AS k, coalesce(videos, 0) AS videos, greatest(0, 150.0 - coalesce(seconds, 0)) AS room, coalesce(seconds, 0) < 75 AS scarce, 0.0::DOUBLE AS used, []::STRUCT(id BIGINT, day DATE)[] AS held FROM (SELECT DISTINCT owner FROM o) LEFT JOIN v USING (owner)
  UNION ALL SELECT owner, k, videos, room, scarce, CASE WHEN adds THEN used + duration ELSE used END, CASE WHEN adds THEN list_append(held, struct_pack(id := asset_id, day := day)) ELSE held END
  FROM (SELECT o.*, f.videos, f.room, f.scarce, f.used, f.held, len(list_filter(f.held, lambda h: h.id = o.asset_id)) = 0 AND f.used + o.duration <= f.room AND (f.videos = 0 OR f.scarce OR (len(f.held) + 1) / (f.videos + len(f.held) + 1) <= 0.5)
    AND (o.round < 3 OR len(list_filter(f.held, lambda h: h.day = o.day)) < 2) AS adds FROM f JOIN o ON o.owner = f.owner AND o.k = f.k + 1)),
e AS (SELECT owner, unnest(held) AS h FROM f QUALIFY k = max(k) OVER (PARTITION BY owner))
SELECT owner, h.id AS asset_id FROM e""")
def budget_photo_rounds(spark, d):
    """Photos that fill what videos leave of a budget: the best of each day, the second best, then by score, two a day and half of all at most."""
    a = assets(spark, d)
    videos = a.where("kind = 'view' and score > 30").groupBy("owner").agg(F.count(F.lit(1)).alias("videos"), F.sum("duration").alias("seconds"))
    photos = a.where("kind <> 'view'").join(videos, "owner", "left").withColumn("day", F.to_date("taken_at"))
    known = photos.withColumn("videos", F.coalesce("videos", F.lit(0))).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    return selection.photo_rounds(known, ["owner"], "day", "duration", "score", "asset_id", "videos", "seconds", 150.0)


# --- whole selections

STARRED = """w AS (SELECT *, strftime(taken_at, '%Y-W%W') AS week, CAST(taken_at AS DATE) AS day FROM {source}), fw AS (SELECT owner, week, count(*) AS n FROM w WHERE favorite GROUP BY 1, 2),
fp AS (SELECT owner, week, n >= 1.5 * avg(n) OVER (PARTITION BY owner) OR week = min(week) OVER (PARTITION BY owner) OR week = max(week) OVER (PARTITION BY owner) AS held FROM fw),
fm AS (SELECT w.*, NOT held AND row_number() OVER (PARTITION BY w.owner, held, week ORDER BY score DESC, asset_id DESC) > 1 AS free FROM w JOIN fp USING (owner, week) WHERE favorite),
fg AS (SELECT *, sum(duration) OVER (PARTITION BY owner) - coalesce(sum(CASE WHEN free THEN duration ELSE 0 END) OVER (PARTITION BY owner ORDER BY score, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM fm),
s1 AS (SELECT owner, asset_id, week, 'favorite' AS reason FROM fg WHERE NOT free OR rest <= {count} * 5 * 1.25), span AS (SELECT owner, min(taken_at) AS lo, max(taken_at) AS hi FROM w WHERE favorite GROUP BY 1),
wk AS (SELECT DISTINCT owner, strftime(lo + INTERVAL 7 DAY * i, '%Y-W%W') AS week FROM (SELECT *, unnest(range(CAST(floor(epoch(hi - lo) / 604800) AS BIGINT) + 1)) AS i FROM span)),
s2 AS (SELECT w.owner, asset_id, w.week, 'week' AS reason FROM w JOIN wk USING (owner, week) WHERE NOT favorite AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.owner = w.owner AND s1.week = w.week) QUALIFY row_number() OVER (PARTITION BY w.owner, w.week ORDER BY score DESC, asset_id) <= 2),
s12 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), nw AS (SELECT owner, week, count(*) AS n FROM s12 GROUP BY 1, 2), no AS (SELECT owner, count(*) AS n FROM s12 GROUP BY 1),
s3 AS (SELECT w.owner, asset_id, w.week, 'slot' AS reason FROM w LEFT JOIN nw ON nw.owner = w.owner AND nw.week = w.week LEFT JOIN no ON no.owner = w.owner WHERE NOT favorite AND asset_id NOT IN (SELECT asset_id FROM s2)
  QUALIFY row_number() OVER (PARTITION BY w.owner ORDER BY round(score / {unit} - 0.1 * coalesce(nw.n, 0), 6) DESC, asset_id) <= {count} - coalesce(no.n, 0)),
s123 AS (SELECT * FROM s12 UNION ALL SELECT * FROM s3)"""
FIRST = STARRED + """,
s4 AS (SELECT w.owner, asset_id, w.week, 'coverage' AS reason FROM w WHERE asset_id NOT IN (SELECT asset_id FROM s123) AND NOT EXISTS (SELECT 1 FROM s123 JOIN w x USING (asset_id) WHERE x.owner = w.owner AND x.day = w.day) QUALIFY row_number() OVER (PARTITION BY w.owner, w.day ORDER BY score DESC, asset_id) = 1),
chosen AS (SELECT owner, asset_id, reason FROM s123 UNION ALL SELECT owner, asset_id, reason FROM s4)"""


@query(f"""WITH {ASSETS_SQL}, {FIRST.format(source="a", count=20, unit=100)} SELECT * FROM chosen""")
def favorites_first(spark, d):
    """Favorites as far as they fit, weeks without any, remaining places spread over weeks, and a row for each day without one."""
    a = assets(spark, d)
    return selection.favorites_first(a, ["owner"], "taken_at", F.to_date("taken_at"), "duration", "favorite", "score", "asset_id", 20)


@query(f"""WITH {ASSETS_SQL}, n AS (SELECT owner, score, row_number() OVER (PARTITION BY owner ORDER BY asset_id) AS k, count(*) OVER (PARTITION BY owner) AS n FROM a), o AS (SELECT owner, k, n, greatest(score - coalesce(lag(score) OVER (PARTITION BY owner ORDER BY k), score), 0) AS up FROM n),
c AS (SELECT owner, k, n, up - avg(up) OVER (PARTITION BY owner) AS x, max(up) OVER (PARTITION BY owner) AS top FROM o), l AS (SELECT unnest(range(2, 40)) AS lag),
s AS (SELECT y.owner, lag, round(sum(y.x * z.x), 6) AS s FROM c y JOIN l ON lag < least(40, y.n - 1) JOIN c z ON z.owner = y.owner AND z.k = y.k - lag WHERE y.top > 0 GROUP BY 1, 2),
b AS (SELECT owner, round(600.0 / arg_min(lag, (-s, lag)), 1) AS bpm FROM s GROUP BY 1) SELECT owner, bpm FROM (SELECT DISTINCT owner FROM a) LEFT JOIN b USING (owner)""")
def onset_tempo(spark, d):
    """Beats a minute of each owner's values as an energy curve, by the best lag of the rises' correlation with themselves."""
    a = assets(spark, d).groupBy("owner").agg(F.transform(F.array_sort(F.array_agg(F.struct("asset_id", "score"))), lambda r: r["score"]).alias("energy"))
    return a.select("owner", folds.tempo(F.col("energy")).alias("bpm"))

