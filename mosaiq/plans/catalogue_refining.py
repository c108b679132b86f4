"""Registered queries on whole selections: spread over periods or stops, backfill, refinement and review until stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import geo
from mosaiq.operators import folds, ranking, refining, selection
from mosaiq.plans import fold_sql, refining_sql
from mosaiq.plans.adapters import ASSETS_SQL, HOME, assets
from mosaiq.plans.catalogue import query

NAMES = refining.Names(["owner"])
PLACE = "SELECT f.owner, f.asset_id, f.tier, CAST(row_number() OVER (PARTITION BY f.owner ORDER BY raw.taken_at, f.asset_id) AS INTEGER) AS place FROM filled f JOIN raw USING (owner, asset_id)"


def pool(df: DataFrame) -> DataFrame:
    """The selections' columns from assets: photos are views, people stand on tagged rows, scores go to about one."""
    return df.select("owner", "asset_id", "taken_at", "duration", "favorite", (F.col("kind") == "view").alias("photo"), F.col("tagged").alias("people"), (F.col("score") / 100).alias("score"))


def stretched(spark, d) -> DataFrame:
    """Pools over a month, three, ten and twenty months, by owner; every third owner has no favorites."""
    times = F.get(F.array(*[F.lit(k) for k in (0, 2, 9, 19)]), (F.col("owner") % 4).cast("int"))
    begun = F.expr("cast('2024-01-01' as timestamp_ntz)")
    a = pool(assets(spark, d)).withColumn("favorite", F.col("favorite") & (F.col("owner") % 3 > 0))
    return a.withColumn("taken_at", F.col("taken_at") + (F.col("taken_at") - begun) * times)


@query(f"""WITH RECURSIVE {refining_sql.STRETCHED_SQL}, src AS (SELECT *, favorite AND score > 0.6 AS chosen, owner % 5 = 0 AS scarce FROM raw), {refining_sql.backfilled("src", 12, 90.0, 300.0, 0.7, 0.5)} SELECT owner, asset_id, tier FROM filled""")
def backfill_relaxation(spark, d):
    """Selections filled up to a time: every pick starts from the strict limits and concedes as little as admits a row."""
    src = stretched(spark, d).withColumns({"chosen": F.col("favorite") & (F.col("score") > 0.6), "scarce": F.col("owner") % 5 == 0})
    return refining.backfilled(src, NAMES, "chosen", refining.Wishes(12, 90.0, moment_s=300.0), "scarce").select("owner", "asset_id", "tier")


@query(f"""WITH {refining_sql.STRETCHED_SQL}, {refining_sql.CAPPED} SELECT owner, asset_id FROM pool""")
def photos_a_day(spark, d):
    """The best two photos of each day, six on days that stand out, and all videos."""
    return refining.capped_photos(stretched(spark, d), NAMES).select("owner", "asset_id")


@query(f"""WITH {refining_sql.STRETCHED_SQL}, {refining_sql.distributed(14, "raw")} SELECT * FROM chosen""")
def distributed_selection(spark, d):
    """Rows spread over days, weeks, months or quarters: from the favorites, or from the densest periods where there are none."""
    raw = stretched(spark, d)
    return refining.distributed(raw, NAMES, 14, refining.events_of(refining.with_periods(raw, NAMES), NAMES))


@query(f"""WITH RECURSIVE {refining_sql.STRETCHED_SQL}, {refining_sql.refined(refining_sql.distributed(14), 12, 60.0, 600.0, 0.7, 0.3)} {PLACE}""")
def refined_selection(spark, d):
    """A whole selection: photos a day, spread over periods, fitted to the time, one a moment, the shares of others and of photos, and backfill."""
    return refining.refined(stretched(spark, d), NAMES, refining.Wishes(12, 60.0, photos=0.3))


#: The trips' rows (away from home) and their stops.
TRIPS_SQL = f"""{fold_sql.OVERNIGHT[: fold_sql.OVERNIGHT.rindex("SELECT owner")].rstrip()},
raw AS (SELECT owner, asset_id, taken_at, duration, favorite, kind = 'view' AS photo, tagged AS people, score / 100 AS score, epoch_us(taken_at) / 1e6 AS t FROM w)"""


def trips_and_stops(spark, d) -> tuple[DataFrame, DataFrame]:
    away = assets(spark, d).where(geo.away(F.col("lat"), F.col("lon"), HOME, 50.0))
    return pool(away), folds.overnight_stops(away, "taken_at", "lat", "lon", ["owner"], "asset_id", 2.0)


@query(f"""{TRIPS_SQL}, pool AS (SELECT * FROM raw), {refining_sql.by_stops(14)} SELECT c.owner, c.asset_id, CAST(tg.stop AS INTEGER) AS stop, tg.places FROM chosen c JOIN tg USING (owner, asset_id)""")
def trip_stop_selection(spark, d):
    """The best rows of each overnight stop; its places follow from its nights."""
    rows, stops = trips_and_stops(spark, d)
    places = refining.places_by_nights(stops, ["owner"], "stop", "nights", 14).select("owner", "stop", "places")
    placed = refining.at_stops(rows, stops, NAMES, "stop", "start_date", "end_date")
    chosen = refining.by_stops(rows, stops, NAMES, 14)
    return placed.join(chosen.select("owner", "asset_id"), ["owner", "asset_id"]).join(places, ["owner", "stop"]).select("owner", "asset_id", "stop", "places")


@query(f"""{TRIPS_SQL}, {refining_sql.refined(refining_sql.by_stops(14), 12, 60.0, 600.0, 0.7, 0.3)} {PLACE}""")
def refined_trips(spark, d):
    """A whole selection of each trip, with its overnight stops in place of periods."""
    rows, stops = trips_and_stops(spark, d)
    return refining.refined(rows, NAMES, refining.Wishes(12, 60.0, photos=0.3), stops)


#: A step is a look at what is new in the best twelve rows, or a judgement of them.
REVIEWED = f"""WITH RECURSIVE {ASSETS_SQL}, v AS (SELECT owner, asset_id, epoch_us(taken_at) AS t, favorite, score / 100 AS real, asset_id % 3 = 0 AS seen, CASE WHEN asset_id % 3 = 0 THEN score / 100 ELSE 0.55 END AS s FROM a),
f AS (SELECT owner, list(struct_pack(id := asset_id, t := t, fav := favorite, real := real, seen := seen, s := s)) AS rows, 0 AS judged, 0 AS looked, false AS final, false AS done, []::BIGINT[] AS ids FROM v GROUP BY owner
  UNION ALL SELECT owner, CASE WHEN look THEN list_transform(rows, lambda r: CASE WHEN list_contains(top_ids, r.id) AND NOT r.seen THEN struct_pack(id := r.id, t := r.t, fav := r.fav, real := r.real, seen := true, s := r.real) ELSE r END)
      WHEN drops THEN list_filter(rows, lambda r: NOT list_contains(bad, r.id)) ELSE rows END, judged + drops::INT, CASE WHEN look THEN looked + 1 ELSE 0 END, drops AND judged + 1 >= 10, NOT look AND NOT drops, top_ids
  FROM (SELECT *, NOT final AND NOT look AND len(top_ids) >= 2 AND len(bad) > 0 AND len(bad) < len(rows) AS drops
    FROM (SELECT *, NOT final AND looked < 10 AND len(list_filter(top, lambda r: NOT r.seen)) > 0 AS look, list_transform(top, lambda r: r.id) AS top_ids,
        list_transform(list_filter(top, lambda r: NOT r.fav AND (r.s < 0.3 OR (len(top) > 2 AND r.t = ending.t AND r.id = ending.id AND r.s = lo AND r.s < 0.6 * mean))), lambda r: r.id) AS bad
      FROM (SELECT *, list_max(list_transform(top, lambda r: struct_pack(t := r.t, id := r.id))) AS ending, list_min(list_transform(top, lambda r: r.s)) AS lo, list_avg(list_transform(top, lambda r: r.s)) AS mean
        FROM (SELECT *, list_transform(list_sort(list_transform(rows, lambda r: struct_pack(k := -r.s, id := r.id, r := r)))[1:12], lambda x: x.r) AS top FROM f WHERE NOT done)))))
SELECT owner, unnest(ids) AS asset_id FROM f WHERE done"""


@query(REVIEWED)
def review_until_stable(spark, d):
    """The best twelve rows of each owner after what is new among them was looked at, and what fails was dropped and replaced, until nothing changes."""
    a = assets(spark, d).withColumns({"real": F.col("score") / 100, "seen": F.col("asset_id") % 3 == 0})
    known = a.withColumn("score", F.when(F.col("seen"), F.col("real")).otherwise(0.55))
    return refining.reviewed(known, NAMES, lambda pool: ranking.top_per(pool, ["owner"], [F.desc("score"), F.col("asset_id")], 12), "seen", "real")


def quality():
    return [F.desc(F.col("width") * F.col("height")), F.desc("bitrate"), F.desc("duration")]


@query(fold_sql.SMART_SELECT)
def smart_select(spark, d):
    """Forty rows spread over days, favorites first, at most 70 % others, in order of time."""
    return selection.smart(assets(spark, d), ["owner"], "taken_at", "favorite", quality(), "asset_id", 40, others=0.7).select("owner", "asset_id", "place")


@query(fold_sql.SMART_SELECT_HDR)
def smart_select_hdr(spark, d):
    """The same among rows of one kind only, whether favorites or not."""
    return selection.smart(assets(spark, d), ["owner"], "taken_at", "favorite", quality(), "asset_id", 40, F.col("tagged"), favorites=False).select("owner", "asset_id", "place")
