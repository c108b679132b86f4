"""DuckDB SQL of the queries whose choices depend on earlier ones: recursive tables that take a step a row."""

from __future__ import annotations

from mosaiq.plans.adapters import ASSETS_SQL, HOME

KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def spaced(source: str, least: float) -> str:
    """Of source (owner, at) the times that lie so far after the last one kept."""
    return f"""f AS (SELECT owner, min("at") AS "at" FROM {source} GROUP BY owner
  UNION ALL SELECT f.owner, min(s."at") FROM f JOIN {source} s ON s.owner = f.owner AND s."at" - f."at" >= {least} GROUP BY f.owner)
SELECT owner, "at" FROM f"""


SCENE_CUTS = f"""WITH RECURSIVE {ASSETS_SQL}, c AS (SELECT owner, epoch_us(taken_at) / 1e6 AS "at" FROM a WHERE score > 60), {spaced("c", 3600.0)}"""

BOUNDARY_MERGE = f"""WITH RECURSIVE {ASSETS_SQL}, p AS (SELECT owner, kind, day(taken_at) * 10.0::DOUBLE + duration / 10 AS "at" FROM a), v AS (SELECT owner, "at" FROM p WHERE kind = 'view'),
c AS (SELECT * FROM v UNION ALL SELECT owner, "at" FROM p x WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM v WHERE v.owner = x.owner AND abs(x."at" - v."at") <= 0.2)
  UNION ALL SELECT DISTINCT owner, unnest([0.0::DOUBLE, 400.0::DOUBLE]) FROM v), {spaced("c", 0.3)}"""

SLOTS = """z AS (SELECT owner, CAST(taken_at AS DATE) AS day, count(*) AS n FROM a GROUP BY 1, 2), b AS (SELECT *, greatest(1, 40 // count(*) OVER (PARTITION BY owner)) AS base, avg(n) OVER (PARTITION BY owner) AS mean FROM z),
wish AS (SELECT *, least(CASE WHEN n > 1.5 * mean THEN 2 * base ELSE base END, n) AS w FROM b),
one AS (SELECT *, greatest(0, least(w, 40 - coalesce(sum(w) OVER (PARTITION BY owner ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS s FROM wish),
two AS (SELECT *, 40 - sum(s) OVER (PARTITION BY owner) AS rest, coalesce(sum(n - s) OVER (PARTITION BY owner ORDER BY n DESC, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one),
slots AS (SELECT owner, day, n, CAST(s + greatest(0, least(n - s, rest - before)) AS INTEGER) AS slots FROM two)"""
DAY_SLOTS = f"WITH {ASSETS_SQL}, {SLOTS} SELECT * FROM slots"

BEST = "width * height DESC, bitrate DESC, duration DESC, asset_id"
SMART_SELECT = f"""WITH {ASSETS_SQL}, {SLOTS}, d AS (SELECT a.*, CAST(taken_at AS DATE) AS day FROM a),
picked AS (SELECT d.*, slots FROM d JOIN slots USING (owner, day) QUALIFY row_number() OVER (PARTITION BY d.owner, d.day ORDER BY favorite DESC, {BEST}) <= slots),
sized AS (SELECT *, floor(0.7 * count(*) OVER (PARTITION BY owner)) AS most FROM picked), kept AS (SELECT * FROM sized QUALIFY favorite OR row_number() OVER (PARTITION BY owner, favorite ORDER BY {BEST}) <= most)
SELECT owner, asset_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS INTEGER) AS place FROM kept"""
#: Only rows that hold a condition, favorites like others.
SMART_SELECT_HDR = f"""WITH {ASSETS_SQL.replace("a AS (", "whole AS (", 1)}, a AS (SELECT * FROM whole WHERE tagged), {SLOTS}, d AS (SELECT a.*, CAST(taken_at AS DATE) AS day FROM a),
picked AS (SELECT d.* FROM d JOIN slots USING (owner, day) QUALIFY row_number() OVER (PARTITION BY d.owner, d.day ORDER BY {BEST}) <= slots)
SELECT owner, asset_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS INTEGER) AS place FROM picked"""

FARTHEST = f"""WITH RECURSIVE {ASSETS_SQL}, d AS (SELECT *, epoch_us(taken_at) / 1e6 AS t FROM a),
f AS (SELECT owner, [asset_id] AS ids, [t] AS times, 60.0 - duration AS rest, 1 AS place, asset_id FROM d WHERE duration <= 60 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY favorite DESC, score DESC, asset_id) = 1
  UNION ALL SELECT f.owner, list_append(f.ids, d.asset_id), list_append(f.times, d.t), f.rest - d.duration, f.place + 1, d.asset_id FROM f JOIN d ON d.owner = f.owner AND d.duration <= f.rest AND NOT list_contains(f.ids, d.asset_id)
  QUALIFY row_number() OVER (PARTITION BY d.owner ORDER BY round_even(list_min(list_transform(f.times, lambda x: abs(x - d.t))) / 86400, 0) DESC, d.favorite DESC, d.score DESC, d.asset_id) = 1)
SELECT owner, asset_id, CAST(place AS INTEGER) AS place FROM f"""

INTERLEAVED = f"""WITH RECURSIVE {ASSETS_SQL}, l AS (SELECT owner, list(struct_pack(id := asset_id, kind := kind) ORDER BY taken_at, asset_id) AS rows FROM a GROUP BY owner),
f AS (SELECT owner, rows, 3 AS k FROM l
  UNION ALL SELECT owner, CASE WHEN rows[k].kind = rows[k - 1].kind AND rows[k].kind = rows[k - 2].kind AND j > 0 THEN rows[1:k - 1] || [rows[k + j]] || rows[k:k + j - 1] || rows[k + j + 1:len(rows)] ELSE rows END, k + 1
  FROM (SELECT *, coalesce(list_position(list_transform(rows[k + 1:len(rows)], lambda x: x.kind <> rows[k].kind), true), 0) AS j FROM f WHERE k <= len(rows))),
w AS (SELECT owner, unnest(rows) AS r, unnest(range(len(rows))) AS place FROM f QUALIFY k = max(k) OVER (PARTITION BY owner))
SELECT w.owner, r.id AS asset_id, r.kind AS kind, taken_at, CAST(place AS INTEGER) AS place FROM w JOIN a ON a.asset_id = r.id"""

FAVORITES_THINNED = f"""WITH {ASSETS_SQL}, w AS (SELECT *, date_trunc('week', taken_at) AS week FROM a WHERE favorite), h AS (SELECT *, week = min(week) OVER (PARTITION BY owner) OR week = max(week) OVER (PARTITION BY owner) AS held FROM w),
m AS (SELECT *, NOT held AND row_number() OVER (PARTITION BY owner, held, week ORDER BY score DESC, asset_id DESC) > 1 AS free FROM h),
g AS (SELECT *, sum(duration) OVER (PARTITION BY owner) - coalesce(sum(CASE WHEN free THEN duration ELSE 0 END) OVER (PARTITION BY owner ORDER BY score, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM m)
SELECT owner, asset_id FROM g WHERE NOT free OR rest <= 40"""

#: Round by round: the rows that go, at most ten times.
JUDGED = f"""WITH RECURSIVE {ASSETS_SQL}, s AS (SELECT owner, list(struct_pack(id := asset_id, s := score / 100, fav := favorite) ORDER BY taken_at, asset_id) AS rows FROM a GROUP BY owner),
f AS (SELECT owner, rows, 0 AS k FROM s
  UNION ALL SELECT owner, list_filter(rows, lambda r, i: r.fav OR NOT (r.s < 0.3 OR (i = n AND n > 2 AND r.s = lo AND r.s < 0.6 * mean))), k + 1
  FROM (SELECT *, len(rows) AS n, list_min(list_transform(rows, lambda r: r.s)) AS lo, list_avg(list_transform(rows, lambda r: r.s)) AS mean FROM f WHERE k < 10))
SELECT owner, unnest(list_transform(rows, lambda r: r.id)) AS asset_id FROM f WHERE k = 10"""

TRANSITIONS = f"""WITH RECURSIVE {ASSETS_SQL}, o AS (SELECT owner, asset_id, kind = 'signup' AS title, ('0x' || substr(md5(CAST(asset_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 700 AS fades, row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS k FROM a),
f AS (SELECT owner, 0 AS k, '' AS past, -1::BIGINT AS asset_id, '' AS transition FROM o GROUP BY owner
  UNION ALL SELECT owner, k, right(past || transition[1], 3), asset_id, transition FROM (SELECT o.owner, o.k, f.past, o.asset_id, CASE WHEN o.title THEN 'fade' WHEN f.past = 'fff' THEN 'cut' WHEN right(f.past, 2) = 'cc' THEN 'fade' WHEN o.fades THEN 'fade' ELSE 'cut' END AS transition FROM f JOIN o ON o.owner = f.owner AND o.k = f.k + 1))
SELECT owner, asset_id, transition FROM f WHERE k > 0"""

GREEDY_FIT = """WITH RECURSIVE {assets}, o AS (SELECT owner, asset_id, duration, row_number() OVER (PARTITION BY owner ORDER BY {order}) AS k FROM {source}),
f AS (SELECT owner, 0 AS k, 0.0::DOUBLE AS used, -1::BIGINT AS asset_id, false AS fits FROM o GROUP BY owner
  UNION ALL SELECT o.owner, o.k, CASE WHEN f.used + o.duration <= {budget} THEN f.used + o.duration ELSE f.used END, o.asset_id, f.used + o.duration <= {budget} FROM f JOIN o ON o.owner = f.owner AND o.k = f.k + 1)
SELECT owner, asset_id FROM f WHERE fits"""

BURSTS = f"""WITH RECURSIVE {ASSETS_SQL}, b AS (SELECT owner, asset_id, score, epoch_us(taken_at) AS t, CASE WHEN asset_id % 11 > 0 THEN ('0x' || substr(md5(CAST(asset_id // 5 AS VARCHAR)), 1, 15))::BIGINT END AS h, row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS k FROM a),
f AS (SELECT owner, 0::BIGINT AS k, []::STRUCT(t BIGINT, h BIGINT, id BIGINT, s DOUBLE)[] AS held FROM b GROUP BY owner
  UNION ALL SELECT owner, k, CASE WHEN h IS NULL OR hit = 0 THEN list_append(held, struct_pack(t := CASE WHEN h IS NULL THEN NULL ELSE t END, h := h, id := asset_id, s := score))
      ELSE list_transform(held, lambda x, i: CASE WHEN i = hit AND score > x.s THEN struct_pack(t := x.t, h := x.h, id := asset_id, s := score) ELSE x END) END
  FROM (SELECT b.*, f.held, coalesce(list_position(list_transform(f.held, lambda x: x.h IS NOT NULL AND b.h IS NOT NULL AND b.t - x.t <= 1800000000 AND bit_count(xor(x.h, b.h)) <= 30), true), 0) AS hit FROM f JOIN b ON b.owner = f.owner AND b.k = f.k + 1)),
e AS (SELECT owner, unnest(held) AS x FROM f QUALIFY k = max(k) OVER (PARTITION BY owner))
SELECT owner, x.id AS asset_id, x.s AS score FROM e"""

AWAY = f"""w AS (SELECT *, CAST(taken_at AS DATE) AS day FROM a h WHERE {KM.format(a="h", b="p").replace("p.lat", str(HOME[0])).replace("p.lon", str(HOME[1]))} >= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS k FROM w)"""
PLACES = f"""f AS (SELECT owner, k, [struct_pack(lat := lat, lon := lon, slat := lat, slon := lon, n := 1, days := [day])] AS places FROM o WHERE k = 1
  UNION ALL SELECT owner, k, CASE WHEN km[hit] <= 2 THEN list_transform(places, lambda p, i: CASE WHEN i = hit THEN struct_pack(lat := p.lat, lon := p.lon, slat := p.slat + lat, slon := p.slon + lon, n := p.n + 1, days := list_distinct(list_append(p.days, day))) ELSE p END)
    ELSE list_append(places, struct_pack(lat := lat, lon := lon, slat := lat, slon := lon, n := 1, days := [day])) END
  FROM (SELECT *, list_position(km, list_min(km)) AS hit FROM (SELECT o.*, f.places, list_transform(f.places, lambda p: round({KM.format(a="o", b="p")}, 6)) AS km FROM f JOIN o ON o.owner = f.owner AND o.k = f.k + 1))),
g AS (SELECT owner, unnest(places) AS p, unnest(range(len(places))) AS place FROM f QUALIFY k = max(k) OVER (PARTITION BY owner)), sp AS (SELECT owner, date_diff('day', min(day), max(day)) + 1 AS span FROM w GROUP BY 1),
bases AS (SELECT owner, CAST(place AS INTEGER) AS place, p.slat / p.n AS lat, p.slon / p.n AS lon, list_sort(p.days) AS days, p.n AS n, span,
  len(p.days) >= greatest(3, ceil(span * 0.3)) OR list_bool_or(list_append(list_transform(range(1, len(p.days)), lambda i: date_diff('day', list_sort(p.days)[i], list_sort(p.days)[i + 1]) > 2), false)) AS is_base FROM g JOIN sp USING (owner))"""
HOME_BASES = f"WITH RECURSIVE {ASSETS_SQL}, {AWAY}, {PLACES} SELECT owner, place, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(len(days) AS INTEGER) AS n_days, n, CAST(span AS INTEGER) AS span, is_base FROM bases"

MERGED = f"""dn AS (SELECT owner, day, lat, lon, row_number() OVER (PARTITION BY owner ORDER BY day) AS k FROM stops),
cr AS (SELECT owner, k, [struct_pack(s := day, e := day, n := 1, lat := lat, lon := lon)] AS runs FROM dn WHERE k = 1
  UNION ALL SELECT d.owner, d.k, CASE WHEN {KM.format(a="h", b="d").replace("h.lat", "c.runs[len(c.runs)].lat").replace("h.lon", "c.runs[len(c.runs)].lon")} <= 2
      THEN c.runs[1:len(c.runs) - 1] || [struct_pack(s := c.runs[len(c.runs)].s, e := d.day, n := c.runs[len(c.runs)].n + 1, lat := c.runs[len(c.runs)].lat, lon := c.runs[len(c.runs)].lon)]
      ELSE list_append(c.runs, struct_pack(s := d.day, e := d.day, n := 1, lat := d.lat, lon := d.lon)) END FROM cr c JOIN dn d ON d.owner = c.owner AND d.k = c.k + 1),
cd AS (SELECT owner, runs FROM cr QUALIFY k = max(k) OVER (PARTITION BY owner)),
mr AS (SELECT owner, runs, 1::BIGINT AS i, true AS changed, 0 AS step FROM cd
  UNION ALL SELECT owner, CASE WHEN j > 0 THEN runs[1:i - 1] || [struct_pack(s := runs[i].s, e := runs[j].e, n := list_sum(list_transform(runs[i:j], lambda r: r.n))::INTEGER, lat := runs[i].lat, lon := runs[i].lon)] || runs[j + 1:len(runs)] ELSE runs END,
    CASE WHEN i > len(runs) THEN 1 ELSE i + 1 END, CASE WHEN i > len(runs) THEN false ELSE changed OR j > 0 END, step + 1
  FROM (SELECT *, coalesce(list_min(list_filter(range(i + 2, len(runs) + 1), lambda x: {KM.format(a="u", b="v").replace("u.lat", "runs[i].lat").replace("u.lon", "runs[i].lon").replace("v.lat", "runs[x].lat").replace("v.lon", "runs[x].lon")} <= 2)), 0) AS j FROM mr WHERE changed OR i <= len(runs)) WHERE i <= len(runs) OR changed),
md AS (SELECT owner, unnest(runs) AS r, unnest(range(len(runs))) AS stop FROM mr QUALIFY step = max(step) OVER (PARTITION BY owner))"""
OVERNIGHT = f"""WITH RECURSIVE {ASSETS_SQL}, {AWAY}, {PLACES},
dp AS (SELECT owner, day, min_by(struct_pack(lat := lat, lon := lon), (taken_at, asset_id)) AS first, max_by(struct_pack(lat := lat, lon := lon), (taken_at, asset_id)) AS last FROM w GROUP BY 1, 2),
dl AS (SELECT *, coalesce(lead(first) OVER (PARTITION BY owner ORDER BY day), last) AS other FROM dp),
near AS (SELECT d.owner, d.day, min_by(struct_pack(lat := b.lat, lon := b.lon), b.place) AS base FROM dl d JOIN bases b ON b.owner = d.owner AND b.is_base AND list_contains(b.days, d.day) AND {KM.format(a="d.last", b="b")} <= 2 GROUP BY 1, 2),
stops AS (SELECT d.owner, d.day, coalesce(base, other).lat AS lat, coalesce(base, other).lon AS lon FROM dl d LEFT JOIN near n ON n.owner = d.owner AND n.day = d.day),
{MERGED}
SELECT owner, CAST(stop AS INTEGER) AS stop, r.s AS start_date, r.e AS end_date, r.n AS nights, round(r.lat, 6) AS lat, round(r.lon, 6) AS lon FROM md"""
