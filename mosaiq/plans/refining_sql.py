"""DuckDB SQL of whole selections, in parts that build on each other; each part is one or more common table expressions."""

from __future__ import annotations

from mosaiq.plans.adapters import ASSETS_SQL
from mosaiq.plans.catalogue_selection import SPREAD, STARRED

#: Assets whose days lie one, three, ten or twenty times as far apart, by owner; every third owner has no favorites.
STRETCHED_SQL = f"""{ASSETS_SQL}, raw AS (SELECT * EXCLUDE (taken_at), taken_at AS taken_at, epoch_us(taken_at) / 1e6 AS t FROM (
  SELECT asset_id, owner, make_timestamp(1704067200000000 + (epoch_us(taken_at) - 1704067200000000) * [1, 3, 10, 20][owner % 4 + 1]) AS taken_at, duration, favorite AND owner % 3 > 0 AS favorite, kind = 'view' AS photo, tagged AS people, score / 100 AS score FROM a))"""

PERIOD = """CASE WHEN span <= 30 THEN strftime(taken_at, '%Y-%m-%d') WHEN span <= 90 THEN strftime(taken_at, '%G-W%V') WHEN span <= 365 THEN strftime(taken_at, '%Y-%m') ELSE year(taken_at) || '-Q' || quarter(taken_at) END"""


def periods(source: str, name: str) -> str:
    return f"""{name} AS (SELECT *, {PERIOD} AS period FROM (SELECT *, floor((max(epoch_us(taken_at)) OVER (PARTITION BY owner) - min(epoch_us(taken_at)) OVER (PARTITION BY owner)) / 86400000000) AS span FROM {source}))"""


def events(source: str, period: str, name: str) -> str:
    return f"""{name}_z AS (SELECT owner, {period}, count(*) AS n, avg(CASE WHEN people THEN 1.0 ELSE 0.0 END) AS share FROM {source} GROUP BY 1, 2), {name}_m AS (SELECT owner, list_sort(list(n)) AS ns FROM {name}_z GROUP BY 1),
{name} AS (SELECT z.owner, {period} FROM {name}_z z JOIN {name}_m USING (owner) WHERE n >= 3.0 * ns[len(ns) // 2 + 1] AND share >= 0.1 QUALIFY row_number() OVER (PARTITION BY z.owner ORDER BY n DESC, {period}) <= 2)"""


#: raw without photos beyond the best of each day.
CAPPED = f"""ph AS (SELECT *, CAST(taken_at AS DATE) AS pday FROM raw WHERE photo), {events("ph", "pday", "pe")},
pool AS (SELECT * FROM raw WHERE NOT photo UNION ALL SELECT raw.* FROM raw JOIN (SELECT ph.asset_id FROM ph LEFT JOIN pe ON pe.owner = ph.owner AND pe.pday = ph.pday
  QUALIFY row_number() OVER (PARTITION BY ph.owner, ph.pday ORDER BY score DESC, asset_id) <= CASE WHEN pe.pday IS NULL THEN 2 ELSE 6 END) USING (asset_id))"""


def distributed(count: int, source: str = "pool") -> str:
    """chosen (owner, asset_id, reason) of source, with the events of raw."""
    return f"""{periods("raw", "rp")}, {events("rp", "period", "ev")}, {periods(source, "pp")},
pm AS (SELECT pp.*, ev.period IS NOT NULL AS event, bool_or(favorite) OVER (PARTITION BY pp.owner) AS starred FROM pp LEFT JOIN ev ON ev.owner = pp.owner AND ev.period = pp.period), st AS (SELECT * FROM pm WHERE starred), {STARRED.format(source="st", count=count, unit=1)},
cov AS (SELECT st.owner, asset_id, 'coverage' AS reason FROM st WHERE asset_id NOT IN (SELECT asset_id FROM s123) AND NOT EXISTS (SELECT 1 FROM s123 JOIN st x USING (asset_id) WHERE x.owner = st.owner AND x.period = st.period)
  QUALIFY row_number() OVER (PARTITION BY st.owner, period ORDER BY score DESC, asset_id) <= CASE WHEN event THEN 3 ELSE 1 END),
d0 AS (SELECT *, count(*) OVER (PARTITION BY owner, period) AS psize, row_number() OVER (PARTITION BY owner, period ORDER BY score DESC, asset_id) AS nth FROM pm WHERE NOT starred),
d1 AS (SELECT *, dense_rank() OVER (PARTITION BY owner ORDER BY psize DESC, period) <= {max(1, count // 2)} AND nth <= CASE WHEN event THEN 3 ELSE 1 END AS keeps FROM d0),
d2 AS (SELECT *, {count} - count(*) FILTER (WHERE keeps) OVER (PARTITION BY owner) AS rest, row_number() OVER (PARTITION BY owner, keeps ORDER BY score DESC, asset_id) AS spot FROM d1),
chosen AS (SELECT owner, asset_id, reason FROM s123 UNION ALL SELECT * FROM cov UNION ALL SELECT owner, asset_id, CASE WHEN keeps THEN 'period' ELSE 'score' END FROM d2 WHERE keeps OR spot <= rest)"""


def fitted(seconds: float) -> str:
    """cut (rows of pool with held) of chosen, within the seconds."""
    return f"""hd AS (SELECT pool.*, reason IN ('coverage', 'period') AS held FROM pool JOIN chosen USING (owner, asset_id)),
fi AS (SELECT *, count(*) OVER (PARTITION BY owner, strftime(taken_at, '%Y-%m')) = 1 OR favorite OR held AS goes FROM hd),
fs AS (SELECT *, sum(duration) OVER (PARTITION BY owner) AS total, coalesce(sum(CASE WHEN goes THEN duration END) OVER (PARTITION BY owner), 0) AS firsts FROM fi),
go AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, asset_id) AS k FROM fs WHERE total > {seconds} AND firsts <= {seconds} AND NOT goes),
gf AS (SELECT owner, 0::BIGINT AS k, min(firsts)::DOUBLE AS used, -1::BIGINT AS asset_id, false AS fits FROM go GROUP BY owner
  UNION ALL SELECT go.owner, go.k, CASE WHEN gf.used + duration <= {seconds} THEN gf.used + duration ELSE gf.used END, go.asset_id, gf.used + duration <= {seconds} FROM gf JOIN go ON go.owner = gf.owner AND go.k = gf.k + 1),
few AS (SELECT *, bool_or(favorite) OVER (PARTITION BY owner) AND bool_or(NOT favorite) OVER (PARTITION BY owner) AS mixed, floor((max(t) OVER (PARTITION BY owner) - min(t) OVER (PARTITION BY owner)) / 86400) AS far FROM fs WHERE total > {seconds} AND firsts > {seconds} AND goes),
one AS (SELECT *, {seconds} * CASE WHEN mixed AND far > 31 THEN 0.7 ELSE 1.0 END::DOUBLE AS budget FROM few WHERE favorite OR NOT mixed), {SPREAD.format(name="f1", source="one")},
spent AS (SELECT owner, sum(duration) AS s FROM f1 JOIN few USING (owner, asset_id) GROUP BY 1), two AS (SELECT few.*, {seconds}::DOUBLE - coalesce(s, 0) AS budget FROM few LEFT JOIN spent USING (owner) WHERE mixed AND NOT favorite), {SPREAD.format(name="f2", source="two")},
cut AS (SELECT * FROM hd WHERE asset_id IN (SELECT asset_id FROM fs WHERE total <= {seconds} OR (firsts <= {seconds} AND goes) UNION ALL SELECT asset_id FROM gf WHERE fits UNION ALL SELECT asset_id FROM f1 UNION ALL SELECT asset_id FROM f2))"""


def thinned(clips: int, moment_s: float, others: float, photos: float) -> str:
    """kept of cut: one row a moment, few others, few photos."""
    return f"""gp AS (SELECT *, epoch_us(taken_at - lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, asset_id)) / 1e6 AS gap FROM cut),
mo AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {moment_s} THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS moment FROM gp),
om AS (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY owner, moment ORDER BY favorite DESC, score DESC, asset_id) = 1),
li AS (SELECT *, greatest(floor({others} * count(*) OVER (PARTITION BY owner)), {clips} - count(*) FILTER (WHERE favorite) OVER (PARTITION BY owner)) AS most, row_number() OVER (PARTITION BY owner, favorite ORDER BY score DESC, asset_id) AS spot FROM om),
fo AS (SELECT *, photo AND NOT (held OR favorite) AS free, count(*) FILTER (WHERE NOT photo) OVER (PARTITION BY owner) AS videos, count(*) FILTER (WHERE photo AND (held OR favorite)) OVER (PARTITION BY owner) AS stay FROM li WHERE favorite OR spot <= most),
kept AS (SELECT owner, asset_id FROM fo QUALIFY NOT free OR videos = 0 OR row_number() OVER (PARTITION BY owner, free ORDER BY score DESC, asset_id) <= floor(videos * {photos} / (1 - {photos})) - stay)"""


def backfilled(source: str, clips: int, seconds: float, moment_s: float, others: float, photos: float) -> str:
    """filled (owner, asset_id, tier) of source (with chosen and scarce): a step a pick, its tier sought anew."""
    return f"""bf AS (SELECT owner, 0 AS step, sum(CASE WHEN chosen THEN duration ELSE 0 END)::DOUBLE AS used, count(*) FILTER (WHERE chosen) AS n, count(*) FILTER (WHERE chosen AND photo) AS photos, count(*) FILTER (WHERE chosen AND NOT favorite) AS others,
    CASE WHEN bool_or(scarce) THEN NULL ELSE {photos} END::DOUBLE AS cap, coalesce(list(struct_pack(id := asset_id, t := t, tier := 0)) FILTER (WHERE chosen), []) AS held FROM {source} GROUP BY owner
  UNION ALL SELECT owner, step + 1, used + duration, n + 1, photos + photo::INT, others + (NOT favorite)::INT, CASE WHEN tier <= 2 THEN cap WHEN tier <= 4 THEN more END, list_append(held, struct_pack(id := asset_id, t := t, tier := tier))
  FROM (SELECT *, CASE WHEN fits AND apart AND (NOT photo OR cap IS NULL OR share <= cap + 1e-9) AND strict THEN 1 WHEN fits AND apart AND (NOT photo OR cap IS NULL OR share <= cap + 1e-9) THEN 2
      WHEN fits AND apart AND (NOT photo OR more IS NULL OR share <= more + 1e-9) THEN 3 WHEN fits AND (NOT photo OR more IS NULL OR share <= more + 1e-9) THEN 4 WHEN fits THEN 5 WHEN duration > 0 AND duration <= room + 2.0 + 1e-6 THEN 6 END AS tier
    FROM (SELECT *, duration > 0 AND duration <= room + 1e-6 AS fits, coalesce(near > {moment_s}, true) AS apart, (photos + 1) / (n + 1) AS share, CASE WHEN cap < 0.7 THEN 0.7 ELSE cap END AS more,
        favorite OR others + 1 <= greatest(floor((n + 1) * {others}), greatest(0, {clips} - (n - others))) AS strict
      FROM (SELECT bf.*, s.asset_id, s.duration, s.favorite, s.photo, s.score, s.scarce, s.t, {seconds} - bf.used AS room, list_min(list_transform(bf.held, lambda h: abs(h.t - s.t))) AS near FROM bf JOIN {source} s ON s.owner = bf.owner AND bf.used < {seconds} AND NOT list_contains(list_transform(bf.held, lambda h: h.id), s.asset_id))))
  WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner ORDER BY tier, favorite DESC, (scarce AND NOT photo) DESC, coalesce(near, 0) DESC, score DESC, asset_id) = 1),
filled AS (SELECT owner, h.id AS asset_id, CAST(h.tier AS INTEGER) AS tier FROM (SELECT owner, unnest(held) AS h FROM bf QUALIFY step = max(step) OVER (PARTITION BY owner)))"""


def refined(choice: str, clips: int, seconds: float, moment_s: float, others: float, photos: float) -> str:
    """filled of raw: choice gives chosen from pool."""
    return f"""{CAPPED}, {choice}, {fitted(seconds)}, {thinned(clips, moment_s, others, photos)},
vs AS (SELECT owner, coalesce(sum(CASE WHEN NOT photo THEN duration END), 0) < {seconds} * 0.5 AS scarce FROM pool GROUP BY 1),
wh AS (SELECT raw.*, kept.asset_id IS NOT NULL AS chosen, scarce FROM raw JOIN vs USING (owner) LEFT JOIN kept ON kept.owner = raw.owner AND kept.asset_id = raw.asset_id), {backfilled("wh", clips, seconds, moment_s, others, photos)}"""


#: chosen from pool (of trips), with the stops of md (owner, r, stop).
def by_stops(count: int) -> str:
    return f"""sb AS (SELECT owner, stop, r.s AS lo, r.e AS hi, r.n AS nights FROM md), sn AS (SELECT *, count(*) OVER (PARTITION BY owner) AS ns, sum(nights) OVER (PARTITION BY owner) AS whole, row_number() OVER (PARTITION BY owner ORDER BY stop) AS nth, row_number() OVER (PARTITION BY owner ORDER BY nights DESC, stop) AS longest FROM sb),
so AS (SELECT *, floor(({count} - ns) * nights / whole) AS own FROM sn), sl AS (SELECT *, {count} - ns - sum(own) OVER (PARTITION BY owner) AS over FROM so),
sp2 AS (SELECT owner, stop, lo, hi, CAST(CASE WHEN ns >= {count} THEN (nth <= {count})::INT ELSE 1 + own + floor(over / ns) + (longest <= over % ns)::INT END AS INTEGER) AS places FROM sl),
tg AS (SELECT p.owner, p.asset_id, p.score, s.stop, s.places FROM pool p JOIN sp2 s ON s.owner = p.owner QUALIFY row_number() OVER (PARTITION BY p.asset_id ORDER BY CASE WHEN CAST(taken_at AS DATE) BETWEEN lo AND hi THEN -1 ELSE least(abs(date_diff('day', lo, CAST(taken_at AS DATE))), abs(date_diff('day', hi, CAST(taken_at AS DATE)))) END, s.stop) = 1),
chosen AS (SELECT owner, asset_id, 'stop' AS reason FROM tg QUALIFY row_number() OVER (PARTITION BY owner, stop ORDER BY score DESC, asset_id) <= places)"""
