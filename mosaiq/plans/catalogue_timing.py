"""Registered queries on timelines' plans, tempos and stored thumbnails."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import tempo
from mosaiq.operators import ranking, selection
from mosaiq.operators.checkpoints import shared_dir
from mosaiq.plans.adapters import table
from mosaiq.plans.catalogue import query
from mosaiq.sources import thumbnails

ROUNDS = "(greatest(greatest(1, ceil((base + {o}) / 5.0)) + cards - 1, 0) * 0.5 * 0.7)"


def overlap_sql(turns: int = 8) -> str:
    """Nested column by column: overlap 1 to 8."""
    steps, last = [], "0.0"
    for k in range(1, turns + 1):
        steps.append(f"o{k} AS (SELECT *, {ROUNDS.format(o=last)} AS ov{k} FROM {'z' if k == 1 else f'o{k - 1}'})")
        last = f"ov{k}"
    return ", ".join(steps)


@query(f"""WITH m AS (SELECT o_custkey, o_orderdate AS at, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), t AS (SELECT o_custkey, count(DISTINCT (y, m)) - 1 AS eligible, count(*) * 4.0 AS target, o_custkey % 3 = 0 AS trip, o_custkey % 3 = 1 AS months FROM m GROUP BY 1),
a AS (SELECT *, least(3.5, target * 0.2) AS title FROM t), b AS (SELECT *, target * 0.2 - title AS rest FROM a), c AS (SELECT *, CASE WHEN rest >= 2.0 THEN least(4.0, rest) ELSE 0.0 END AS ending FROM b),
d AS (SELECT *, CASE WHEN trip THEN 0 ELSE least(eligible, CAST(floor((rest - ending) / 0.5) AS BIGINT)) END AS reserved FROM c), e AS (SELECT *, title + ending + reserved * 0.5 AS budget, (title > 0)::INT + reserved + (ending > 0)::INT AS cards FROM d),
z AS (SELECT *, greatest(target - budget, 0.0) AS base FROM e), {overlap_sql()}
SELECT o_custkey, CASE WHEN trip OR months THEN 'pending' ELSE 'capped' END AS policy, round(CAST(title AS DOUBLE), 4) AS title, round(CAST(ending AS DOUBLE), 4) AS ending, CAST(reserved AS BIGINT) AS reserved, CAST(CASE WHEN trip OR months THEN 0 ELSE reserved END AS BIGINT) AS max_dividers, round(CAST(budget AS DOUBLE), 4) AS title_budget,
  round(CAST(CASE WHEN trip OR months THEN target + least(10.0, target * 0.2) END AS DOUBLE), 4) AS soft_max, round(CAST(ov8 AS DOUBLE), 4) AS overlap, round(CAST(base + ov8 AS DOUBLE), 4) AS content_budget FROM o8""".replace("* 4.0 AS target", "* 4.0::DOUBLE AS target"))
def timeline_plan(spark, d):
    """Timelines before their clips are chosen: titles within a fifth, dividers of months or trips pending, and what fades give back."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg((F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")) - 1).alias("eligible"), (F.count(F.lit(1)) * 4.0).alias("target"))
    kinds = t.withColumns({"trip": F.col("o_custkey") % 3 == 0, "months": F.col("o_custkey") % 3 == 1})
    plan = selection.planned(kinds, F.col("target"), 3.5, 4.0, 0.5)
    return plan.select("o_custkey", "policy", *[F.round(c, 4).alias(c) for c in ("title", "ending", "title_budget", "soft_max", "overlap", "content_budget")], "reserved", "max_dividers")


@query("""WITH p AS (SELECT p_partkey, 55 + p_size * 2.0::DOUBLE AS own, CAST([0.37, 1.0, 2.5, 4.0, 0.0][p_partkey % 5 + 1] AS DOUBLE) AS cadence FROM part),
n AS (SELECT *, unnest([0, 1]) + CAST(floor(cadence * own / 60.0) AS BIGINT) AS n FROM p), c AS (SELECT *, 60.0 * n / cadence AS bpm FROM n WHERE cadence > 0 AND n >= 1),
b AS (SELECT p_partkey, arg_min(bpm, (abs(bpm - own), n)) AS bpm FROM c WHERE bpm BETWEEN 68 AND 150 AND abs(bpm - own) <= own * 0.15 GROUP BY 1)
SELECT p.p_partkey, CAST(round_even(coalesce(bpm, own), 0) AS INTEGER) AS bpm FROM p LEFT JOIN b USING (p_partkey)""")
def beat_choice(spark, d):
    """The tempo of each track with whole beats a cut, near its natural one and in its style's range."""
    cadence = F.get(F.array(*[F.lit(c) for c in (0.37, 1.0, 2.5, 4.0, 0.0)]), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", tempo.aligned(55 + F.col("p_size") * 2.0, cadence, 68, 150).alias("bpm"))


@query("""WITH c AS (SELECT p_brand, (avg(p_size) / 8)::DOUBLE AS cadence FROM part GROUP BY 1), t AS (SELECT p_brand, p_partkey, cadence, CASE WHEN p_partkey % 9 > 0 THEN 60.0 + p_size * 1.5 + p_partkey % 7 END::DOUBLE AS bpm FROM part JOIN c USING (p_brand)),
m AS (SELECT *, round(abs(cadence * bpm / 60.0 - round_even(cadence * bpm / 60.0, 0)), 6) AS misfit FROM t WHERE bpm IS NOT NULL) SELECT p_brand, p_partkey, misfit FROM m QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY misfit, p_partkey) = 1""")
def track_for_cadence(spark, d):
    """Of each brand's tracks the one whose beat divides the brand's cadence best; tracks without a tempo lose their turn."""
    parts = table(spark, d, "part")
    cadence = parts.groupBy("p_brand").agg((F.avg("p_size") / 8).alias("cadence"))
    bpm = F.when(F.col("p_partkey") % 9 > 0, 60.0 + F.col("p_size") * 1.5 + F.col("p_partkey") % 7)
    fits = parts.join(cadence, "p_brand").withColumn("misfit", F.round(tempo.misfit(bpm, F.col("cadence")), 6)).where("misfit is not null")
    return ranking.first_per(fits, ["p_brand"], [F.col("misfit"), F.col("p_partkey")]).select("p_brand", "p_partkey", "misfit")


@query("""WITH s AS (SELECT unnest(['small', 'large']) AS size), t AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS asset_id, size, repeat(c_name || '|' || size, CASE size WHEN 'large' THEN 3 ELSE 1 END) AS body, c_custkey % 40 AS age FROM customer, s WHERE size = 'small' OR c_custkey % 2 = 0),
n AS (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN body || '!' ELSE body END AS body, CASE WHEN c_custkey % 5 = 0 THEN 100 ELSE age END AS age) FROM t), b AS (SELECT *, strlen(body) AS bytes, substr(asset_id, 1, 2) AS prefix FROM n),
p AS (SELECT prefix, floor(sum(bytes) * 20000 / (SELECT sum(bytes) FROM b)::DOUBLE) AS share FROM b GROUP BY 1),
e AS (SELECT asset_id, size, sum(bytes) OVER (PARTITION BY prefix) - coalesce(sum(bytes) OVER (PARTITION BY prefix ORDER BY age, asset_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > share AS goes FROM b JOIN p USING (prefix))
SELECT w.asset_id, w.size, b.body IS NOT NULL AS held, CASE WHEN b.body IS NOT NULL THEN md5(b.body) END AS digest, coalesce(goes, false) AS goes FROM (SELECT md5(CAST(c_custkey AS VARCHAR)) AS asset_id, unnest(['small', 'large', 'huge']) AS size FROM customer) w LEFT JOIN b ON b.asset_id = w.asset_id AND b.size = w.size LEFT JOIN e ON e.asset_id = w.asset_id AND e.size = w.size""")
def thumbnail_store(spark, d):
    """Thumbnails made from a table, stored by prefix, some stored again; what is there, what it holds, and what goes out to a budget."""
    folder = shared_dir(spark)
    sizes = F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("small"), F.lit("large"))).otherwise(F.array(F.lit("small"))))
    body = F.repeat(F.concat("c_name", F.lit("|"), "size"), F.when(F.col("size") == "large", 3).otherwise(1))
    made = table(spark, d, "customer").select("c_custkey", "c_name", F.md5(F.col("c_custkey").cast("string")).alias("asset_id"), sizes.alias("size"))
    day = lambda k: F.timestamp_seconds(k * 86_400)
    thumbnails.put(made.select("asset_id", "size", body.cast("binary").alias("content"), day(F.col("c_custkey") % 40).alias("stored_at")), folder)
    thumbnails.put(made.where("c_custkey % 5 = 0").select("asset_id", "size", F.concat(body, F.lit("!")).cast("binary").alias("content"), day(F.lit(100)).alias("stored_at")), folder)
    wanted = table(spark, d, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("asset_id"), F.explode(F.array(*[F.lit(s) for s in ("small", "large", "huge")])).alias("size"))
    digests = thumbnails.contents(spark, folder, wanted).select("asset_id", "size", F.md5("content").alias("digest"))
    gone = thumbnails.evicted(spark, folder, 20_000).withColumn("goes", F.lit(True))
    found = thumbnails.held(spark, folder, wanted).join(digests, ["asset_id", "size"], "left").join(gone, ["asset_id", "size"], "left")
    return found.select("asset_id", "size", "held", "digest", F.coalesce("goes", F.lit(False)).alias("goes"))
