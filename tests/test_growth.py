"""Steps that once grew faster than their input, on small cases."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from mosaiq.functions import labels
from mosaiq.operators import history, intervals, selection, similarity
from mosaiq.plans import catalogue, catalogue_items, catalogue_plans, catalogue_selection


def test_blocks_find_all_pairs_and_the_groups(spark, monkeypatch):
    """Hashes are compared by blocks, not by probes that a join may send whole through the driver."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(20))) for v in values for _ in range(2)]
    values += values[:5]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([*enumerate(signed), (1000, None)], "id int, bits long")
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 18}
    got = [tuple(r) for r in similarity.similar_pairs(df, "id", "bits", 18).collect()]
    assert len(got) == len(want) and set(got) == want
    root = list(range(len(values)))
    for _ in values:
        for a, b, _ in want:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(similarity.similar_groups(df.where("bits is not null"), "id", "bits", 18).collect()) == dict(enumerate(root))
    links = similarity.compared_blocks(df, "id", "bits", 18, len(values), forest=True).count()
    assert links <= similarity.compared_blocks(df, "id", "bits", 18, len(values), forest=False).count()


def test_nearest_interval_against_all_pairs(spark):
    """Each point meets its neighbours only, with nulls, ties and several keys."""
    rng = random.Random(4)
    pick = lambda: rng.choice([None, *range(-40, 120, 3)]) if rng.random() < 0.9 else rng.randrange(1000)
    bases = [(k, rng.randrange(6), pick()) for k in range(60)]
    points = [(k, rng.randrange(7), pick()) for k in range(300)]
    b, p = spark.createDataFrame(bases, "base long, g int, lo long"), spark.createDataFrame(points, "id long, g int, t long")
    got = {(r["__g"], r["__t"]): (r["distance"], r["base"]) for r in intervals.nearest_of_length(p, "t", b, "lo", 20, "base", ["g"]).collect()}
    far = lambda lo, t: 0 if lo is None or t is None else max(lo - t, t - lo - 20, 0)
    assert got == {(g, t): min((far(lo, t), base) for base, h, lo in bases if h == g) for _, g, t in points if any(h == g for _, h, _ in bases)}


def test_bases_are_not_paired_with_all_customers(spark, tmp_path):
    spark.range(500).selectExpr("id s_suppkey", "0 s_nationkey", "cast(id as double) s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(700).selectExpr("id c_custkey", "0 c_nationkey", "cast(id * 9 as double) c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    plan = catalogue_plans.assign_to_bases(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "eqNullSafe" in plan or "<=>" in plan
    assert catalogue_plans.assign_to_bases(spark, str(tmp_path)).count() == 700


def test_average_hash_by_float_arithmetic(spark, tmp_path):
    """A grey value is rounded from a float, as in the SQL; 0.90499997 and one are 1.905 as floats, and 190.5 a hundred times."""
    x = 0.9049999713897705
    vectors = [[x] + [0.9] * 63, [x] * 64]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, catalogue_items.average_hashes(spark, str(tmp_path)).collect())) == sorted(con.execute(catalogue.SQL["average_hashes"]).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_streaks_do_not_look_ahead_from_each_row(spark):
    """A frame to the end of a key is gone through anew for each of its rows."""
    rows = [(k, i, o) for k, all_ in enumerate(["FFCF", "FCC", "FF", "C", "xFx"]) for i, o in enumerate(all_)] + [(None, 1, "F"), (None, 2, "C"), (None, 3, "F")]
    df = spark.createDataFrame(rows, "k int, i int, o string")
    got = history.failure_streaks(df, "k", [F.col("i")], F.col("o") == "F", F.col("o") == "C", "i")
    assert {tuple(r) for r in got.collect()} == {(0, 1, 3), (2, 2, 1), (4, 1, 1), (None, 1, 3)}
    assert "unboundedfollowing" not in plan_of(got)


def test_answers_are_read_once(spark):
    df = spark.createDataFrame([('{"primary_mood": "Sad", "genre_suggestions": ["JAZZ"], "confidence": 2}',)], "a string")
    m = df.select(labels.mood(F.col("a")).alias("m")).select("m.primary_mood", "m.energy_level", "m.genres", "m.confidence")
    assert tuple(m.first()) == ("sad", "medium", ["jazz"], 1.0)
    assert plan_of(m).count("from_json") + plan_of(m).count("jsontostructs") <= 2


def test_placements_take_no_window(spark, tmp_path):
    rows = [(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0), (2, 1, 4.0), (2, 2, 4.0), (3, 2, 1.0), (3, 1, 2.0), (3, 1, 7.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    best = catalogue_plans.best_placement(spark, str(tmp_path))
    assert {tuple(r) for r in best.collect()} == {(1, 3.0, 5.0), (3, 2.0, 7.0)}
    assert "Window" not in plan_of(best)


def test_merged_intervals_need_no_groups(spark):
    rows = [(1, 0.0, 2.0), (1, 1.0, 5.0), (1, 1.5, 3.0), (1, 5.0, 6.0), (1, 7.0, 7.0), (1, None, 9.0), (2, 1.0, 1.0), (3, 4.0, 8.0), (3, 5.0, 6.0)]
    got = intervals.merged(spark.createDataFrame(rows, "k int, s double, e double"), "s", "e", ["k"])
    assert {tuple(r) for r in got.collect()} == {(1, 0.0, 6.0), (1, 7.0, 9.0), (2, 1.0, 1.0), (3, 4.0, 8.0)}
    assert "Aggregate" not in plan_of(got)


def test_protected_rows_are_spread_in_one_pass(spark):
    """Favorites and the rest of a key are chosen in one pass over sorted rows, whatever the batches; no row without a mark where there are both."""
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(1, 1, at(0), 4.0, True, 1.0), (1, 2, at(40), 4.0, True, 2.0), (1, 3, at(1), 3.0, False, 9.0), (1, 4, at(30), 3.0, False, 1.0), (1, 5, at(2), 1.0, None, 9.0), (2, 6, at(3), 9.0, False, 3.0), (2, 7, at(5), 9.0, False, None), (3, 8, at(1), 99.0, True, 1.0)]
    df = spark.createDataFrame(rows, "g int, id int, t timestamp, d double, f boolean, s double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = selection.fitted_protected(df, ["g"], "t", "d", "f", "s", "id", 10.0, 14)
    try:
        assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 6, 1)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan_of(got).count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan_of(got)


def test_placements_of_edges_are_found_once(spark, tmp_path):
    """Their counts and the moved segment share one list of each edge's placements."""
    spark.createDataFrame([(1, 1, 5.0, 0.02), (1, 2, 9.0, 0.1)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = plan_of(catalogue_selection.audio_safe_segments(spark, str(tmp_path)))
    assert plan.count("array_distinct") == 2
