"""Curation operators on small inputs with known outcomes, and the queries against DuckDB."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mosaiq.functions import calendar, geo, hashing, scores, text
from mosaiq.operators import folds, history, intervals, ranking, selection, sessions, similarity
from mosaiq.plans import catalogue
from mosaiq.sources import library
from mosaiq.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def at(minutes, day=1):
    return dt.datetime(2025, 7, day) + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.sql(catalogue.SQL[name])
    columns = found.columns
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == wanted


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hashes(spark):
    cases = [("0000", "ffff", 16), ("abcd", "abcdef", 64), ("", "", 64), ("zz", "zz", 64), ("ff00ff00ff00ff00", "00ff00ff00ff00ff", 64), ("ff00ff00ff00ff00", "ff00ff00ff00ff03", 2), (None, "ff", 64)]
    got = spark.createDataFrame(cases, "a string, b string, d int").select("d", hashing.hamming_hex(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["d"] == r["x"] for r in got)
    assert one(spark, hashing.hash_chunks(F.lit("ff00ab"))) == ["ff00", "ab00", "0000", "0000"]
    pixels = F.array(*[F.lit(10.0 if k % 2 else 0.0) for k in range(64)])
    assert one(spark, hashing.average_hash(pixels)) == "a" * 16
    assert one(spark, hashing.differing_digits(F.lit("abcd"), F.lit("abff"))) == 2
    assert one(spark, hashing.memory_key(F.lit("trip"), F.lit("2024-01-02").cast("date"), F.lit("2024-01-09").cast("date"), F.array(F.lit("Bo"), F.lit("al")))) == "trip:2024-01-02:2024-01-09:al,bo"
    assert one(spark, hashing.run_id_time(F.lit("20240102_030405_a1B2"))) == dt.datetime(2024, 1, 2, 3, 4, 5) and one(spark, hashing.run_id_time(F.lit("20241402_030405_a1b2"))) is None
    names = ["a", "b", "c"]
    assert one(spark, hashing.pseudonym(F.lit("x"), names)) == names[int("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", 16) % 3]


def test_text_and_dates(spark):
    assert one(spark, text.wire_duration(F.lit("1:02:03.5"))) == 3723.5 and one(spark, text.wire_duration(F.lit("x"))) is None
    assert one(spark, text.json_number(F.lit('<think>{"k":1}</think>```json\n{"k": 0.7, "m": [1]\n'), "k", 0, 1)) == 0.7
    assert one(spark, text.truncated(F.lit("some longer words"), 12)) == "some longer…"
    assert [one(spark, text.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "112th"]
    assert one(spark, text.place_name(F.lit(" "), F.lit("Spain"))) == "Spain"
    for period, wanted in (("30d", dt.date(2024, 3, 1)), ("2w", dt.date(2024, 2, 14)), (" 6m ", dt.date(2024, 7, 30)), ("6M", dt.date(2024, 7, 30))):
        assert one(spark, calendar.end_of_period(F.lit("2024-01-31" if "m" in period.lower() else "2024-02-01").cast("date"), F.lit(period))) == wanted
    assert all(one(spark, calendar.period_months_days(F.lit(p))) is None for p in ("invalid", "30", "m", "3x"))
    assert one(spark, calendar.easter(F.lit(2024))) == dt.date(2024, 3, 31) and one(spark, calendar.easter(F.lit(2038))) == dt.date(2038, 4, 25)
    assert one(spark, calendar.anniversary(F.lit("2000-02-29").cast("date"), F.lit(2023))) == dt.date(2023, 2, 28)
    assert one(spark, calendar.parsed_date(F.lit("31/12/2023"))) == dt.date(2023, 12, 31)
    assert one(spark, calendar.parsed_date(F.lit("12/31/2023"))) == dt.date(2023, 12, 31) and one(spark, calendar.parsed_date(F.lit("soon"))) is None


def test_distances_and_scores(spark):
    assert 260 < one(spark, geo.haversine_km(F.lit(50.8468), F.lit(4.3525), F.lit(48.8566), F.lit(2.3522))) < 270
    assert abs(one(spark, geo.mercator_latitude(geo.mercator_y(F.lit(50.0)))) - 50) < 1e-9
    assert [one(spark, scores.backoff_hours(F.lit(n))) for n in (1, 2, 3, 9)] == [None, 24, 72, 168]
    assert [round(one(spark, scores.range_duration(F.lit(d)))) for d in (30, 180, 360)] == [60, 360, 600]


def test_sessions(spark):
    make = lambda *rows: spark.createDataFrame([(k, 1, t, s) for k, (t, s) in enumerate(rows)], "id long, who long, t timestamp, s double").withColumn("fav", F.lit(False))
    best = lambda df, gap=300: sorted(r["s"] for r in sessions.best_per_moment(df, "t", gap, ["who"], "fav", "s", "id").collect())
    assert best(make((at(955), 0.88), (at(957), 0.94))) == [0.94]
    assert best(make((at(954), 0.1), (at(970), 0.2))) == [0.1, 0.2]
    assert best(make(*[(at(950 + 3 * k), 0.1 * k) for k in range(4)])) == [pytest.approx(0.3)]
    assert best(make((at(514), 0.1), (at(519), 0.2))) == [0.2]
    a, near, other = 0x7F00FF00FF00FF00, 0x7F00FF00FF00FF03, 0x00FF00FF00FF00FF
    rows = [(0, 1, at(0), a, 0.4), (1, 1, at(0.025), near, 0.9), (2, 1, at(0.05), a, 0.6), (3, 1, at(1), None, 0.1), (4, 1, at(2), other, 0.2), (5, 1, at(9), a, 0.3)]
    burst = sessions.bursts(spark.createDataFrame(rows, "id long, who long, t timestamp, h long, s double"), "t", "h", "s", ["who"], "id")
    assert sorted(r["id"] for r in burst.collect()) == [1, 3, 4, 5]
    place = lambda days, lat, lon: [(k, 1, at(600, d), lat, lon) for k, d in enumerate(days)]
    trips = lambda rows: sessions.trips(spark.createDataFrame(rows, "id long, who long, t timestamp, lat double, lon double"), "t", "lat", "lon", ["who"], "id", (50.8468, 4.3525)).collect()
    assert trips(place((12, 13, 14), 51.2194, 4.4025)) == []
    (trip,) = trips(place((12, 13, 14), 41.3851, 2.1734))
    assert (trip["n_assets"], trip["days"]) == (3, 3)
    assert len(trips(place((12, 13, 14), 41.3851, 2.1734) + place((22, 23, 24), 51.5, -0.12))) == 2


def test_ranking(spark):
    values = spark.createDataFrame([(k, v, "g") for k, v in enumerate([2, 2, 2, 9])] + [(9, 1, "h")], "id int, v int, g string")
    got = {r["id"]: r["rank"] for r in ranking.midpoint_rank(values, "v", ["g"]).collect()}
    assert got[3] == 1 and got[0] == got[1] == pytest.approx(1 / 3) and got[9] == 1
    clips = spark.createDataFrame([(k, "g", 5.0, s) for k, s in enumerate([0.2, 0.8, 0.5])], "id int, g string, d double, s double")
    filled = ranking.fill_until_crossed(clips, "d", F.lit(6.0), ["g"], [F.desc("s")])
    assert sorted(r["id"] for r in filled.collect()) == [1, 2]
    videos = spark.createDataFrame([(k, "g", d, s) for k, (d, s) in enumerate([(10.0, 0.9), (10.0, 0.3), (10.0, 0.7), (30.0, 0.95), (0.0, 0.1)])], "id long, g string, d double, s double")
    assert sorted(r["id"] for r in ranking.greedy_fit(videos, "d", 20.0, ["g"], [F.desc("s")], "id").collect()) == [0, 2, 4]
    months = spark.createDataFrame([(f"{2025 + (m + 1) // 12}-{(m + 1) % 12 + 1:02d}", 500 if m == 11 else 100, 1) for m in range(12)], "month string, n int, k int")
    (burst,) = ranking.trailing_burst(months, "month", "n", ["k"]).collect()
    assert (burst["month"], burst["ratio"]) == ("2026-01", 5.0)


def test_place_counts(spark):
    rows = [(1, "a", 41.38, 2.17, "B"), (2, "a", 50.0, 4.0, "H"), (3, "a", 50.01, 4.0, "X"), (4, "a", None, 4.0, "N"), (5, "a", 0.0, 1.0, "N"), (6, "b", 10.0, None, None), (7, "a", 41.5, 2.17, "C")]
    df = spark.createDataFrame(rows, "id int, g string, lat double, lon double, city string")
    counts = lambda d: {r["g"]: [(p["city"], p["n"]) for p in r["places"]] for r in folds.place_counts(d, "lat", "lon", "city", ["g"], ["id"]).collect()}
    assert counts(df) == {"a": [("H", 2), ("B", 1), ("C", 1)], "b": [("Unknown", 1)]}
    assert counts(df.limit(0)) == {}


def test_history(spark):
    attempts = spark.createDataFrame([(1, "a", "F"), (2, "a", "F"), (3, "a", "C"), (1, "b", "F"), (2, "b", "C"), (3, "b", "F"), (4, "b", "S"), (1, "c", None)], "id int, k string, o string").withColumn("t", F.col("id"))
    streaks = history.failure_streaks(attempts, "k", [F.col("id")], F.coalesce(F.col("o") == "F", F.lit(False)), F.coalesce(F.col("o") == "C", F.lit(False)), "t")
    assert [(r["k"], r["failures"], r["last_failed_at"]) for r in streaks.collect()] == [("b", 1, 3)]
    old, new = spark.createDataFrame([(1, "x", "y"), (2, "x", None)], "id int, a string, b string"), spark.createDataFrame([(2, None, "n"), (3, "q", None)], "id int, a string, b string")
    assert sorted(map(tuple, history.merged(old, new, ["id"]).collect())) == [(1, "x", "y"), (2, "x", "n"), (3, "q", None)]
    assert sorted(r["id"] for r in history.inserted(old, new, ["id"]).collect()) == [1, 2, 3]
    assert {r["id"]: r["a"] for r in history.upserted(old, new, ["id"], [F.col("a")]).collect()} == {1: "x", 2: None, 3: "q"}


def test_components_and_pairs(spark):
    nodes = spark.createDataFrame([(n,) for n in range(1, 8)], "id int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "id1 int, id2 int")
    assert dict(similarity.components(nodes, "id", pairs).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    hashes = spark.createDataFrame([(1, 0), (2, 255), (3, 256 + 255), (4, -1)], "id int, h long")
    assert sorted(map(tuple, similarity.similar_pairs(hashes, "id", "h", 8).collect())) == [(1, 2, 8), (2, 3, 1)]


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 6.0, 7.0), (2, 0.0, 1.0)], "v int, s double, e double")
    assert sorted(map(tuple, intervals.merged(spans, "s", "e", ["v"]).collect())) == [(1, 0.0, 4.0), (1, 6.0, 7.0), (2, 0.0, 1.0)]
    assert [tuple(r) for r in intervals.gaps(spans, "s", "e", ["v"]).collect()] == [(1, 4.0, 6.0)]
    assert dict(intervals.union_length(spans, "s", "e", ["v"]).collect()) == {1: 5.0, 2: 1.0}
    assert one(spark, intervals.nearest(F.array(F.lit(1.0), F.lit(3.0)), F.lit(2.0))) == 1.0


def test_folds(spark):
    times = spark.createDataFrame([(1, t) for t in (0.0, 0.2, 0.4, 0.5, 2.0)], "v int, t double")
    assert sorted(r["t"] for r in folds.spaced(times, "t", 0.3, ["v"]).collect()) == [0.0, 0.4, 2.0]
    rows = [(1, at(0, d), 5.0, False, 0.1 * d, d) for d in (1, 2, 3, 9)]
    df = spark.createDataFrame(rows, "g int, t timestamp, d double, f boolean, s double, id int").withColumn("day", F.to_date("t"))
    assert [r["id"] for r in folds.farthest_days(df.withColumn("budget", F.lit(15.0)), "day", "d", "f", "s", ["g"], "id", "budget").orderBy("place").collect()] == [9, 1, 3]
    kinds = spark.createDataFrame([(1, k, c) for k, c in enumerate("aaab")], "g int, k int, c string")
    assert [r["c"] for r in folds.interleaved(kinds, "c", ["g"], ["k"]).orderBy("place").collect()] == ["a", "a", "b", "a"]
    stops = spark.createDataFrame([(1, at(60, d), lat, 2.0, d) for d, lat in ((1, 41.0), (2, 41.01), (3, 45.0), (4, 41.0))], "g int, t timestamp, lat double, lon double, id int")
    assert [r["nights"] for r in folds.overnight_stops(stops, "t", "lat", "lon", ["g"], "id").orderBy("stop").collect()] == [4]
    moving = spark.createDataFrame([(1, at(60, d), 41.0 + d, 2.0, d) for d in (1, 2, 3)], "g int, t timestamp, lat double, lon double, id int")
    assert [(r["nights"], r["lat"]) for r in folds.overnight_stops(moving, "t", "lat", "lon", ["g"], "id").orderBy("stop").collect()] == [(1, 43.0), (2, 44.0)]


def test_selections(spark):
    rows = [(1, k, at(60 * k), 5.0, k == 0, k % 2 == 1, 1.0 - 0.1 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "g int, id int, t timestamp, d double, f boolean, p boolean, s double")
    kept = selection.thinned_favorites(df.withColumn("w", F.col("id") % 2).withColumn("held", F.lit(False)), ["g"], "w", "held", "d", "s", "id", 15.0)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    swept = selection.judged_until_stable(df, ["g"], "t", "f", "s", "id", 0.45)
    assert max(r["id"] for r in swept.collect()) <= 5
    plan = [r["transition"] for r in selection.transitions(df.withColumn("h", F.lit(0)), ["g"], "t", "id", "f", "h").orderBy("id").collect()]
    assert plan == ["fade", "fade", "fade", "cut", "fade", "fade", "fade", "cut"]


def test_sources(spark, tmp_path):
    path = tmp_path / "assets.json"
    path.write_text('{"id":"a","type":"VIDEO","file_created_at":"2024-06-01T10:00:00Z","people":[{"id":"p"},{"id":"q"}],"updated_at":"2024-06-02T00:00:00Z"}\n{"id":"b","type":"odd","file_created_at":"2024-06-03T23:59:59Z","people":[{"id":"p"}]}\n{"id":"c","type":"IMAGE","live_photo_video_id":"a","people":[]}\n')
    got = library.read_assets(spark, str(path)).cache()
    assert {r["id"]: (r["type"], r["width"]) for r in got.collect()} == {"a": ("VIDEO", 0), "b": ("OTHER", 0), "c": ("IMAGE", 0)}
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(library.search(got, persons=["p", "q"], every=True)) == ["a"] and ids(library.search(got, persons=["p", "x"])) == ["a", "b"]
    assert ids(library.search(got, taken_from=F.lit("2024-06-02").cast("date"), taken_to=F.lit("2024-06-03").cast("date"))) == ["b"]
    assert ids(library.live_photos(got)) == ["c"] and sorted(ids(library.without_live_components(got))) == ["b", "c"]
    assert library.changed_since(got, F.lit("2024-06-01").cast("timestamp")) and not library.changed_since(got, F.lit("2025-01-01").cast("timestamp"))
    library.export_json(got.select("id", "type"), str(tmp_path / "out"))
    assert library.import_json(spark, str(tmp_path / "out"), "id string, type string").count() == 3
    (tmp_path / "tree/x").mkdir(parents=True)
    Path(tmp_path / "tree/x/f").write_bytes(b"12345")
    assert [(r["folder"], r["files"], r["bytes"]) for r in library.inventory(spark, str(tmp_path / "tree")).collect()] == [("x", 1, 5)]


def test_streaming_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "days" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(live.buckets(stream, "ts", "40 days"), "days").agg(F.sum("n")).first()[0] == events.count()
    assert run(live.distinct(stream, "ts", "40 days", ["event_id"]), "ids").count() == events.count()
    assert live.moments(stream, "ts", "30 minutes", "1 day", ["user_id"]).isStreaming and live.sliding(stream, "ts", "1 day", "2 days", "1 day").isStreaming
