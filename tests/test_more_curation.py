"""Tempos, plans, thumbnails, bursts, similar hashes, suggestions and texts on small cases."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import calendar, labels, ranges, tempo, text
from mosaiq.operators import selection, sessions, similarity
from mosaiq.plans import detectors
from mosaiq.sources import thumbnails


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("natural", "cadence", "low", "high", "want"), [(123.0, 4.0, 72, 150, 120), (100.0, 0.37, 99, 101, 100), (68.0, 1.0, 68, 132, 68), (70.0, 4.0, 68, 132, 75), (122.5, 0.0, 1, 999, 122), (127.5, 4.0, 72, 150, 120), (0.0, 4.0, 1, 9, 0)])
def test_aligned_tempo(spark, natural, cadence, low, high, want):
    assert one(spark, tempo.aligned(F.lit(natural), F.lit(cadence), low, high)) == want


def test_misfit(spark):
    assert one(spark, tempo.misfit(F.lit(120.0), F.lit(4.0))) == 0 and one(spark, tempo.misfit(F.lit(60.0), F.lit(2.5))) == 0.5
    assert one(spark, tempo.misfit(F.lit(60.0), F.lit(0.0))) is None and one(spark, tempo.misfit(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_planned_timelines(spark):
    rows = [("trip", True, False, 5, 60.0), ("months", False, True, 5, 60.0), ("plain", False, False, 50, 60.0), ("short", False, False, 3, 8.0), ("none", False, False, 0, 0.0)]
    t = spark.createDataFrame(rows, "k string, trip boolean, months boolean, eligible int, target double")
    got = {r["k"]: r for r in selection.planned(t, F.col("target"), 3.5, 4.0, 0.5, fade=0.0).collect()}
    assert (got["trip"]["policy"], got["trip"]["title_budget"], got["trip"]["max_dividers"], got["trip"]["soft_max"]) == ("pending", 7.5, 0, 70.0)
    assert (got["months"]["policy"], got["months"]["reserved"], got["months"]["max_dividers"], got["months"]["content_budget"]) == ("pending", 5, 0, 50.0)
    assert (got["plain"]["policy"], got["plain"]["max_dividers"], got["plain"]["title_budget"], got["plain"]["soft_max"]) == ("capped", 9, 12.0, None)
    assert (got["short"]["title"], got["short"]["ending"], got["short"]["reserved"]) == (1.6, 0.0, 0) and got["none"]["content_budget"] == 0.0
    faded = {r["k"]: r for r in selection.planned(t, F.col("target"), 3.5, 4.0, 0.5).collect()}
    overlap = 0.0
    for _ in range(8):
        overlap = (max(1, -(-(52.5 + overlap) // 5)) + 2 - 1) * 0.5 * 0.7
    assert faded["trip"]["overlap"] == pytest.approx(overlap) and faded["trip"]["content_budget"] == pytest.approx(52.5 + overlap)


def test_thumbnail_store(spark, tmp_path):
    folder, at = str(tmp_path / "store"), datetime(2024, 1, 1)
    rows = [("abc", "small", b"one", at), ("abd", "small", b"two", at + timedelta(1)), ("x", "small", b"", at), ("", "large", b"empty id", at)]
    thumbnails.put(spark.createDataFrame(rows, "asset_id string, size string, content binary, stored_at timestamp"), folder)
    thumbnails.put(spark.createDataFrame([("abc", "small", b"newer one", at + timedelta(2))], "asset_id string, size string, content binary, stored_at timestamp"), folder)
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {"prefix=ab", "prefix=x", "prefix=_"}
    assert {(r["asset_id"], r["bytes"]) for r in thumbnails.listing(spark, folder).collect()} == {("abc", 9), ("abd", 3), ("x", 0), ("", 8)}
    assert "content" not in thumbnails.listing(spark, folder)._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([("abc", "small"), ("abc", "large"), ("zz", "small"), ("x", "small")], "asset_id string, size string")
    assert {(r["asset_id"], r["size"]): r["held"] for r in thumbnails.held(spark, folder, wanted).collect()} == {("abc", "small"): True, ("abc", "large"): False, ("zz", "small"): False, ("x", "small"): True}
    assert {r["asset_id"]: bytes(r["content"]) for r in thumbnails.contents(spark, folder, wanted).collect()} == {"abc": b"newer one", "x": b""}
    assert {r["asset_id"] for r in thumbnails.evicted(spark, folder, 15).collect()} == {"abd", ""} and thumbnails.evicted(spark, folder, 20).count() == 0
    (tmp_path / "tree/ab").mkdir(parents=True)
    (tmp_path / "tree/ab/abc_small.jpg").write_bytes(b"12345")
    (tmp_path / "tree/ab/notes").write_bytes(b"1")
    assert [(r["asset_id"], r["size"], r["bytes"], bytes(r["content"])) for r in thumbnails.tree(spark, str(tmp_path / "tree")).collect()] == [("abc", "small", 5, b"12345")]


def test_bursts_against_a_scan(spark):
    rng = random.Random(3)
    t0, rows = datetime(2024, 1, 1), []
    for g in range(3):
        t = 0
        for k in range(120):
            t += rng.choice([0, 5, 40, 200, 400])
            rows.append((g, 1000 * g + k, t0 + timedelta(seconds=t), rng.choice([None, *[(1 << b) - 1 - (1 << 63) * (b == 63) for b in (3, 9, 20, 40)]]), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, "g int, id int, t timestamp, h long, s double").repartition(3)
    want = set()
    for g in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            near = [] if r[3] is None else [b for b in kept if b["h"] is not None and (r[2] - b["t"]).total_seconds() <= 300 and bin((b["h"] ^ r[3]) & (1 << 64) - 1).count("1") <= 8]
            if not near:
                kept.append({"t": r[2], "h": r[3], "id": r[1], "s": r[4]})
            elif r[4] > near[0]["s"]:
                near[0].update(id=r[1], s=r[4])
        want |= {(g, b["id"], b["s"]) for b in kept}
    assert {tuple(r) for r in sessions.bursts(df, "t", "h", "s", ["g"], "id").collect()} == want
    assert sessions.bursts(df.limit(0), "t", "h", "s", ["g"], "id").count() == 0


@pytest.mark.parametrize("distance", [0, 3, 8, 18])
def test_similar_pairs_against_all_pairs(spark, distance, monkeypatch):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(12)]
    for v in list(values):
        for _ in range(3):
            values.append(((v & (1 << 64) - 1) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 3)))) - (1 << 64) * 0)
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "id int, bits long")
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if bin((values[a] ^ values[b]) & (1 << 64) - 1).count("1") <= distance}
    for rows in (10, 100_000, 10**12):
        of = similarity.parts_of(distance, rows)
        assert sum(bits for _, bits, _ in of) == 64 and sum(r + 1 for *_, r in of) == distance + 1
    assert {(r["id1"], r["id2"]) for r in similarity.similar_pairs(df, "id", "bits", distance).collect()} == want
    few = similarity.parts_of(distance, 3000)
    monkeypatch.setattr(similarity, "parts_of", lambda *_: few)
    assert {(r["id1"], r["id2"]) for r in similarity.similar_pairs(df, "id", "bits", distance).collect()} == want


def test_waiting_and_variety(spark):
    at = lambda d, h=0: datetime(2001, 7, d, h)
    runs = [(1, "monthly", "2001-06", "completed", at(2)), (2, "trip", "7:x", "failed", at(31, 1)), (3, "trip", "7:x", "failed", at(31, 2)), (4, "trip", "8:x", "failed", at(31, 1)), (5, "person", "p3", "completed", at(20)), (6, "trip", "9:x", "failed", at(31, 1)), (7, "trip", "9:x", "failed", at(31, 2)), (8, "trip", "9:x", "completed", at(31, 3)), (9, "burst", "2001-05", "completed", at(1)), (10, "burst", "2001-04", "completed", at(1, 1))]
    runs = spark.createDataFrame(runs, "run_id int, memory_type string, key string, status string, ran timestamp_ntz")
    found = [("trip", "7:x"), ("trip", "8:x"), ("trip", "9:x"), ("person", "p3"), ("person", "p4"), ("multi_person", "3+4"), ("multi_person", "4+5"), ("burst", "2001-07"), ("yearly", "2000"), ("birthday", "b3:2001")]
    df = spark.createDataFrame([(k, key, date(2000, 1, 1), date(2001, 6, 1), 100, 0.5) for k, key in found], "memory_type string, key string, start_date date, end_date date, n_assets long, score double")
    kept = detectors.backed_off(df, runs, "2001-08-01")
    assert {r["key"] for r in df.select("key").collect()} - {r["key"] for r in kept.collect()} == {"7:x"}
    rules = {r["key"]: r["rule"] for r in detectors.varied(kept, runs, "2001-08-01").collect()}
    assert rules == {"8:x": "same_category_as_previous", "9:x": "same_category_as_previous", "p3": "person_in_last_two_person_runs", "p4": None, "3+4": "person_in_last_two_person_runs", "4+5": None, "2001-07": "category_limit_two_of_six", "2000": None, "b3:2001": "person_in_last_two_person_runs"}
    monthly = df.limit(1).select(F.lit("monthly").alias("memory_type"), F.lit("2001-07").alias("key"), "start_date", "end_date", "n_assets", "score")
    assert detectors.varied(monthly, runs, "2001-07-31").first()["rule"] == "monthly_review_already_completed_this_month" and detectors.varied(monthly, runs, "2001-08-01").first()["rule"] is None
    best = detectors.suggested([df], runs, "2001-08-01", 3).collect()
    assert len(best) == 3 and {r["key"] for r in best} <= {"p4", "4+5", "2000"} and detectors.varied(df, runs.limit(0), "2001-08-01").where("rule is not null").count() == 0


def test_birthdays(spark):
    born = spark.createDataFrame([(1, date(1990, 8, 5)), (2, date(1992, 2, 29)), (3, date(1990, 7, 31)), (4, date(1990, 6, 10)), (5, date(1990, 8, 20))], "p int, birth_date date")
    o = spark.createDataFrame([(p, datetime(2001, 1, 1)) for p in (1, 2, 3, 4, 5)], "p int, t timestamp")
    got = {r["key"]: r["end_date"] for r in detectors.birthdays(o, born, "t", "p", "2001-08-01").collect()}
    assert got == {"b1:2001": date(2001, 8, 5), "b4:2001": date(2001, 6, 10)}
    spring = {r["key"]: r["end_date"] for r in detectors.birthdays(o, born, "t", "p", "2001-03-05").collect()}
    assert spring == {"b2:2001": date(2001, 2, 28)}
    people = spark.createDataFrame([("person", f"p{p}", date(2000, 1, 1), date(2001, 1, 1), 9, 0.5) for p in (1, 4, 5)], "memory_type string, key string, start_date date, end_date date, n_assets long, score double")
    assert {r["key"] for r in detectors.without_birthdays(people, born, "p", "2001-08-01").collect()} == {"p4", "p5"}


def test_broken_answers(spark):
    read = lambda t: one(spark, text.partial_analysis(F.lit(t))).asDict()
    got = read('{"description": "a \\"big\\" dog\\nruns", "emotion": 0.85, "quality": 0.7, "category": "pet", "subjects": ["dog", \'cat\', ""], "interest')
    assert (got["description"], got["emotion"], got["quality"], got["category"], got["subjects"], got["confidence"]) == ('a "big" dog runs', "joyful", 0.7, "pet", ["dog", "cat"], 0.6)
    assert read("nothing") == {"description": None, "emotion": "", "interestingness": None, "quality": None, "setting": None, "category": None, "subjects": None, "confidence": 0.4}
    assert read('"emotion": "sad"')["emotion"] == "sad" and read('"emotion": 1.2.3')["emotion"] == ""


def test_recipe_hashes(spark):
    clips = lambda *rows: F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, a, b in rows])
    make = lambda c, kind="trip", **more: one(spark, text.recipe_hash(F.lit(kind), F.lit("2024-01-01"), F.lit(None), F.lit(60.0), c, **more))
    a = make(clips(("x", 0.0, 1.001), ("y", 2.0, 3.0)))
    assert len(a) == 8 and a == make(clips(("x", 0.001, 1.0), ("y", 2.0, 3.0)))
    assert a not in (make(clips(("y", 2.0, 3.0), ("x", 0.0, 1.0))), make(clips(("x", 0.0, 1.02), ("y", 2.0, 3.0))), make(clips(("x", 0.0, 1.0), ("y", 2.0, 3.0)), "album"))
    maps = [F.create_map(*[F.lit(v) for kv in pairs for v in kv]) for pairs in ((("b", "1"), ("a", "2")), (("a", "2"), ("b", "1")))]
    assert make(clips(("x", 0.0, 1.0)), extras=maps[0]) == make(clips(("x", 0.0, 1.0)), extras=maps[1]) != make(clips(("x", 0.0, 1.0)))


def test_moods_are_held_to_their_lists(spark):
    read = lambda t: one(spark, labels.mood(F.lit(t))).asDict()
    plain = {"primary_mood": "calm", "secondary_mood": None, "energy_level": "medium", "tempo_suggestion": "medium", "color_palette": "neutral", "genres": ["ambient"], "description": "", "confidence": 0.7}
    assert read("no json") == plain and read("{}") == plain
    got = read('```json\n{"primary_mood": " Happy", "secondary_mood": "evil", "color_palette": "WARM", "genre_suggestions": ["x", "x", "x", "x", "folk", "jazz"], "confidence": 7, "description": "a\\u0007b"}\n```')
    assert got == plain | {"primary_mood": "happy", "color_palette": "warm", "genres": ["folk"], "confidence": 1.0, "description": "ab"}
    assert read('{"genre_suggestions": "jazz", "confidence": "high"}') == plain


def test_names_of_files(spark):
    def name(kind, names=(), person=None, start=None, end=None, year=None, month=None, season=None, location=None):
        values = [F.lit(kind), F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.lit(person).cast("string"), F.lit(start).cast("date"), F.lit(end).cast("date"), F.lit(year).cast("int"), F.lit(month).cast("int"), F.lit(season).cast("string"), F.lit(location).cast("string")]
        return one(spark, labels.file_name(*values)).removesuffix("_memories.mp4")

    assert name("multi_person", ["Sam", "Noah"], start="2026-03-01", end="2026-03-31") == "sam_noah_march_2026"
    assert name("multi_person", ["A", "B", "C", "D"], year=2020) == "a_b_c_and_others_2020"
    assert name("season", ["Noah"], year=2025, season="summer") == "noah_summer_2025" and name("season", year=2025) == "everyone_2025"
    assert name("year_in_review", person="Sam", start="2025-01-01", end="2025-12-31") == "sam_2025"
    assert name("trip", location="São Paulo, Brasil") == "trip_s_o_paulo_brasil" and name("trip", start="2025-12-30", end="2026-01-02") == "trip_20251230-20260102"
    assert name("monthly_highlights", year=2024, month=2) == "everyone_february_2024" and name("on_this_day", start="2024-02-03") == "everyone_february_3"
    assert name("custom", start="2024-03-01", end="2024-05-02") == "everyone_mar-may_2024" and name("custom") == "everyone"


def test_sounds(spark):
    assert one(spark, labels.sound_weight(F.lit("Giggle"))) == 0.95 and one(spark, labels.sound_weight(F.lit("Doorbell"))) == 0.2 and one(spark, labels.sound_weight(F.lit(None).cast("string"))) == 0.2
    assert one(spark, labels.is_protected(F.lit("Speech"))) and not one(spark, labels.is_protected(F.lit("Rain"))) and one(spark, labels.is_protected(F.lit(None).cast("string"))) is False


def test_requests(spark):
    def asked(kind=None, year=None, month=None, season=None, birthday=None, start=None, end=None, period=None, south=False, person=False, album=None):
        c = lambda v, t: F.lit(v).cast(t)
        named = ranges.inferred_type(c(kind, "string"), c(year, "int"), c(month, "int"), F.lit(person), c(season, "string"), c(birthday, "string"), c(album, "string"))
        found = ranges.resolved(named, c(year, "int"), c(month, "int"), c(season, "string"), c(birthday, "string"), c(start, "string"), c(end, "string"), c(period, "string"), F.lit(south))
        r = spark.range(1).select(named.alias("kind"), found.alias("r")).select("kind", "r.start", "r.end", ranges.divider_mode(F.col("kind"), F.col("r.start"), F.col("r.end")).alias("mode")).first()
        return r["kind"], r["start"] and f"{r['start']}/{r['end']}", r["mode"]

    assert asked(year=2025, month=7) == ("monthly_highlights", "2025-07-01/2025-07-31", "none")
    assert asked(year=2025) == ("year_in_review", "2025-01-01/2025-12-31", "month")
    assert asked(year=2025, person=True) == (None, "2025-01-01/2025-12-31", "month") and asked(year=2025, month=7, album="x")[0] is None
    assert asked(year=2024, birthday="1990-02-07") == (None, "2024-02-07/2025-02-06", "year")
    assert asked("season", 2024, season="winter") == ("season", "2024-12-01/2025-02-28", "none") and asked("season", 2024, season="Autumn")[1] == "2024-09-01/2024-11-30"
    assert asked("season", 2023, season="summer", south=True)[1] == "2023-12-01/2024-02-29" and asked("season", 2023, season="wet")[1] is None and asked("season", season="summer")[1] is None
    assert asked("person_spotlight", 2023, birthday="29/02/1992")[1] == "2023-02-28/2024-02-28" and asked("person_spotlight", 2023, month=3)[1] == "2023-03-01/2023-03-31"
    assert asked("trip", 2023, start="2023-05-02", end="2023-05-09") == ("trip", "2023-05-02/2023-05-09", "none") and asked(start="2023-05-02", period="1y") == (None, "2023-05-02/2024-05-01", "year")
    assert asked("monthly_highlights", 2023)[1] is None and asked("on_this_day", 2023)[2] == "year" and asked() == (None, None, "month") and asked(start="2023-05-02")[1] is None
    assert one(spark, calendar.anniversary(F.lit(None).cast("date"), F.lit(2001))) is None and str(one(spark, calendar.anniversary(F.lit("1992-02-29").cast("date"), F.lit(2001)))) == "2001-02-28"
