"""Whole selections: limits that are conceded one by one, periods, stops, and review until stable."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import folds, ranking, refining
from mosaiq.operators.refining import Names, Wishes

N = Names(["g"], "t", "d", "f", "p", "people", "s", "id")
SCHEMA = "g int, id string, t timestamp, d double, f boolean, p boolean, people boolean, s double"
DAY0 = datetime(2026, 7, 1, 12)


def row(i, minutes=0.0, d=5.0, f=False, p=False, s=0.5, g=1, people=False):
    return (g, i, DAY0 + timedelta(minutes=minutes), d, f, p, people, s)


def fill(spark, rows, chosen, wishes, scarce=False):
    """{id: tier} in the order of picks."""
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.col("id").isin(list(chosen)), "few": F.lit(scarce)})
    got = refining.backfilled(df, N, "c", wishes, "few").orderBy("place", "id").collect()
    return {r["id"]: r["tier"] for r in got}


def test_limits_are_conceded_in_order(spark):
    one = Wishes(12, 100.0, moment_s=600.0, others=0.0)
    # strict refuses what isn't a favorite once the clips that are wished are there
    assert fill(spark, [row("a", f=True), row("b", 60, f=True), row("x", 1440)], "ab", Wishes(2, 15.0, moment_s=0, others=0.0)) == {"a": 0, "b": 0, "x": 2}
    # within ten minutes of a row (the tenth included) only without the distance
    assert fill(spark, [row("a", f=True), row("x", 10, f=True)], "a", one) == {"a": 0, "x": 4}
    assert fill(spark, [row("a", f=True), row("x", 10.1, f=True)], "a", one) == {"a": 0, "x": 1}
    # a photo over the share goes last, without a limit, if 70 % is too little
    assert fill(spark, [row("a", f=True, p=True), row("x", 1440, f=True, p=True)], "a", Wishes(12, 10.0, photos=0.4)) == {"a": 0, "x": 5}
    # two seconds over the time, and no more
    assert fill(spark, [row("a", f=True), row("x", 1440, d=7.0, f=True), row("y", 2880, d=7.1, f=True)], "a", Wishes(12, 10.0)) == {"a": 0, "x": 6}


def test_every_pick_is_strict_again(spark):
    """After a pick that needed a concession a row that now breaks no limit is tier 1, and what was conceded of photos stays conceded."""
    rows = [row("a", f=True), row("b", 100, f=True, p=True), row("video", 5000), row("photo", 9000, f=True, p=True)]
    assert fill(spark, rows, "ab", Wishes(1, 20.0, others=0.0)) == {"a": 0, "b": 0, "video": 2, "photo": 1}
    rows = [row("a", f=True), row("b", 100, f=True), *[row(f"p{k}", 1000 * k + 3000, f=True, p=True, s=0.1 * k) for k in range(5)], row("v", 9500, d=30.0)]
    assert list(fill(spark, rows, "ab", Wishes(2, 25.0, photos=0.3)).items())[2:] == [("p4", 3), ("p1", 1), ("p3", 1)]


def test_a_video_is_added_before_more_photos(spark):
    chosen = [row(f"c{k}", 1440 * k, f=k < 2, p=k % 2 == 0) for k in range(8)]
    rows = [*chosen, row("photo", 30_000, d=4.0, f=True, p=True), row("video", 31_000, d=4.0)]
    assert fill(spark, rows, [f"c{k}" for k in range(8)], Wishes(8, 44.0))["video"] == 2
    # a repeated moment is conceded after more photos
    chosen = [row(f"c{k}", 1440 * k, p=k < 2) for k in range(4)]
    got = fill(spark, [*chosen, row("again", 4, d=4.0), row("photo", 7200, d=4.0, p=True)], [f"c{k}" for k in range(4)], Wishes(10, 24.0, moment_s=300.0))
    assert got["photo"] == 3 and "again" not in got


def test_who_goes_first_within_a_tier(spark):
    base = row("a", f=True)
    assert list(fill(spark, [base, row("star", 60, f=True, s=0.4), row("far", 14400, s=0.9)], "a", Wishes(12, 10.0, moment_s=0)))[1] == "star"
    assert list(fill(spark, [base, row("near", 60, s=0.9), row("far", 14400, s=0.1)], "a", Wishes(12, 10.0, moment_s=0)))[1] == "far"
    assert list(fill(spark, [base, row("photo", 14400, p=True, s=0.9), row("video", 60, s=0.1)], "a", Wishes(12, 10.0, moment_s=0), scarce=True))[1] == "video"


def test_photo_limit_is_a_share_of_what_there_is(spark):
    """One photo beside one other row is half; a smaller share admits none of the kind that is there by 1 at least."""
    rows = [row("a", f=True), row("x", 1440, f=True, p=True)]
    assert fill(spark, rows, "a", Wishes(12, 10.0, photos=0.5)) == {"a": 0, "x": 1}
    assert fill(spark, rows, "a", Wishes(12, 10.0, photos=0.49)) == {"a": 0, "x": 3}


def test_backfill_edges(spark):
    nothing = spark.createDataFrame([], SCHEMA).withColumn("c", F.lit(False))
    assert refining.backfilled(nothing, N, "c", Wishes(3, 9.0)).count() == 0
    rows = [(1, "n", None, 3.0, None, None, None, None), (1, "z", DAY0, 0.0, True, False, True, 0.5), row("a", 1), row("a", 1)]
    got = refining.backfilled(spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit(None).cast("boolean")), N, "c", Wishes(9, 30.0)).collect()
    assert sorted((r["id"], r["tier"]) for r in got) == [("a", 1), ("a", 4), ("n", 1)]


def chosen_by_date(spark, rows, count):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["reason"] for r in refining.distributed(df, N, count, refining.events_of(refining.with_periods(df, N), N)).collect()}


def at(i, year, month, day, **more):
    return (1, i, datetime(year, month, day, more.pop("hour", 0)), 5.0, more.get("f", False), more.get("p", False), more.get("people", False), more.get("s", 0.5))


def test_periods_follow_the_span(spark):
    year = [("jan", 1, 15, 0.5), ("feb", 2, 10, 0.4), ("mar", 3, 20, 0.6), ("jul", 7, 20, 0.5), ("aug", 8, 5, 0.55), ("sep", 9, 12, 0.45)]
    rows = [at(i, 2022, m, d, s=s) for i, m, d, s in year] + [at(i, 2022, m, d, f=True, s=0.8) for i, m, d in (("apr", 4, 10), ("may", 5, 15), ("oct", 10, 5), ("dec", 12, 25))]
    got = chosen_by_date(spark, rows, 10)
    assert {"jan", "feb", "mar"} & set(got) and {"jul", "aug", "sep"} & set(got)
    week = [at(f"f{k}", 2023, 9, 23 + k // 3, hour=k % 3, f=True, s=0.9) for k in range(5)] + [at(f"d{k}", 2023, 9, 25 + k, s=0.4 - 0.05 * k) for k in range(5)]
    assert len({i for i in chosen_by_date(spark, week, 7) if i[0] == "d"}) >= 3
    rows = [at("jan", 2022, 1, 15, s=0.3), at("jul", 2022, 7, 20, s=0.35), at("sep", 2022, 9, 12, s=0.32), at("dec", 2022, 12, 25, f=True, s=0.8), *[at(f"f{k}", 2022, 4, 10 + k, f=True, s=0.9) for k in range(2)], *[at(f"n{k}", 2022, 4, 15 + k, s=0.8) for k in range(3)]]
    got = chosen_by_date(spark, rows, 6)
    assert "jan" in got and {"jul", "sep"} & set(got)
    far = spark.createDataFrame([at("a", 2020, 1, 1), at("b", 2022, 5, 1)], SCHEMA)
    assert {r["__period"] for r in refining.with_periods(far, N).collect()} == {"2020-Q1", "2022-Q2"}


def test_without_favorites_the_densest_periods_come_first(spark):
    rows = [at(f"d{k}", 2024, 5, 3, hour=k % 24, s=0.1 + 0.01 * k) for k in range(9)] + [at(f"q{k}", 2024, 5, 4 + k, s=0.9 - 0.01 * k) for k in range(6)]
    got = chosen_by_date(spark, rows, 4)
    assert got == {"d8": "period", "q0": "period", "q1": "score", "q2": "score"}
    peopled = [(*r[:6], True, r[7]) for r in rows]
    assert [i for i, why in chosen_by_date(spark, peopled, 8).items() if why == "period" and i[0] == "d"].__len__() == 3
    assert set(chosen_by_date(spark, [at("jan", 2022, 1, 15, s=0.3), *[at(f"apr{k}", 2022, 4, 10 + k, s=0.9) for k in range(3)], at("oct", 2022, 10, 1, s=0.2)], 3)) >= {"apr0"}


def test_periods_survive_the_fitting(spark):
    """Months without favorites stay in a cut that the favorites alone would fill."""
    stars = [at(f"f{m}{k}", 2023, m, d + k, f=True, s=0.8 + 0.02 * k) for m, d in ((1, 5), (4, 10), (5, 15), (7, 20), (9, 1), (12, 20)) for k in range(3)]
    rows = [*stars, at("mar", 2023, 3, 15, s=0.3), at("aug", 2023, 8, 10, s=0.35), at("oct", 2023, 10, 5, s=0.32)]
    got = refining.refined(spark.createDataFrame(rows, SCHEMA), N, Wishes(12, 60.0)).collect()
    assert {"mar", "aug", "oct"} <= {r["id"] for r in got} and len(got) * 5 <= 62
    assert [r["place"] for r in sorted(got, key=lambda r: next(x[2] for x in rows if x[1] == r["id"]))] == list(range(1, len(got) + 1))


def test_time_outweighs_what_is_held(spark):
    rows = [(*row(f"k{k}", 1440 * k, s=k / 10), True) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", __held boolean")
    assert refining.fitted(df, N, 10.0).count() == 2
    ten = spark.createDataFrame([(*row(f"k{k}", 1440 * k, s=k / 10), False) for k in range(10)], SCHEMA + ", __held boolean")
    assert refining.fitted(ten, N, 48.0).count() == 9 and refining.fitted(ten, N, 50.0).count() == 10


@pytest.mark.parametrize(("count", "nights", "want"), [(10, [3, 1], [7, 3]), (10, [2, 2, 2], [4, 3, 3]), (2, [5, 1, 1], [1, 1, 0]), (3, [5, 1, 1], [1, 1, 1]), (7, [0, 0], [4, 3]), (20, [7, 3, 1], [12, 6, 2])])
def test_places_by_nights(spark, count, nights, want):
    stops = spark.createDataFrame([(1, k, n) for k, n in enumerate(nights)], "g int, stop int, nights int")
    got = refining.places_by_nights(stops, ["g"], "stop", "nights", count).orderBy("stop").collect()
    assert [r["places"] for r in got] == want


def test_rows_at_stops(spark):
    stops = spark.createDataFrame([(1, 0, datetime(2026, 7, 1).date(), datetime(2026, 7, 3).date(), 3), (1, 1, datetime(2026, 7, 3).date(), datetime(2026, 7, 6).date(), 3), (1, 2, datetime(2026, 7, 12).date(), datetime(2026, 7, 12).date(), 1)], "g int, stop int, start_date date, end_date date, nights int")
    df = spark.createDataFrame([row(f"{k:02}", 1440 * k) for k in (-3, 0, 2, 4, 8, 9, 20)] + [row("lone", g=2)], SCHEMA)
    got = {r["id"]: r["stop"] for r in refining.at_stops(df, stops, N, "stop", "start_date", "end_date").collect()}
    assert got == {"-3": 0, "00": 0, "02": 0, "04": 1, "08": 1, "09": 2, "20": 2, "lone": None}
    assert {r["id"] for r in refining.by_stops(df, stops, N, 4).collect()} == {"-3", "00", "04", "09"}


def test_reviewed(spark):
    """What takes the place of a row that was dropped is looked at before it is judged, and a favorite stays whatever its score."""
    rows = [(*row("star", 0, f=True, s=0.05), 0.05, True), (*row("good", 10, s=0.9), 0.9, True), (*row("hidden", 20, s=0.8), 0.1, False), (*row("next", 30, s=0.7), 0.2, False), (*row("last", 40, s=0.6), 0.65, False), (*row("spare", 50, s=0.1), 0.5, False)]
    df = spark.createDataFrame(rows, SCHEMA + ", real double, seen boolean")
    best = lambda pool: ranking.top_per(pool, ["g"], [F.desc("f"), F.desc("s"), F.col("id")], 3)
    assert {r["id"] for r in refining.reviewed(df, N, best, "seen", "real").collect()} == {"star", "good", "last"}
    # with one pass what was dropped is replaced, and that is final
    assert {r["id"] for r in refining.reviewed(df, N, best, "seen", "real", passes=1).collect()} <= {"star", "good", "hidden", "next", "last"}
    assert refining.reviewed(df.limit(0), N, best, "seen", "real").count() == 0
    refined = lambda pool: refining.refined(pool, N, Wishes(3, 15.0))
    assert {r["id"] for r in refining.reviewed(df, N, refined, "seen", "real", passes=2).collect()} >= {"star", "good"}


def test_farthest_days_against_a_scan(spark):
    import random

    rng = random.Random(8)
    rows = [(g, f"{k:03}", DAY0 + timedelta(hours=rng.randrange(900)), float(rng.randrange(1, 9)), rng.random() < 0.2, False, False, rng.randrange(9) / 10) for g in range(6) for k in range(rng.choice([1, 7, 60]))]
    got = {}
    for r in folds.farthest_days(spark.createDataFrame(rows, SCHEMA).withColumn("b", F.lit(60.0)), "t", "d", "f", "s", ["g"], "id", "b").orderBy("place").collect():
        got.setdefault(r["g"], []).append(r["id"])
    for g in got:
        own, left, want = [r for r in rows if r[0] == g], 60.0, []
        while fits := [r for r in own if r not in want and r[3] <= left]:
            days = lambda r: min((round(abs((r[2] - w[2]).total_seconds()) / 86400) for w in want), default=0)  # noqa: B023, E731
            best = min(fits, key=lambda r: (-days(r), not r[4], -r[7], r[1]))
            want.append(best)
            left -= best[3]
        assert got[g] == [r[1] for r in want]


def test_backfill_asks_once_a_step_for_what_rows_share(spark):
    """Lambdas are interpreted, so what stands twice in the fold runs twice for every row: the time that is left and the distance were asked for in up to twelve places."""
    df = spark.createDataFrame([row("a", f=True), row("b", 60)], SCHEMA).withColumns({"c": F.col("id") == "a", "few": F.lit(False)})
    plan = refining.backfilled(df, N, "c", Wishes(12, 77.0), "few")._jdf.queryExecution().analyzed().toString()
    assert plan.count("77.0 - ") <= 3
    assert plan.count("> 600.0") <= 2


def test_tiers_where_amounts_or_times_are_missing(spark):
    """Rows of no amount or none known are never added, rows without a time are near nothing; chosen rows alone stay as they are."""
    rows = [row("a", f=True), row("none", 100, d=None), row("nothing", 200, d=0.0), (1, "timeless", None, 5.0, False, False, False, 0.5), row("near", 5)]
    assert fill(spark, rows, "a", Wishes(12, 11.0)) == {"a": 0, "timeless": 1}
    assert fill(spark, [row("a", f=True), row("b", 60)], "ab", Wishes(12, 100.0)) == {"a": 0, "b": 0}
