"""Choices that depend on what was chosen before: folds over a key's rows in order, and grouped functions for what has no fold.

Each key's rows meet in one task, so keys are to be videos, trips or owners, not whole libraries.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaiq.functions import geo


def spaced(df: DataFrame, time: str, least: float, by: list[str]) -> DataFrame:
    """Times that lie at least so far after the last one kept; the first of each key stays."""
    folded = df.groupBy(*by).agg(F.array_sort(F.array_agg(F.col(time).cast("double"))).alias("ts")).withColumn(
        "ts", F.aggregate("ts", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.get(a, F.size(a) - 1) >= least), F.concat(a, F.array(t))).otherwise(a))
    )
    return folded.select(*by, F.explode("ts").alias(time))


def boundaries(visual: DataFrame, audio: DataFrame, time: str, by: list[str], length: str, tolerance: float, least: float = 0.3) -> DataFrame:
    """Cut points: visual ones, audio ones (both where they lie within the tolerance), the ends; then those spaced by least."""
    ends = visual.select(*by, F.explode(F.array(F.lit(0.0), F.col(length).cast("double"))).alias(time)).distinct()
    v = visual.select(*by, F.col(time).cast("double").alias(time))
    near = v.select(*by, F.col(time).alias("__v"))
    lone = audio.select(*by, F.col(time).cast("double").alias(time)).alias("x").join(near.alias("y"), [F.col(f"x.{b}") == F.col(f"y.{b}") for b in by] + [F.abs(F.col(f"x.{time}") - F.col("__v")) <= tolerance], "left_anti")
    return spaced(v.unionByName(lone).unionByName(ends), time, least, by)


def day_slots(df: DataFrame, day: str, by: list[str], target: int) -> DataFrame:
    """Slots per day: an even base, twice that on days of over 1.5 times the average, as far as supply and the target reach; what is left goes to the largest days.

    Both passes hand out in order until nothing is left, so a running sum of what is wished before a day tells what it gets.
    """
    counts = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)
    base = F.greatest(F.lit(1), F.floor(F.lit(target) / F.count(F.lit(1)).over(whole)))
    wished = counts.withColumn("__wish", F.least(F.when(F.col("n") > 1.5 * F.avg("n").over(whole), 2 * base).otherwise(base), F.col("n")))
    before = lambda c, *order: F.coalesce(F.sum(c).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = wished.withColumn("__slots", F.greatest(F.lit(0), F.least("__wish", target - before("__wish", day)))).withColumn("__room", F.col("n") - F.col("__slots"))
    left = target - F.sum("__slots").over(whole)
    more = F.greatest(F.lit(0), F.least("__room", left - before("__room", F.desc("n"), day)))
    return first.withColumn("slots", (F.col("__slots") + more).cast("int")).drop("__wish", "__slots", "__room")


def farthest_of(at: np.ndarray, amounts: np.ndarray, left: float) -> list[int]:
    """Places, in the order of the choice, of the rows that farthest_days chooses of one key; rows are in the order of their worth.

    Chosen times part the rows into gaps. A heap holds the best row of each gap; choosing it parts its gap in two, and one
    that no longer fits gives way to the next of its gap, so a row is looked at about log n times.
    """
    order = np.argsort(at, kind="stable")  # a row's rank is its place, the smaller the better
    at, amounts = at[order], amounts[order]
    chosen, heap = [], []

    def offer(low: int, high: int, before: float, after: float) -> None:
        """Puts the best row that fits of order[low:high] on the heap."""
        fits = low + np.flatnonzero(amounts[low:high] <= left)
        if fits.size:
            days = np.rint(np.minimum(at[fits] - before, after - at[fits]) / 86400)
            far = fits[days == days.max()]
            best = far[np.argmin(order[far])]
            heapq.heappush(heap, (-days.max(), order[best], best, low, high, before, after))

    offer(0, len(at), -np.inf, np.inf)
    while heap:
        _, rank, best, low, high, before, after = heapq.heappop(heap)
        if amounts[best] > left:
            offer(low, high, before, after)
            continue
        chosen.append(int(rank))
        left -= amounts[best]
        offer(low, best, before, at[best])
        offer(best + 1, high, at[best], after)
    return chosen


def farthest_days(df: DataFrame, time: str, amount: str, favorite: str, score: str, by: list[str], tie: str, budget: str, second: str | None = None, whole: str | None = None) -> DataFrame:
    """Again and again the row that is most days (rounded) from the rows chosen (then favorites, then scores), while it fits the key's budget (a column).

    second: rows where it holds are chosen after the others, among themselves, from what those left of a budget (the column whole).
    Rows are sorted by key and worth, and a task goes through them in batches; it holds one key at a time.
    """
    schema = df.select(*by, tie).schema.add("place", "integer")
    number = F.nanvl(F.col(score), F.lit(None).cast(df.schema[score].dataType)) if df.schema[score].dataType.typeName() in ("double", "float") else F.col(score)
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(favorite), number.desc_nulls_last(), F.asc_nulls_last(tie))
    seconds = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 63))) / 1e6
    values = [F.row_number().over(w).alias("__rank"), seconds.alias("__at"), F.col(amount).cast("double").alias("__amount"), F.col(budget).cast("double").alias("__left"), (F.col(second) if second else F.lit(False)).alias("__second"), F.col(whole or budget).cast("double").alias("__whole")]
    n = len(by) + 1

    def choose(rows: pa.Table) -> list:
        at, amounts, left, later, most = (rows.column(c).to_numpy() for c in ("__at", "__amount", "__left", "__second", "__whole"))
        one, other = np.flatnonzero(~later), np.flatnonzero(later)
        first = farthest_of(at[one], amounts[one], left[0]) if len(one) else []
        more = farthest_of(at[other], amounts[other], most[0] - sum(amounts[one[first]])) if len(other) else []
        found = pa.array([*one[first], *other[more]], pa.int64())
        places = pa.array([*range(1, len(first) + 1), *range(1, len(more) + 1)], pa.int32())
        return [*[rows.column(k).take(found) for k in range(n)], places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [*by, tie, "place"], []

        def out(groups: list[list]) -> Iterator[pa.RecordBatch]:
            if groups:
                yield from pa.Table.from_arrays([pa.chunked_array([c for g in groups for c in (g[k].chunks if isinstance(g[k], pa.ChunkedArray) else [g[k]])]) for k in range(n + 1)], names=names).combine_chunks().to_batches()

        for batch in batches:
            starts = np.flatnonzero(batch.column(n).to_numpy() == 1)
            edges, groups = [0, *starts, batch.num_rows], []
            for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if k and held:
                    groups.append(choose(pa.Table.from_batches(held)))
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
            yield from out(groups)
        if held:
            yield from out([choose(pa.Table.from_batches(held))])

    return df.select(*by, tie, *values).mapInArrow(run, schema)


def tempo(energy: Column, step_s: float = 0.1, low: int = 2, high: int = 40) -> Column:
    """Beats a minute of an energy curve (array<double>), by the lag at which its rises match themselves best; null for a flat or short one."""
    n = F.size(energy)
    rises = F.transform(energy, lambda e, k: F.greatest(e - F.get(energy, F.greatest(k - 1, F.lit(0))), F.lit(0.0)))

    def best(up: Column) -> Column:
        mean = F.aggregate(up, F.lit(0.0), lambda s, x: s + x) / n
        match = lambda lag: F.aggregate(F.sequence(lag, n - 1), F.lit(0.0), lambda s, k: s + (F.get(up, k) - mean) * (F.get(up, k - lag) - mean))
        lags = F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n - 1) - 1), lambda lag: F.struct((-F.round(match(lag), 6)).alias("s"), lag.alias("lag")))
        return F.when((n - 1 > low) & (F.array_max(up) > 0), F.round(60 / (F.array_min(lags)["lag"] * step_s), 1))

    return F.transform(F.array(rises), best)[0]


def places_of_days(df: DataFrame, time: str, lat: str, lon: str, by: list[str], tie: str, radius_km: float = 20.0) -> DataFrame:
    """The places of a trip, in order: place, lat and lon (means), days (array<date>), n, span (days of the trip) and is_base.

    In order, a row joins the nearest seed within the radius (of ones equally near to a
    millimetre the first), else it is a seed. A place is a base if it has rows on three days and on
    30 % of the trip's, or on days more than two apart. A fold over a trip's rows.
    """
    place = "struct<lat:double,lon:double,slat:double,slon:double,n:int,days:array<date>>"
    kind = f"array<{place}>"
    row = F.struct(F.col(time).alias("t"), F.col(tie).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))

    def add(places, r):
        far = F.transform(places, lambda p, k: F.struct(F.round(geo.haversine_km(r["lat"], r["lon"], p["lat"], p["lon"]), 6).alias("km"), k.alias("k")))
        best = F.array_min(far)
        day = F.to_date(r["t"])
        joined = F.transform(places, lambda p, k: F.when(k == best["k"], F.struct(p["lat"], p["lon"], p["slat"] + r["lat"], p["slon"] + r["lon"], p["n"] + 1, F.array_union(p["days"], F.array(day))).cast(place)).otherwise(p))
        seed = F.array(F.struct(r["lat"], r["lon"], r["lat"], r["lon"], F.lit(1), F.array(day)).cast(place))
        return F.when(best["km"] <= radius_km, joined.cast(kind)).otherwise(F.concat(places, seed.cast(kind)))

    folded = df.groupBy(*by).agg(F.array_sort(F.array_agg(row)).alias("rows"))
    span = F.datediff(F.to_date(F.element_at("rows", -1)["t"]), F.to_date(F.get("rows", F.lit(0))["t"])) + 1
    placed = folded.select(*by, span.alias("span"), F.posexplode(F.aggregate("rows", F.array().cast(kind), add)).alias("place", "p"))
    days = F.array_sort("p.days")
    returns = F.exists(F.sequence(F.lit(1), F.size(days) - 1), lambda k: F.datediff(F.get(days, k), F.get(days, k - 1)) > 2)
    enough = F.size(days) >= F.greatest(F.lit(3), F.ceil(F.col("span") * 0.3))
    base = enough | ((F.size(days) > 1) & returns)
    return placed.select(*by, "place", (F.col("p.slat") / F.col("p.n")).alias("lat"), (F.col("p.slon") / F.col("p.n")).alias("lon"), days.alias("days"), F.col("p.n").alias("n"), "span", base.alias("is_base"))


def daily_stops(df: DataFrame, bases: DataFrame, time: str, lat: str, lon: str, by: list[str], tie: str, radius_km: float = 20.0) -> DataFrame:
    """day, lat and lon of where each day of a trip ended: the first base that has the day and is near its last row, else where the next day begins."""
    points = df.withColumn("day", F.to_date(time)).groupBy(*by, "day").agg(*[f(F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")), F.struct(time, tie)).alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))])
    following = F.coalesce(F.lead("first").over(Window.partitionBy(*by).orderBy("day")), F.col("last"))
    stops = points.withColumn("else", following)
    held = bases.where("is_base").select(*by, "place", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.explode("days").alias("day"))
    near = geo.haversine_km(F.col("last.lat"), F.col("last.lon"), F.col("b_lat"), F.col("b_lon")) <= radius_km
    met = stops.join(held, [*by, "day"]).where(near).groupBy(*by, "day").agg(F.min_by(F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")), "place").alias("base"))
    at = F.coalesce("base", "else")
    return stops.join(met, [*by, "day"], "left").select(*by, "day", at["lat"].alias("lat"), at["lon"].alias("lon"))


def merged_stops(stops: DataFrame, by: list[str], radius_km: float = 20.0) -> DataFrame:
    """stop, start_date, end_date, nights, lat and lon: runs of days (day, lat, lon) near the head of the run, and what lies between two stays at one place taken into it, until nothing changes.

    A fold over a trip's days; a trip has few.
    """
    kind = "array<struct<start_date:date,end_date:date,nights:int,lat:double,lon:double>>"
    near = lambda a, b: geo.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) <= radius_km
    grown = lambda a, end, nights: F.struct(a["start_date"].alias("start_date"), end.alias("end_date"), (a["nights"] + nights).cast("int").alias("nights"), a["lat"].alias("lat"), a["lon"].alias("lon"))

    def consecutive(runs, d):
        head = F.element_at(runs, -1)
        start = F.struct(d["day"].alias("start_date"), d["day"].alias("end_date"), F.lit(1).alias("nights"), d["lat"].alias("lat"), d["lon"].alias("lon"))
        own = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown(head, d["day"], F.lit(1))).cast(kind))
        return F.when((F.size(runs) > 0) & near(F.get(runs, F.size(runs) - 1), d), own).otherwise(F.concat(runs, F.array(start).cast(kind)))

    state = f"struct<runs:{kind},changed:boolean>"

    def taken_in(now, i):
        """Run i with the first later run at its place that isn't its neighbour, and what lies between, as one."""
        runs = now["runs"]
        later = F.filter(F.when(i + 2 < F.size(runs), F.sequence(i + 2, F.size(runs) - 1)).otherwise(F.array().cast("array<int>")), lambda j: near(F.get(runs, i), F.get(runs, j)))
        j = F.get(later, F.lit(0))
        nights = F.aggregate(F.slice(runs, i + 2, j - i), F.lit(0), lambda a, r: a + r["nights"])
        one = F.array(grown(F.get(runs, i), F.get(runs, j)["end_date"], nights)).cast(kind)
        return F.when(F.size(later) > 0, F.struct(F.concat(F.slice(runs, 1, i), one, F.slice(runs, j + 2, F.size(runs))), F.lit(True)).cast(state)).otherwise(now)

    def one_pass(now, _):
        places = F.sequence(F.lit(0), F.size(now["runs"]) - 1)
        return F.when(now["changed"], F.aggregate(places, F.struct(now["runs"], F.lit(False)).cast(state), taken_in)).otherwise(now)

    days = F.array_sort(F.array_agg(F.struct("day", "lat", "lon")))
    first = stops.groupBy(*by).agg(days.alias("days")).withColumn("runs", F.aggregate("days", F.array().cast(kind), consecutive))
    begun = F.struct(F.col("runs"), F.lit(True)).cast(state)  # a pass that changes something takes a run away, so there are fewer passes than runs
    whole = first.withColumn("runs", F.aggregate("runs", begun, one_pass, lambda now: now["runs"]))
    return whole.select(*by, F.posexplode("runs").alias("stop", "r")).select(*by, "stop", "r.*")


def overnight_stops(df: DataFrame, time: str, lat: str, lon: str, by: list[str], tie: str, radius_km: float = 20.0) -> DataFrame:
    """Where a trip's nights were spent, in runs of days: places, the bases among them, where each day ended, and runs of days merged."""
    bases = places_of_days(df, time, lat, lon, by, tie, radius_km)
    return merged_stops(daily_stops(df, bases, time, lat, lon, by, tie, radius_km), by, radius_km)


def place_counts(df: DataFrame, lat: str, lon: str, city: str, by: list[str], order: list[str], km: float = 5.0) -> DataFrame:
    """places of each key, most rows first (then as they appeared): city, lat, lon and n.

    In order, a row counts for the first place less than km away, else it is a place
    itself. Rows whose latitude is null or zero have no place; a longitude of null is 0.
    """
    kind = "array<struct<city:string,lat:double,lon:double,n:int>>"
    row = F.struct(*order, F.coalesce(F.col(city), F.lit("Unknown")).alias("__city"), F.col(lat).cast("double").alias("__lat"), F.coalesce(F.col(lon).cast("double"), F.lit(0.0)).alias("__lon"))

    def add(places, r):
        near = F.transform(places, lambda p: geo.haversine_km(r["__lat"], r["__lon"], p["lat"], p["lon"]) < km)
        at = F.array_position(near, F.lit(True))
        counted = F.transform(places, lambda p, k: F.struct(p["city"].alias("city"), p["lat"].alias("lat"), p["lon"].alias("lon"), (p["n"] + (k + 1 == at).cast("int")).alias("n")))
        fresh = F.array(F.struct(r["__city"].alias("city"), r["__lat"].alias("lat"), r["__lon"].alias("lon"), F.lit(1).alias("n")))
        return F.when(at > 0, counted).otherwise(F.concat(places, fresh)).cast(kind)

    placed = df.where(F.col(lat).isNotNull() & (F.col(lat) != 0))
    folded = placed.groupBy(*by).agg(F.array_sort(F.array_agg(row)).alias("places")).withColumn("places", F.aggregate("places", F.array().cast(kind), add))
    ranked = F.array_sort(F.transform("places", lambda p, k: F.struct((-p["n"]).alias("most"), k.alias("k"), p.alias("place"))))
    return folded.select(*by, F.transform(ranked, lambda x: x["place"]).alias("places"))


def interleaved(df: DataFrame, kind: str, by: list[str], order: list[str]) -> DataFrame:
    """place: the rows in order, but no more than two of a kind in a row while another can be moved forward.

    Each kind's rows wait in a queue of their own, and the next row is the earliest of all queues, or of the other queues after two of a kind.
    """
    schema = StructType([*df.schema.fields]).add("place", "integer")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        queues = [deque(q) for q in rows.groupby(kind, sort=False, dropna=False).indices.values()]
        places, last, run = [], None, 0
        for _ in range(len(rows)):
            ready = [q for q in queues if q]
            others = [q for q in ready if q is not last] if run >= 2 else ready
            queue = min(others or ready, key=lambda q: q[0])
            run, last = run + 1 if queue is last else 1, queue
            places.append(queue.popleft())
        out = rows.iloc[places].copy()
        out["place"] = pd.Series(range(len(places)), index=out.index, dtype="int32")
        return out

    return df.groupBy(*by).applyInPandas(merge, schema)
