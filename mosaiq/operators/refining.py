"""A key's whole selection: spread over its periods, fitted to a time, thinned, and filled again while room is left.

Keys are owners or trips. Ranks and shares are windows over a key's rows; choices that depend on all earlier ones are
folds over them (`aggregate`), so no Python runs but in `folds.farthest_days`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import calendar
from mosaiq.functions.boundaries import let
from mosaiq.operators import ranking, selection, sessions
from mosaiq.operators.checkpoints import written

#: Rows that a period of an event may have where others have one, and photos of a day (three times as many on event days).
EVENT_ROWS, PHOTOS_A_DAY, EVENT_FACTOR = 3, 2, 3
#: What backfill concedes at most: the share of photos in its third tier, and seconds over the budget in its last.
MORE_PHOTOS, OVERRUN_S = 0.70, 2.0


@dataclass(frozen=True)
class Names:
    """The columns of a pool of rows."""

    by: list[str]
    time: str = "taken_at"
    amount: str = "duration"
    favorite: str = "favorite"
    photo: str = "photo"
    people: str = "people"
    score: str = "score"
    tie: str = "asset_id"

    def best(self) -> list[Column]:
        return [F.desc(self.score), F.col(self.tie)]

    def keys(self) -> list[str]:
        return [*self.by, self.tie]


@dataclass(frozen=True)
class Wishes:
    """What a selection is to hold; photos or others of 1 or more is no limit."""

    clips: int
    seconds: float
    overrun: float = 0.0
    moment_s: float = 600.0
    others: float = 0.7
    photos: float = 0.5


def with_periods(df: DataFrame, n: Names) -> DataFrame:
    """df with __period: days, ISO weeks, months or quarters by the span of the key's rows in whole days."""
    of = Window.partitionBy(*n.by)
    micros = F.unix_micros(F.col(n.time).cast("timestamp"))
    span = F.floor((F.max(micros).over(of) - F.min(micros).over(of)) / 86_400_000_000)
    return df.withColumn("__period", calendar.period_key(F.col(n.time), span))


def events_of(df: DataFrame, n: Names, period: str = "__period") -> DataFrame:
    """by and period of events: at most two periods of three times the upper median of rows, with people on a tenth of them."""
    return ranking.event_periods(df, period, n.by, F.col(n.people)).select(*n.by, period)


def capped_photos(df: DataFrame, n: Names) -> DataFrame:
    """df without photos beyond the best of each day: two, or six on days that stand out among the days of photos."""
    photos = df.where(F.col(n.photo)).withColumn("__day", F.to_date(n.time))
    events = events_of(photos, n, "__day").withColumn("__event", F.lit(True))
    most = F.when(F.col("__event"), PHOTOS_A_DAY * EVENT_FACTOR).otherwise(PHOTOS_A_DAY)
    kept = ranking.top_per(photos.join(events, [*n.by, "__day"], "left"), [*n.by, "__day"], n.best(), most)
    return df.where(~F.col(n.photo)).unionByName(kept.select(*df.columns))


def densest_first(df: DataFrame, n: Names, count: int) -> DataFrame:
    """keys and reason of a selection from rows without favorites (with __period and __event).

    Half of the places are held for the periods of most rows, their best row each (three in events); the rest goes by score.
    """
    of, in_period = Window.partitionBy(*n.by), Window.partitionBy(*n.by, "__period")
    sized = df.withColumn("__size", F.count(F.lit(1)).over(in_period)).withColumn("__nth", F.row_number().over(in_period.orderBy(*n.best())))
    dense = F.dense_rank().over(of.orderBy(F.desc("__size"), "__period"))
    held = (dense <= max(1, count // 2)) & (F.col("__nth") <= F.when(F.col("__event"), EVENT_ROWS).otherwise(1))
    marked = sized.withColumn("__held", held)
    left = count - F.count_if("__held").over(of)
    place = F.row_number().over(Window.partitionBy(*n.by, "__held").orderBy(*n.best()))
    chosen = marked.withColumn("__in", F.col("__held") | (place <= left)).where("__in")
    return chosen.select(*n.keys(), F.when(F.col("__held"), "period").otherwise("score").alias("reason"))


def distributed(df: DataFrame, n: Names, count: int, events: DataFrame) -> DataFrame:
    """keys and reason of a selection spread over time: from the favorites of keys that have some, else from the densest periods.

    events: by and __period, measured before photos were capped.
    """
    of = Window.partitionBy(*n.by)
    marked = with_periods(df, n).join(events.withColumn("__event", F.lit(True)), [*n.by, "__period"], "left").withColumn("__event", F.coalesce("__event", F.lit(False)))
    pool = written(marked.withColumn("__starred", F.max(n.favorite).over(of)))
    starred = selection.favorites_first(pool.where("__starred"), n.by, n.time, F.col("__period"), n.amount, n.favorite, n.score, n.tie, count, event=F.col("__event"), event_rows=EVENT_ROWS, unit=1.0)
    return starred.unionByName(densest_first(pool.where("not __starred"), n, count))


def places_by_nights(stops: DataFrame, by: list[str], stop: str, nights: str, count: int) -> DataFrame:
    """stops with places: one each (the first ones, if there are more stops than places), the rest by nights, what is left over to the longest."""
    of = Window.partitionBy(*by)
    n, all_nights = F.count(F.lit(1)).over(of), F.sum(nights).over(of)
    nth, longest = F.row_number().over(of.orderBy(stop)), F.row_number().over(of.orderBy(F.desc(nights), stop))
    counted = stops.withColumns({"__n": n, "__nth": nth, "__longest": longest, "__own": F.when(all_nights > 0, F.floor((count - n) * F.col(nights) / all_nights)).otherwise(0)})
    over = count - F.col("__n") - F.sum("__own").over(of)
    more = F.floor(over / F.col("__n")) + (F.col("__longest") <= over % F.col("__n")).cast("int")
    places = F.when(F.col("__n") >= count, (F.col("__nth") <= count).cast("long")).otherwise(1 + F.col("__own") + more)
    return counted.withColumn("places", places.cast("int")).drop("__n", "__nth", "__longest", "__own")


def at_stops(df: DataFrame, stops: DataFrame, n: Names, stop: str, start: str, end: str) -> DataFrame:
    """df with the stop of each row: the first that holds its day, else the one whose first or last day is nearest; null without stops.

    A key's stops travel as one array, so rows are not multiplied.
    """
    lists = stops.groupBy(*n.by).agg(F.array_sort(F.array_agg(F.struct(F.col(stop).alias("stop"), F.col(start).alias("start"), F.col(end).alias("end")))).alias("__stops"))
    day = F.to_date(n.time)

    def distance(s: Column) -> Column:
        inside = (s["start"] <= day) & (day <= s["end"])
        return F.struct(F.when(inside, -1).otherwise(F.least(F.abs(F.datediff(day, s["start"])), F.abs(F.datediff(day, s["end"])))).alias("days"), s["stop"].alias("stop"))

    return df.join(lists, n.by, "left").withColumn(stop, F.array_min(F.transform("__stops", distance))["stop"]).drop("__stops")


def by_stops(df: DataFrame, stops: DataFrame, n: Names, count: int) -> DataFrame:
    """keys and reason of a trip's selection: each overnight stop (stop, start_date, end_date, nights) has places by its nights, for its best rows."""
    budget = places_by_nights(stops, n.by, "stop", "nights", count).select(*n.by, "stop", "places")
    placed = at_stops(df, stops, n, "stop", "start_date", "end_date").join(budget, [*n.by, "stop"])
    return ranking.top_per(placed, [*n.by, "stop"], n.best(), F.col("places")).select(*n.keys(), F.lit("stop").alias("reason"))


def fitted(df: DataFrame, n: Names, allowed: float) -> DataFrame:
    """keys of the rows (with __held) that stay when a key's time is cut to what is allowed.

    Held rows, favorites and a month's only row stay first; others follow by score as they still fit. Where those
    that stay first don't fit themselves, favorites have the time (70 % of it if more than a month is spanned), spread over days.
    """
    of = Window.partitionBy(*n.by)
    alone = F.count(F.lit(1)).over(Window.partitionBy(*n.by, F.date_format(n.time, "yyyy-MM"))) == 1
    first = df.withColumn("__first", alone | F.col(n.favorite) | F.col("__held"))
    summed = written(first.withColumns({"__all": F.sum(n.amount).over(of), "__firsts": F.coalesce(F.sum(F.when(F.col("__first"), F.col(n.amount))).over(of), F.lit(0.0))}))
    whole = summed.where(F.col("__all") <= allowed)
    over = summed.where(F.col("__all") > allowed)
    some = over.where(F.col("__firsts") <= allowed)
    follow = ranking.greedy_fit(some.where("not __first"), n.amount, allowed - F.col("__firsts"), n.by, n.best(), n.tie)
    few = over.where((F.col("__firsts") > allowed) & F.col("__first"))
    spread = selection.fitted_protected(few.drop("__first", "__all", "__firsts"), n.by, n.time, n.amount, n.favorite, n.score, n.tie, allowed, 31)
    return whole.select(*n.keys()).unionByName(some.where("__first").select(*n.keys())).unionByName(follow.select(*n.keys())).unionByName(spread.select(*n.keys()))


def few_others(df: DataFrame, n: Names, wishes: Wishes) -> DataFrame:
    """df with its favorites and the best others: their share of the rows, or what is missing of the clips that are wished."""
    if wishes.others >= 1:
        return df
    of = Window.partitionBy(*n.by)
    stars = F.count_if(F.col(n.favorite)).over(of)
    most = F.greatest(F.floor(wishes.others * F.count(F.lit(1)).over(of)), wishes.clips - stars)
    place = F.row_number().over(Window.partitionBy(*n.by, n.favorite).orderBy(*n.best()))
    return df.withColumn("__in", F.col(n.favorite) | (place <= most)).where("__in").drop("__in")


def few_photos(df: DataFrame, n: Names, ratio: float) -> DataFrame:
    """df with at most a share of photos beside its other rows; held rows and favorites count, but stay. Photos alone all stay."""
    if ratio >= 1:
        return df
    of = Window.partitionBy(*n.by)
    kept = F.col(n.photo) & (F.col("__held") | F.col(n.favorite))
    videos = F.count_if(~F.col(n.photo)).over(of)
    room = F.floor(videos * ratio / (1 - ratio)) - F.count_if(kept).over(of)
    marked = df.withColumn("__free", F.col(n.photo) & ~kept)
    place = F.row_number().over(Window.partitionBy(*n.by, "__free").orderBy(*n.best()))
    return marked.withColumn("__in", ~F.col("__free") | (videos == 0) | (place <= room)).where("__in").drop("__in", "__free")


def backfilled(df: DataFrame, n: Names, chosen: str, wishes: Wishes, scarce: str | None = None) -> DataFrame:
    """keys, tier and place of a selection that is filled while its seconds leave room.

    Rows with `chosen` are there (tier 0). For every further row the first tier that admits any of the open rows is
    sought anew, from the strict one on: 1 all limits; 2 without the share of others; 3 with up to 70 % photos;
    4 without the distance between moments; 5 without a share of photos; 6 up to two seconds over the time. What tiers 3
    to 6 concede of photos stays conceded. Of the rows that the tier admits a favorite goes first, then a video where
    videos are scarce, then the one farthest in time from all that are chosen, then the best score.
    scarce: the column that tells whether a key's videos are scarce; then photos have no limit. Rows without a time
    are near nothing; rows of no amount are never added.
    """
    kind = "struct<used:double,n:int,photos:int,others:int,cap:double,near:array<double>,tier:array<int>,place:array<int>,open:boolean>"
    is_scarce = F.col(scarce) if scarce else F.lit(False)
    limit = F.when(is_scarce | F.lit(wishes.photos >= 1), F.lit(None).cast("double")).otherwise(F.lit(wishes.photos))
    row = F.struct(
        F.col(n.tie).alias("id"), (F.unix_micros(F.col(n.time).cast("timestamp")) / 1e6).alias("t"), F.col(n.amount).cast("double").alias("amount"), F.coalesce(F.col(n.favorite), F.lit(False)).alias("star"),
        F.coalesce(F.col(n.photo), F.lit(False)).alias("photo"), F.col(n.score).cast("double").alias("score"), F.coalesce(F.col(chosen), F.lit(False)).alias("chosen"),
    )
    rows = df.groupBy(*n.by).agg(F.array_sort(F.array_agg(row)).alias("rows"), F.bool_or(is_scarce).alias("__scarce"), F.first(limit).alias("__cap"))
    r, budget = F.col("rows"), wishes.seconds + wishes.overrun
    rows, held = rows.withColumn("__held", F.filter(r, lambda x: x["chosen"])), F.col("__held")
    count = lambda pick: F.size(F.filter(held, pick)).cast("int")
    near = F.transform(r, lambda x: F.when(~x["chosen"], F.array_min(F.transform(F.col("__held"), lambda h: F.abs(h["t"] - x["t"])))))
    begun = F.struct(
        F.aggregate(held, F.lit(0.0), lambda a, h: a + h["amount"]).alias("used"), F.size(held).alias("n"), count(lambda h: h["photo"]).alias("photos"), count(lambda h: ~h["star"]).alias("others"), F.col("__cap").alias("cap"),
        near.alias("near"), F.transform(r, lambda x: F.when(x["chosen"], 0)).alias("tier"), F.transform(r, lambda x: F.when(x["chosen"], 0)).alias("place"), F.lit(True).alias("open"),
    ).cast(kind)

    def step(now: Column, turn: Column) -> Column:
        room, size = budget - now["used"], now["n"] + 1
        more = F.when(now["cap"] < MORE_PHOTOS, MORE_PHOTOS).otherwise(now["cap"])
        stars = now["n"] - now["others"]
        most = F.greatest(F.floor(size * wishes.others), F.greatest(F.lit(0), wishes.clips - stars)) if wishes.others < 1 else F.lit(1 << 30)
        within = lambda cap: cap.isNull() | ((now["photos"] + 1) / size <= cap + 1e-9)
        limits = F.struct(
            (room + 1e-6).alias("room"), (room + OVERRUN_S + 1e-6).alias("over"), within(now["cap"]).alias("photo"), within(more).alias("more"), (now["others"] + 1 <= most).alias("other"),
        )

        def judged(x: Column, k: Column, limit: Column) -> Column:
            """The tier that admits the row, and what ranks it within; null if none does. Lambdas are interpreted: what is the same for all rows is in limit, and a row's tier is asked for once."""
            distance = F.get(now["near"], k)
            apart = F.coalesce(distance > wishes.moment_s, F.lit(True)) if wishes.moment_s > 0 else F.lit(True)
            tier = (
                F.when(x["amount"] > limit["room"], 6)
                .when((~x["photo"] | limit["photo"]) & apart, F.when(x["star"] | limit["other"], 1).otherwise(2))
                .when(~x["photo"] | limit["more"], F.when(apart, 3).otherwise(4))
                .otherwise(5)
            )
            video = F.col("__scarce") & ~x["photo"]
            admitted = F.get(now["tier"], k).isNull() & (x["amount"] > 0) & (x["amount"] <= limit["over"])
            return F.when(admitted, F.struct(tier.alias("tier"), (~x["star"]).alias("a"), (~video).alias("b"), (-F.coalesce(distance, F.lit(0.0))).alias("c"), (-x["score"]).alias("d"), k.alias("k")))

        def taken(best: Column) -> Column:
            x = F.get(r, best["k"])
            cap = F.when(best["tier"] <= 2, now["cap"]).when(best["tier"] <= 4, more)
            closer = F.transform(now["near"], lambda d, k: F.least(d, F.abs(F.get(r, k)["t"] - x["t"])))
            put = lambda array, value: F.transform(array, lambda v, k: F.when(k == best["k"], value).otherwise(v))
            after = F.struct(
                (now["used"] + x["amount"]).alias("used"), size.alias("n"), (now["photos"] + x["photo"].cast("int")).alias("photos"), (now["others"] + (~x["star"]).cast("int")).alias("others"), cap.alias("cap"),
                closer.alias("near"), put(now["tier"], best["tier"]).alias("tier"), put(now["place"], turn).alias("place"), F.lit(True).alias("open"),
            ).cast(kind)
            ended = F.struct(*[now[c].alias(c) for c in ("used", "n", "photos", "others", "cap", "near", "tier", "place")], F.lit(False).alias("open")).cast(kind)
            return F.when(best.isNull(), ended).otherwise(after)

        return F.when(~now["open"] | (room <= 0), now).otherwise(let(let(limits, lambda limit: F.array_min(F.transform(r, lambda x, k: judged(x, k, limit)))), taken))

    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - F.size(held)))
    done = rows.withColumn("__end", F.aggregate(turns, begun, step))
    every = F.arrays_zip(F.transform(r, lambda x: x["id"]).alias("id"), F.col("__end.tier").alias("tier"), F.col("__end.place").alias("place"))
    out = done.select(*n.by, F.explode(every).alias("x")).where("x.tier is not null")
    return out.select(*n.by, F.col("x.id").alias(n.tie), "x.tier", "x.place")


def refined(df: DataFrame, n: Names, wishes: Wishes, stops: DataFrame | None = None) -> DataFrame:
    """keys, tier and place of a whole selection, in order of time (tier 0: chosen before it was filled up).

    Photos a day, the selection over time (or over the stops of a trip), the time, one row a moment, the shares of
    other rows and of photos, and backfill from all rows.
    """
    raw = written(df)
    pool = written(capped_photos(raw, n))
    count, allowed = int(wishes.clips * 1.2), wishes.seconds + wishes.overrun
    wide = distributed(pool, n, count, events_of(with_periods(raw, n), n)) if stops is None else by_stops(pool, stops, n, count)
    held = pool.join(wide.select(*n.keys(), F.col("reason").isin("coverage", "period").alias("__held")), n.keys())
    cut = held.join(fitted(held, n, allowed), n.keys(), "left_semi")
    moments = sessions.best_per_moment(cut, n.time, wishes.moment_s, n.by, n.favorite, n.score, n.tie) if wishes.moment_s > 0 else cut
    kept = written(few_photos(few_others(moments, n, wishes), n, wishes.photos).select(*n.keys(), F.lit(True).alias("__chosen")))
    videos = pool.groupBy(*n.by).agg(F.coalesce(F.sum(F.when(~F.col(n.photo), F.col(n.amount))), F.lit(0.0)).alias("__videos"))
    scarce = (F.col("__videos") < wishes.seconds * 0.5) if wishes.photos < 1 else F.lit(False)
    whole = raw.join(kept, n.keys(), "left").join(videos.select(*n.by, scarce.alias("__few")), n.by)
    filled = backfilled(whole, n, "__chosen", wishes, "__few")
    timed = filled.drop("place").join(raw.select(*n.keys(), n.time), n.keys())
    return timed.select(*n.keys(), "tier", F.row_number().over(Window.partitionBy(*n.by).orderBy(n.time, n.tie)).alias("place"))


def reviewed(df: DataFrame, n: Names, select: Callable[[DataFrame], DataFrame], seen: str, real: str, floor: float = 0.3, share: float = 0.6, passes: int = 10) -> DataFrame:
    """keys of a selection after all its rows were looked at and judged.

    select gives the keys of a selection from a pool. Rows of it that have not been seen take their real score and the
    pool is selected from again, `passes` times at most; then rows under the floor, and a last row that is the weakest and
    under a share of the mean, leave the pool (favorites stay), and all of it begins anew, `passes` times at most. The selection
    after the last judgement is final. A selection of one row is not judged, and a pool is not emptied. Each round is written, and a key takes part until it is stable.
    """
    of, last_pass = Window.partitionBy(*n.by), max(1, passes)
    pool = written(df.withColumns({"__judged": F.lit(0), "__looked": F.lit(0), "__final": F.lit(False)}))
    stable: DataFrame | None = None
    while stable is None or pool.head(1):
        picked = select(pool.drop("__judged", "__looked", "__final")).select(*n.keys(), F.lit(True).alias("__in"))
        rows = pool.join(picked, n.keys(), "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
        among = lambda c: F.when(F.col("__in"), c)
        size, new = F.count_if("__in").over(of), F.col("__in") & ~F.col(seen)
        look = ~F.col("__final") & (F.count_if(new).over(of) > 0) & (F.col("__looked") < last_pass)
        end = F.struct(n.time, n.tie)
        weakest = (F.col(n.score) == F.min(among(F.col(n.score))).over(of)) & (F.col(n.score) < share * F.avg(among(F.col(n.score))).over(of))
        weak_end = (size > 2) & (end == F.max(among(end)).over(of)) & weakest
        fails = F.col("__in") & ~F.col(n.favorite) & ((F.col(n.score) < floor) | weak_end)
        first = rows.withColumns({"__new": new, "__look": look, "__fails": fails, "__size": size})
        failing, whole = F.count_if("__fails").over(of), F.count(F.lit(1)).over(of)
        drops = ~F.col("__final") & ~F.col("__look") & (F.col("__size") >= 2) & (failing > 0) & (failing < whole)
        round_ = written(first.withColumn("__drops", drops))
        going = F.col("__look") | F.col("__drops")
        ended = round_.where(~going & F.col("__in")).select(*n.keys())
        stable = ended if stable is None else stable.unionByName(ended)
        now = F.col("__look") & F.col("__new")
        pool = round_.where(going & ~(F.col("__drops") & F.col("__fails"))).select(*[c for c in df.columns if c not in (n.score, seen)],
            F.when(now, F.col(real)).otherwise(F.col(n.score)).alias(n.score), (F.col(seen) | now).alias(seen),
            (F.col("__judged") + F.col("__drops").cast("int")).alias("__judged"), F.when(F.col("__look"), F.col("__looked") + 1).otherwise(0).alias("__looked"),
            (F.col("__drops") & (F.col("__judged") + 1 >= last_pass)).alias("__final"),
        )
    return stable
