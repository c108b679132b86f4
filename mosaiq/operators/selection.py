"""Whole selections per key: what is kept of favorites, how the rest of a budget is filled, and how weak rows are swept out.

These choices depend on all earlier ones, so each key's rows meet in one task as a pandas frame; keys are owners or trips.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaiq.functions import calendar
from mosaiq.operators import folds, ranking, sessions
from mosaiq.operators.checkpoints import written


def thinned_favorites(df: DataFrame, by: list[str], week: str, held: str, amount: str, score: str, tie: str, budget: float) -> DataFrame:
    """Favorites within a budget: the weakest of weeks that aren't held go first, but a week keeps its last one.

    The last one of a week is its best, so all but that may go, in order, while what is left is over the budget.
    """
    whole, order = Window.partitionBy(*by), [F.col(score), F.col(tie)]
    place = F.row_number().over(Window.partitionBy(*by, held, week).orderBy(F.desc(score), F.desc(tie)))
    marked = df.withColumn("__free", ~F.col(held) & (place > 1))
    gone = F.coalesce(F.sum(F.when(F.col("__free"), F.col(amount)).otherwise(0)).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__left", F.sum(amount).over(whole) - gone).where(~F.col("__free") | (F.col("__left") <= budget)).select(*by, tie)


def judged_until_stable(df: DataFrame, by: list[str], time: str, favorite: str, score: str, tie: str, floor: float = 0.3, share: float = 0.6, rounds: int = 10) -> DataFrame:
    """What is left when rows under the floor, and a weak last row, go again and again; favorites stay.

    All rows under the floor go in the first round. After it only last rows go, so what
    is left is a beginning of the rest, up to the last row that would stay as its end.
    """
    whole, order = Window.partitionBy(*by), [F.col(time), F.col(tie)]
    free = ~F.col(favorite)
    last = F.row_number().over(whole.orderBy(F.desc(time), F.desc(tie))) == 1
    weak_end = last & (F.count(F.lit(1)).over(whole) > 2) & (F.col(score) == F.min(score).over(whole)) & (F.col(score) < share * F.avg(score).over(whole))
    rest = df.withColumn("__out", free & ((F.col(score) < floor) | weak_end)).where("not __out")
    so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rest.withColumn("__k", F.row_number().over(whole.orderBy(*order)))
    goes = free & (F.col("__k") > 2) & (F.col(score) == F.min(score).over(so_far)) & (F.col(score) < share * F.avg(score).over(so_far))
    marked = numbered.withColumn("__stays", F.when(~goes, F.col("__k")))
    end = F.greatest(F.max("__stays").over(whole), F.count(F.lit(1)).over(whole) - (rounds - 1))
    return marked.withColumn("__end", end).where("__k <= __end").select(*by, tie)


def smart(df: DataFrame, by: list[str], time: str, favorite: str, quality: list[Column], tie: str, target: int, only: Column | None = None, favorites: bool = True, others: float = 1.0) -> DataFrame:
    """df's rows of a selection spread over days, with place in order of time: slots for each day, and of each day the favorites (if they go first), then the best.

    only: a condition that rows must hold, such as HDR. others: where favorites go first, the most that the rest may be, as a share of what was picked; the best stay.
    """
    dated = (df if only is None else df.where(only)).withColumn("__day", F.to_date(time))
    slots = folds.day_slots(dated, "__day", by, target).select(*by, "__day", "slots")
    best = [*quality, F.col(tie)]
    picked = ranking.top_per(dated.join(slots, [*by, "__day"]), [*by, "__day"], [F.desc(favorite), *best] if favorites else best, F.col("slots"))
    if favorites and others < 1:
        sized = picked.withColumn("__most", F.floor(others * F.count(F.lit(1)).over(Window.partitionBy(*by))))
        picked = ranking.top_per(sized, [*by, favorite], best, F.when(F.col(favorite), F.lit(1 << 30)).otherwise(F.col("__most")))
    return picked.select(*df.columns, F.row_number().over(Window.partitionBy(*by).orderBy(time, tie)).alias("place"))


def transitions(df: DataFrame, by: list[str], order: str, tie: str, title: str, key_hash: str, fades: float = 0.7) -> DataFrame:
    """fade or cut after each row: fades after titles, else by a hash of the row at a rate, with at most three fades or two cuts in a row.

    A fold over a key's rows whose state is the letters so far.
    """
    row = F.struct(F.col(order).alias("o"), F.col(tie).alias("id"), F.col(title).alias("title"), ((F.col(key_hash) % 1000) / 1000 < fades).alias("fades"))

    def letter(past: Column, r: Column) -> Column:
        asked = F.when(r["fades"], "f").otherwise("c")
        return F.concat(past, F.when(r["title"], "f").when(past.endswith("fff"), "c").when(past.endswith("cc"), "f").otherwise(asked))

    folded = df.groupBy(*by).agg(F.array_sort(F.array_agg(row)).alias("rows")).withColumn("plan", F.aggregate("rows", F.lit(""), letter))
    each = F.transform("rows", lambda r, k: F.struct(r["id"].alias("id"), F.substring(F.col("plan"), k + 1, F.lit(1)).alias("kind")))
    return folded.select(*by, F.explode(each).alias("x")).select(*by, F.col("x.id").alias(tie), F.when(F.col("x.kind") == "f", "fade").otherwise("cut").alias("transition"))


def planned(timelines: DataFrame, target: Column, title: float, ending: float, divider: float, clip_s: float = 5.0, fade: float = 0.5, rate: float = 0.7, share: float = 0.2, least_ending: float = 2.0, grace: float = 10.0) -> DataFrame:
    """The plan of timelines (trip, months: whether dividers mark months in order, eligible) before their clips are chosen.

    Titles get a share of the target: the opening first, the ending if two seconds are left for it, then as many dividers as
    fit. Trips, and dividers of months, are settled only after the selection (policy pending): a trip keeps no time for its dividers,
    months keep theirs. Fades overlap at a rate of all boundaries and so give time back, which may hold further clips,
    so that is taken again until it stays, eight times at most.
    """
    t = F.greatest(target.cast("double"), F.lit(0.0))
    opening = F.least(F.lit(float(title)), t * share)
    left = t * share - opening
    closing = F.when(left >= least_ending, F.least(F.lit(float(ending)), left)).otherwise(0.0)
    fit = F.least(F.col("eligible"), F.floor((left - closing) / divider)) if divider > 0 else F.lit(0)
    reserved = F.when(F.col("trip"), 0).otherwise(fit)
    pending = F.col("trip") | F.col("months")
    budget = opening + closing + reserved * divider
    cards = (opening > 0).cast("int") + reserved + (closing > 0).cast("int")
    sized = timelines.withColumns({
        "title": opening, "ending": closing, "reserved": reserved.cast("long"), "__cards": cards, "__base": F.greatest(t - budget, F.lit(0.0)), "title_budget": budget,
        "policy": F.when(pending, "pending").otherwise("capped"), "max_dividers": F.when(pending, 0).otherwise(reserved).cast("long"), "soft_max": F.when(pending, t + F.least(F.lit(float(grace)), t * share)),
    })

    def again(overlap: Column, _: Column) -> Column:
        clips = F.greatest(F.lit(1), F.ceil((F.col("__base") + overlap) / max(0.1, clip_s)))
        return F.greatest(clips + F.col("__cards") - 1, F.lit(0)) * fade * rate

    overlap = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), again)  # once it stays, further turns change nothing
    return sized.withColumn("overlap", overlap).withColumn("content_budget", F.col("__base") + F.col("overlap")).drop("__cards", "__base")


def finalized(timelines: DataFrame, target: float, title: float, ending: float, divider: float, soft: float, fade: float = 0.5, rate: float = 0.7) -> DataFrame:
    """policy, dividers, title_budget, content_budget and soft_max of timelines (content, clips, eligible, trip) after their clips are chosen.

    Trips take as many dividers as a fifth of the target holds beside the titles;
    others take all, if the whole stays within the soft limit, or none. Fades overlap
    at a rate of all boundaries and so give time back.
    """
    ends, c = title + ending, F.col
    asked = F.when(c("trip"), F.least(c("eligible"), F.lit(int(max(0.0, target * 0.2 - ends) // divider)))).otherwise(c("eligible"))
    overlap = lambda n: (c("clips") + 2 + n - 1) * fade * rate
    limit = F.greatest(F.lit(soft), target + c("eligible") * divider)
    whole = c("content") + ends + c("eligible") * divider - overlap(asked) <= limit
    chosen = F.when(c("trip"), asked).when(whole, c("eligible")).otherwise(0)
    policy = F.when(c("trip"), "capped").when(whole, "all").otherwise("none")
    budget = F.greatest(F.lit(0.0), target - ends - chosen * divider) + overlap(chosen)
    return timelines.withColumns({
        "policy": policy, "dividers": chosen.cast("long"), "title_budget": F.round(ends + chosen * divider, 4), "content_budget": F.round(budget, 4),
        "soft_max": F.round(F.when(c("trip"), target + chosen * divider).otherwise(limit), 4),
    })


def fitted_protected(df: DataFrame, by: list[str], time: str, amount: str, favorite: str, score: str, tie: str, budget: float, short_days: int, share: float = 0.7) -> DataFrame:
    """Rows that are protected but don't all fit: favorites first, with all of the budget in a short span and a share of it in a longer one, then the rest; each spread over days."""
    whole = Window.partitionBy(*by)
    both = F.bool_or(F.col(favorite)).over(whole) & F.bool_or(~F.col(favorite)).over(whole)
    span = F.floor((F.max(F.unix_micros(F.col(time).cast("timestamp"))).over(whole) - F.min(F.unix_micros(F.col(time).cast("timestamp"))).over(whole)) / 86_400_000_000)
    marked = df.withColumns({"__both": both, "__budget": F.lit(float(budget)) * F.when(both & (span > short_days), share).otherwise(1.0), "__whole": F.lit(float(budget))})
    rows = marked.where(F.col(favorite).isNotNull() | ~F.col("__both")).withColumn("__second", ~F.coalesce(F.col(favorite), F.lit(False)) & F.col("__both"))
    return folds.farthest_days(rows, time, amount, favorite, score, by, tie, "__budget", "__second", "__whole")


def photo_rounds(df: DataFrame, by: list[str], day: str, amount: str, score: str, tie: str, videos: str, seconds: str, budget: float, most: float = 0.5, a_day: int = 2) -> DataFrame:
    """Photos beside videos (their number and seconds stand in each row): the best of each day, the second best, then the best of all; no more than so many a day, and than a share of all unless videos are scarce."""
    schema = StructType([df.schema[c] for c in [*by, tie]])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, tie], ascending=[False, True]).reset_index(drop=True)
        nth = rows.groupby(day).cumcount()
        by_day = rows.sort_values([day, tie]).index
        turns = [(k, False) for n in (0, 1) for k in by_day if nth[k] == n] + [(k, True) for k in rows.index]
        n_videos, held = rows[videos].iloc[0], rows[seconds].iloc[0]
        free, room = n_videos == 0 or held < budget * 0.5, max(0.0, budget - held)
        chosen: dict[int, None] = {}
        used, days = 0.0, {}
        for k, last in turns:
            size, on = rows.at[k, amount], rows.at[k, day]
            fits = used + size <= room and (free or (len(chosen) + 1) / (n_videos + len(chosen) + 1) <= most)
            if k not in chosen and fits and not (last and days.get(on, 0) >= a_day):
                chosen[k] = None
                used += size
                days[on] = days.get(on, 0) + 1
        return rows.loc[list(chosen), [*by, tie]]

    return df.groupBy(*by).applyInPandas(fill, schema)


def favorites_first(df: DataFrame, by: list[str], time: str, period: Column, amount: str, favorite: str, score: str, tie: str, count: int, clip_s: float = 5.0, over: float = 1.25, event: Column | None = None, event_rows: int = 3, unit: float = 100.0) -> DataFrame:
    """by, tie and reason of a selection that starts with the favorites.

    Favorites as far as they fit (weeks with many, the first and the last are held);
    the two best others of weeks without any, from the first favorite in steps of seven
    days; places that are left by score (in units), less a tenth a row of the week; and the best
    row of each period that has none (event_rows of it where the condition event holds).
    """
    w = df.withColumn("__week", calendar.monday_week(F.col(time))).withColumn("__period", period).withColumn("__take", F.lit(1) if event is None else F.when(event, event_rows).otherwise(1))
    best = [F.desc(score), F.col(tie)]
    stars, others = w.where(F.col(favorite)), w.where(~F.col(favorite))
    each = stars.groupBy(*by, "__week").agg(F.count(F.lit(1)).alias("__n"))
    of = Window.partitionBy(*by)
    held = (F.col("__n") >= 1.5 * F.avg("__n").over(of)) | (F.col("__week") == F.min("__week").over(of)) | (F.col("__week") == F.max("__week").over(of))
    weeks = each.select(*by, "__week", held.alias("__held"))
    kept = thinned_favorites(stars.join(weeks, [*by, "__week"]), by, "__week", "__held", amount, score, tie, count * clip_s * over)
    columns = [*by, tie, "__week", "__period"]
    first = written(stars.join(kept, [*by, tie], "left_semi").select(*columns, F.lit("favorite").alias("reason")))

    seven = F.expr("interval 7 days")
    span = stars.groupBy(*by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    stepped = span.select(*by, F.explode(F.sequence("lo", "hi", seven)).alias("at")).select(*by, calendar.monday_week(F.col("at")).alias("__week")).distinct()
    empty = stepped.join(first, [*by, "__week"], "left_anti")
    second = written(ranking.top_per(others.join(empty, [*by, "__week"]), [*by, "__week"], best, 2).select(*columns, F.lit("week").alias("reason")))

    so_far = first.unionByName(second)
    in_week = so_far.groupBy(*by, "__week").agg(F.count(F.lit(1)).alias("__in_week"))
    in_all = so_far.groupBy(*by).agg(F.count(F.lit(1)).alias("__in_all"))
    open_rows = others.join(second, [*by, tie], "left_anti").join(in_week, [*by, "__week"], "left").join(in_all, by, "left")
    worth = F.round(F.col(score) / unit - 0.1 * F.coalesce("__in_week", F.lit(0)), 6)
    third = ranking.top_per(open_rows, by, [F.desc(worth), F.col(tie)], count - F.coalesce("__in_all", F.lit(0))).select(*columns, F.lit("slot").alias("reason"))

    chosen = written(so_far.unionByName(third))
    bare = w.join(chosen, [*by, "__period"], "left_anti")
    fourth = ranking.top_per(bare, [*by, "__period"], best, F.col("__take")).select(*columns, F.lit("coverage").alias("reason"))
    return chosen.unionByName(fourth).select(*by, tie, "reason")
