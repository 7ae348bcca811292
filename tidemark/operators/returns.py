"""Returns, closes and volatility of entities across identifier changes, with a fence round every boundary.

A window is (from, to). All windows and entities are computed at once; a status column says what became of each pair, so
that every entity asked for is accounted for in every window.
"""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .actions import current_actions
from .bitemporal import Pin, bars_at, believed, entity_map, latest_version, sessions
from .checks import or_raise

GUARD_SESSIONS, GUARD_SPAN, STALE_DAYS, MIN_RETURNS, YEAR_SESSIONS = 5, 30, 30, 120, 252


def boundaries(symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(entity_id, date, predecessor_id, successor_id, predecessor_isin, successor_isin) of each boundary in the latest links."""
    isin = latest_version(symbols, ["symbol_id"], pin).select("symbol_id", "isin")
    link = latest_version(links, ["symbol_id"], pin).where("boundary is not null")
    link = link.select("entity_id", F.col("boundary").alias("date"), F.col("predecessor").alias("predecessor_id"), F.col("symbol_id").alias("successor_id"))
    link = link.join(isin.select(F.col("symbol_id").alias("successor_id"), F.col("isin").alias("successor_isin")), "successor_id", "left")
    return link.join(isin.select(F.col("symbol_id").alias("predecessor_id"), F.col("isin").alias("predecessor_isin")), "predecessor_id", "left").select("entity_id", "date", "predecessor_id", "successor_id", "predecessor_isin", "successor_isin")


def guard_starts(days: DataFrame, calendar: DataFrame, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN) -> DataFrame:
    """(date, guard): for each boundary date the guard-th session before it within span days, the earliest found if there are fewer, the date itself if none."""
    return guarded(days.select("date").distinct(), calendar, guard, span)


def guarded(days: DataFrame, calendar: DataFrame, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN) -> DataFrame:
    """days with the start of each date's guard. The sessions of one calendar go to all rows as one array of dates."""
    known = calendar.agg(F.array_sort(F.collect_set("date")).alias("_days"))
    near = F.filter("_days", lambda d: (d > F.date_sub("date", span)) & (d < F.col("date")))
    rows = days.crossJoin(F.broadcast(known)).withColumn("_near", near)  # one row
    first = F.get("_near", F.greatest(F.size("_near") - guard, F.lit(0)))
    return rows.withColumn("guard", F.coalesce(first, "date")).drop("_days", "_near")


def fences(links: DataFrame, adjustments: DataFrame, calendar: DataFrame, pin: Pin, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN) -> DataFrame:
    """(entity_id, walls, actions): an entity's boundaries with their guards that no action inside [guard, date] explains, and its actions, both in order. An
    entity has few of either."""
    last = F.max_by(F.struct("entity_id", "boundary"), "ingested_at").alias("_l")
    found = believed(links, pin).groupBy("symbol_id").agg(last).select("_l.entity_id", F.col("_l.boundary").alias("date")).where("date is not null")
    none = {"_wall": F.lit(None).cast("struct<date:date,guard:date>"), "_action": F.lit(None).cast("struct<ex_date:date,ratio:double>")}
    walls = guarded(found, calendar, guard, span).select("entity_id", F.struct("date", "guard").alias("_wall"), none["_action"].alias("_action"))
    acts = current_actions(adjustments, pin).select("entity_id", none["_wall"].alias("_wall"), F.struct("ex_date", "ratio").alias("_action"))
    per = walls.unionByName(acts).groupBy("entity_id").agg(F.array_sort(F.collect_list("_wall")).alias("_walls"), F.array_sort(F.collect_list("_action")).alias("actions"))
    explained = lambda w: F.exists("actions", lambda a: (a.ex_date >= w.guard) & (a.ex_date <= w.date))
    return per.select("entity_id", F.filter("_walls", lambda w: ~explained(w)).alias("walls"), "actions")


def _calendar(bars: DataFrame, calendar: DataFrame | None, source: str, pin: Pin) -> DataFrame:
    return sessions(bars if calendar is None else calendar, source, None, None, pin)


def windows_frame(spark: SparkSession, windows: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, date.fromisoformat(a), date.fromisoformat(b)) for i, (a, b) in enumerate(windows)]
    if any(a >= b for _, a, b in rows):
        raise ValueError("a window must begin before it ends")
    return spark.createDataFrame(rows, "window int, from_date date, to_date date")


def _ends_seen(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, windows: list[tuple[str, str]], pin: Pin, stale: int, ids: DataFrame | None = None
) -> DataFrame:
    """(window, entity_id, symbol_id, side, date, close): of each end the last close of an entity within `stale` days up to it; of members on one day the first by symbol.
    Only days that some end looks at are read, and of these rows only those of `ids`, if given.

    A close is the last one of all ends from its day to the day before the entity's next close. So a row meets only ends that it answers, however many windows overlap."""
    frame = windows_frame(bars.sparkSession, windows)
    lo = min(date.fromisoformat(a) for a, _ in windows) - timedelta(days=stale)
    hi = max(date.fromisoformat(b) for _, b in windows)
    sides = [F.struct(F.lit(s).alias("side"), F.col(c).alias("at")) for s, c in (("f", "from_date"), ("t", "to_date"))]
    ends = frame.select("window", F.explode(F.array(*sides)).alias("e")).select("window", "e.*")
    looked_at = ends.select(F.explode(F.sequence(F.date_sub("at", stale - 1), F.col("at"))).alias("date")).distinct()
    members = entity_map(symbols, links, pin)
    if ids is not None:
        members = members.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = bars_at(bars, source, pin, lo, hi).join(F.broadcast(looked_at), "date", "left_semi").join(members, "symbol_id")
    rows = rows.select("entity_id", "symbol_id", "date", F.col("close").cast("double").alias("close"))
    following = F.lead("date").over(Window.partitionBy("entity_id").orderBy("date", F.desc("symbol_id")))
    until = F.least(F.date_sub(following, 1), F.date_add("date", stale - 1))
    rows = rows.withColumn("_until", until).where("_until >= date").withColumn("at", F.explode(F.sequence("date", "_until")))
    return rows.join(F.broadcast(ends), "at").select("window", "entity_id", "symbol_id", "side", "date", "close")  # the caller's list


def endpoint_closes(bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, windows: list[tuple[str, str]], pin: Pin, stale: int = STALE_DAYS) -> DataFrame:
    """(window, entity_id, f_date, f_close, t_date, t_close): the last close up to each end and less than `stale` days before it."""
    seen = _ends_seen(bars, symbols, links, source, windows, pin, stale)
    best = seen.groupBy("window", "entity_id").agg(_last_of("f").alias("_f"), _last_of("t").alias("_t"))
    return best.select("window", "entity_id", F.col("_f.date").alias("f_date"), F.col("_f.close").alias("f_close"), F.col("_t.date").alias("t_date"), F.col("_t.close").alias("t_close"))


def _last_of(side: str) -> Column:
    """The latest close of one end of the window; of members on one day the first by symbol."""
    mine = F.col("side") == side
    return F.max_by(F.when(mine, F.struct("date", "close")), F.when(mine, F.struct(F.col("date"), -F.col("symbol_id"))))


def entity_returns(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, adjustments: DataFrame, source: str, windows: list[tuple[str, str]], pin: Pin,
    ids: DataFrame | None = None, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN, stale: int = STALE_DAYS, calendar: DataFrame | None = None,
) -> DataFrame:
    """One row per window and entity: status (priced, refused, absent), reason, the two closes, ratio and return.

    Absent, in this order: both ends missing, one missing, both on one session. Refused: an unexplained boundary after the first close
    whose guard the last close reaches. Then a first close not above 0. return = to_close * ratio / from_close - 1.

    The pairs asked for, the closes at the ends, and each entity's walls and actions meet in one aggregation by window and entity. calendar: the kept table of
    sessions, if there is one.
    """
    frame = F.broadcast(windows_frame(bars.sparkSession, windows))  # the caller's list
    asked = (ids if ids is not None else entity_map(symbols, links, pin)).select("entity_id", F.lit(True).alias("_asked"))
    fenced_off = fences(links, adjustments, _calendar(bars, calendar, source, pin), pin, guard, span).select("entity_id", F.struct("walls", "actions").alias("_fence"))
    if ids is not None:
        fenced_off = fenced_off.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    seen = _ends_seen(bars, symbols, links, source, windows, pin, stale, ids)
    rows = seen.unionByName(asked.crossJoin(frame.select("window")), allowMissingColumns=True).unionByName(fenced_off.crossJoin(frame.select("window")), allowMissingColumns=True)
    best = [_last_of("f").alias("_f"), _last_of("t").alias("_t"), F.bool_or("_asked").alias("_asked"), F.max_by("_fence", F.col("_fence").isNotNull()).alias("_fence")]
    out = rows.groupBy("window", "entity_id").agg(*best).where("_asked").join(frame, "window")
    out = out.withColumns({f"{s}_{c}": F.col(f"_{s}.{c}") for s in "ft" for c in ("date", "close")})
    reached = F.filter("_fence.walls", lambda w: (w.date > F.col("f_date")) & (w.guard <= F.col("t_date")) & (F.col("f_date") != F.col("t_date")))
    inside = F.filter("_fence.actions", lambda a: (a.ex_date > F.col("f_date")) & (a.ex_date <= F.col("t_date")))
    out = out.withColumns({"_wall": F.get(reached, F.lit(0)), "_ratio": F.aggregate(inside, F.lit(1.0), lambda x, a: x * a.ratio)})
    no_f, no_t = F.col("f_date").isNull(), F.col("t_date").isNull()
    reason = (
        F.when(no_f & no_t, "no close at either end").when(no_f, "no close at the start").when(no_t, "no close at the end").when(F.col("f_date") == F.col("t_date"), "one session")
        .when(F.col("_wall").isNotNull(), "boundary").when(F.col("f_close") <= 0, "first close not positive")
    )
    status = F.when(reason.isNull(), "priced").when(reason == "boundary", "refused").otherwise("absent")
    ratio_or_one = F.coalesce("_ratio", F.lit(1.0))
    return out.select(
        "window", "entity_id", "from_date", "to_date", status.alias("status"), reason.alias("reason"), "f_date", "t_date", "f_close", "t_close",
        F.col("_wall.date").alias("boundary"), F.col("_wall.guard").alias("guard"), ratio_or_one.alias("ratio"),
        F.when(reason.isNull(), F.col("t_close") * ratio_or_one / F.col("f_close") - 1.0).alias("return"),
    )


def entity_closes(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, adjustments: DataFrame, source: str, start: str, end: str, pin: Pin,
    ids: DataFrame | None = None, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN, open_start: bool = False, check: bool = True, calendar: DataFrame | None = None,
) -> DataFrame:
    """(entity_id, date, close, adjusted): closes in [start, end] (open_start: after start) times the ratios of all actions
    since the start. Entities with an unexplained boundary in reach are left out. Two closes of an entity on one day are an error, raised as the rows are read.

    Bars, actions and walls are merged by entity and date and read in order once: a running product carries the ratio, so that nothing is joined by range.
    """
    first, last = (F.lit(x).cast("date") for x in (start, end))
    after = start if open_start else (date.fromisoformat(start) - timedelta(days=1)).isoformat()
    own = bars_at(bars, source, pin, after, end).join(entity_map(symbols, links, pin), "symbol_id")
    own = own.select("entity_id", "date", F.col("close").cast("double").alias("close"), F.lit(1.0).alias("_ratio"), F.lit(False).alias("_fenced"))
    found = fences(links, adjustments, _calendar(bars, calendar, source, pin), pin, guard, span)
    in_reach = F.exists("walls", lambda w: (w.date > first) & (w.guard <= last))
    inside = F.filter("actions", lambda a: (a.ex_date > first) & (a.ex_date <= last))
    events = F.concat(F.transform(inside, lambda a: F.struct(a.ex_date.alias("date"), a.ratio.alias("_ratio"), F.lit(False).alias("_fenced"))), F.when(in_reach, F.array(F.struct(first.alias("date"), F.lit(1.0).alias("_ratio"), F.lit(True).alias("_fenced")))).otherwise(F.array().cast("array<struct<date:date,_ratio:double,_fenced:boolean>>")))
    events = found.select("entity_id", F.explode(events).alias("_e")).select("entity_id", "_e.date", F.lit(None).cast("double").alias("close"), "_e._ratio", "_e._fenced")
    rows = own.unionByName(events)
    if ids is not None:
        rows = rows.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    whole = Window.partitionBy("entity_id")
    order = whole.orderBy("date", F.col("close").isNotNull())  # on one day actions come before the close
    rows = rows.withColumns({
        "adjusted": F.col("close") * F.product("_ratio").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_twice": (F.lag("date").over(order) == F.col("date")) & F.lag("close").over(order).isNotNull(),
        "_out": F.max("_fenced").over(whole),
    })
    rows = rows.where(F.col("close").isNotNull() & ~F.col("_out"))
    if check:
        rows = rows.withColumn("entity_id", or_raise(~F.coalesce("_twice", F.lit(False)), F.col("entity_id"), "members of an entity overlap"))
    return rows.select("entity_id", "date", "close", "adjusted")


def entity_volatility(*args, min_returns: int = MIN_RETURNS, **kwargs) -> DataFrame:
    """(entity_id, returns, volatility): yearly standard deviation of log returns of adjusted closes in (start, end]; volatility
    is null below min_returns. Takes the arguments of entity_closes."""
    rows = entity_closes(*args, open_start=True, **kwargs).where("adjusted > 0")
    step = F.log(F.col("adjusted") / F.lag("adjusted").over(Window.partitionBy("entity_id").orderBy("date")))
    per = rows.withColumn("_r", step).groupBy("entity_id").agg(F.count("_r").alias("returns"), F.stddev_samp("_r").alias("_sd"))
    return per.select("entity_id", "returns", F.when(F.col("returns") >= min_returns, F.col("_sd") * math.sqrt(YEAR_SESSIONS)).alias("volatility"))


def volatility_status(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, adjustments: DataFrame, source: str, start: str, end: str, pin: Pin,
    ids: DataFrame | None = None, min_returns: int = MIN_RETURNS, guard: int = GUARD_SESSIONS, span: int = GUARD_SPAN, calendar: DataFrame | None = None,
) -> DataFrame:
    """One row per entity asked for (all by default): its volatility, or why it has none: an unexplained boundary in reach, no usable return in the window, or
    fewer than min_returns of them."""
    asked = (ids if ids is not None else entity_map(symbols, links, pin)).select("entity_id").distinct()
    rows = entity_volatility(bars, symbols, links, adjustments, source, start, end, pin, ids=ids, guard=guard, span=span, calendar=calendar, min_returns=min_returns)
    found = fences(links, adjustments, _calendar(bars, calendar, source, pin), pin, guard, span)
    first, last = (F.lit(x).cast("date") for x in (start, end))
    shut = found.select("entity_id", F.get(F.filter("walls", lambda w: (w.date > first) & (w.guard <= last)), F.lit(0)).date.alias("boundary")).where("boundary is not null")
    out = asked.join(rows, "entity_id", "left").join(shut, "entity_id", "left").withColumn("returns", F.coalesce("returns", F.lit(0)))
    few = F.concat(F.lit("only "), F.col("returns").cast("string"), F.lit(" usable returns in the window"))
    reason = F.when(F.col("boundary").isNotNull(), "boundary").when(F.col("returns") == 0, "no bars in the window").when(F.col("returns") < min_returns, few)
    return out.select("entity_id", "volatility", "returns", reason.alias("reason"), "boundary")
