"""Ranks, stances and calendars for all decision days at once, so that a backtest only has to walk through them."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitemporal import Pin, bars_at, entity_map, latest_version, sessions
from .indices import KEY as INDEX_KEY


def rebalance_calendar(days: DataFrame, months: int = 1, offset: int = 0) -> DataFrame:
    """Decision days: the last session of each month whose number is a multiple of `months`, `offset` sessions later. The last month's end is not known."""
    order = Window.orderBy("date")  # one row per session
    rows = days.select("date", F.row_number().over(order).alias("n"), F.lead("date").over(order).alias("_next"))
    ends = rows.where(F.col("_next").isNotNull() & (F.trunc("date", "MM") != F.trunc("_next", "MM")) & (F.month("date") % months == 0))
    shifted = ends.select((F.col("n") + offset).alias("n")).join(rows.select("n", "date"), "n")
    return shifted.select("date").distinct()


def months_back(day: date, months: int) -> date:
    """`months` earlier, days past the month's end running over into the next month."""
    m = day.year * 12 + day.month - 1 - months
    return date(m // 12, m % 12 + 1, 1) + timedelta(days=day.day - 1)


def universes(bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, days: DataFrame, lookback: int, n: int, pin: Pin, calendar: DataFrame | None = None) -> DataFrame:
    """(as_of, entity_id, median_turnover, place) for many days in one pass. calendar: the kept table of sessions, if there is one.

    An entity's turnovers lie in one row in order of session, and the windows of all days are looked at there, so that what moves is each bar once and not once for each day
    that looks back on it. Entities that are present and live on a day are ranked with the others of that day."""
    calendar = sessions(bars if calendar is None else calendar, source, None, None, pin).select("date", F.row_number().over(Window.orderBy("date")).alias("n"))
    ends = days.select("date").distinct().join(calendar, "date").orderBy("n").collect()  # the caller's days
    ends = [(r["date"], r["n"]) for r in ends]
    turnover = F.coalesce(F.col("turnover").cast("double"), F.col("close").cast("double") * F.col("volume"))
    rows = bars_at(bars, source, pin).where("series = 'EQ'").select("symbol_id", "date", turnover.alias("_t")).join(F.broadcast(calendar), "date")  # a row per session
    if ends:
        rows = rows.where(F.col("n").between(max(1, ends[0][1] - lookback + 1), ends[-1][1]))
    per = rows.join(entity_map(symbols, links, pin), "symbol_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("n", "_t"))).alias("_h"))
    seen = per.select("entity_id", "_h.n", F.col("_h._t").alias("turnover")).mapInArrow(lambda batches: _present(batches, ends, lookback), "as_of date, entity_id bigint, median_turnover double")
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("median_turnover"), "entity_id"))
    return seen.withColumn("place", place).where(F.col("place") <= n).select("as_of", "entity_id", "median_turnover", "place")


def _present(batches, ends: list[tuple[date, int]], lookback: int):
    """Of rows (entity_id, n, turnover: lists in order of n) the days on which the entity traded, and in at least 80 % of the window, with the median of its turnovers there."""
    last = np.array([n for _, n in ends], dtype=np.int64)
    first = np.maximum(last - lookback + 1, 1)
    least = -(-(last - first + 1) * 8 // 10)
    days = np.array([d for d, _ in ends], dtype="datetime64[D]")
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        columns = {c: batch.column(c) for c in ("n", "turnover")}
        bounds = columns["n"].offsets.to_numpy()
        at = columns["n"].values.to_numpy(zero_copy_only=False)
        value = columns["turnover"].values.to_numpy(zero_copy_only=False).astype(float)  # null: NaN, which sorts last
        for entity, a, b in zip(batch.column("entity_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
            n, x = at[a:b], value[a:b]
            lo, hi = np.searchsorted(n, first, "left"), np.searchsorted(n, last, "right")
            sessions_seen = np.concatenate([[0], np.cumsum(np.diff(n, prepend=0) != 0)])
            good = np.flatnonzero((sessions_seen[hi] - sessions_seen[lo] >= least) & (np.searchsorted(n, last, "left") < hi))
            if not len(good):
                continue
            lo, hi = lo[good], hi[good]
            places = lo[:, None] + np.arange((hi - lo).max())
            inside = np.sort(np.where(places < hi[:, None], x[np.minimum(places, len(x) - 1)], np.nan), axis=1)
            known = np.concatenate([[0], np.cumsum(~np.isnan(x))])
            k = known[hi] - known[lo]
            row = np.arange(len(good))
            median = 0.5 * inside[row, np.maximum(k - 1, 0) // 2] + 0.5 * inside[row, np.minimum(k // 2, inside.shape[1] - 1)]
            out[0].append(days[good])
            out[1].append(np.full(len(good), entity))
            out[2].append(median)
        if out[0]:
            kinds = (pa.date32(), pa.int64(), pa.float64())
            arrays = [pa.array(np.concatenate(c), k, from_pandas=True) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["as_of", "entity_id", "median_turnover"])


def rank_by(scores: DataFrame, score: str, ascending: bool, by: str = "as_of") -> DataFrame:
    """Adds rank (from 1) within each day; ties by entity. Rows without a score are left out."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, "entity_id")))


def return_windows(days: list[str], formation: int, skip: int) -> list[tuple[str, str]]:
    """The window from `formation` to `skip` months before each day."""
    return [(months_back(date.fromisoformat(d), formation).isoformat(), months_back(date.fromisoformat(d), skip).isoformat()) for d in days]


def trend_stance(levels: DataFrame, code: str, calendar: DataFrame, days: int, pin: Pin) -> DataFrame:
    """(date, stance): risk on where the index closes above the mean of its last `days` closes, else risk off; unknown where the
    session has no level or there are fewer closes within days * 8 / 5 + 30 calendar days."""
    rows = latest_version(levels.where(F.col("index_code") == code), INDEX_KEY, pin).select("date", F.col("close").cast("double").alias("close"))
    last = Window.orderBy("date").rowsBetween(-(days - 1), 0)  # one row per day of one index
    rows = rows.select("date", "close", F.avg("close").over(last).alias("_mean"), F.count(F.lit(1)).over(last).alias("_k"), F.min("date").over(last).alias("_since"))
    full = (F.col("_k") == days) & (F.datediff("date", "_since") <= days * 8 // 5 + 30)
    stance = F.when(~F.coalesce(full, F.lit(False)), "unknown").when(F.col("close") > F.col("_mean"), "risk on").otherwise("risk off")
    return calendar.select("date").distinct().join(rows, "date", "left").select("date", stance.alias("stance"))


def accounted(ranked: DataFrame, asked: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every entity asked for on a day (as_of, entity_id) with its rank, or why it has none: statuses (as_of, entity_id, status, reason), as entity_returns() gives them. An entity
    that has neither rank nor status is absent without a row."""
    key = ["as_of", "entity_id"]
    out = asked.select(*key).distinct().join(ranked.select(*key, "rank"), key, "left").join(statuses.select(*key, "status", "reason"), key, "left")
    status = F.when(F.col("rank").isNotNull(), "ranked").otherwise(F.coalesce("status", F.lit("absent")))
    return out.select(*key, "rank", status.alias("status"), F.when(F.col("rank").isNull(), F.coalesce("reason", F.lit("no row"))).alias("reason"))
