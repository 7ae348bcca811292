"""Tickers from before ISINs: bridged to a later ISIN, renamed, dead, or left for review."""

from __future__ import annotations

import json
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import kept, write_bytes
from .bitemporal import Pin, bars_at, latest_version

MAX_GAP, TOLERANCE = 5, 0.15


def pre_isin_bridge(bars: DataFrame, symbols: DataFrame, source: str, pin: Pin) -> DataFrame:
    """(ticker, isin, first_date): of the symbols that ever bore a ticker the one whose bars start first."""
    first = bars_at(bars, source, pin).groupBy("symbol_id").agg(F.min("date").alias("first_date"))
    names = symbols.where(F.col("ingested_at") <= F.lit(pin).cast("timestamp")).select("symbol_id", "ticker", "isin").distinct()
    order = Window.partitionBy("ticker").orderBy("first_date", "symbol_id")
    return names.join(first, "symbol_id").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("ticker", "isin", "first_date")


def close_on(bars: DataFrame, symbols: DataFrame, source: str, day: str, pin: Pin) -> DataFrame:
    """(ticker, close) of a day, by the latest ticker of each symbol; of two symbols with one ticker the first."""
    names = latest_version(symbols, ["symbol_id"], pin).select("symbol_id", "ticker")
    rows = bars_at(bars, source, pin, date.fromisoformat(day) - timedelta(days=1), day).join(names, "symbol_id")
    return rows.groupBy("ticker").agg(F.min_by(F.col("close").cast("double"), "symbol_id").alias("close"))


def numbered(calendar: DataFrame) -> DataFrame:
    """(date, n): sessions in order; one row per session of an exchange."""
    return calendar.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("n"))


def reach(prices: np.ndarray, tolerance: float, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest price that each price matches, to the last bit, as the rule is the rounded one |new / old - 1| <= tolerance. forward: the given prices are the old ones."""

    def fits(x: np.ndarray) -> np.ndarray:
        return np.abs((x / prices if forward else prices / x) - 1.0) <= tolerance

    lo, hi = (prices * (1 - tolerance), prices * (1 + tolerance)) if forward else (prices / (1 + tolerance), prices / (1 - tolerance))
    for _ in range(16):  # the rounding is a few last places
        lo, hi = np.where(fits(lo), np.nextafter(lo, 0), lo), np.where(fits(hi), np.nextafter(hi, np.inf), hi)
    for _ in range(32):
        lo, hi = np.where(fits(lo), lo, np.nextafter(lo, np.inf)), np.where(fits(hi), hi, np.nextafter(hi, 0))
    return lo, hi


def _reaches(tolerance: float):
    @F.pandas_udf("lo double, hi double")
    def of(price: pd.Series, gone: pd.Series) -> pd.DataFrame:
        (a, b), (c, d) = (reach(price.to_numpy(), tolerance, forward) for forward in (True, False))
        return pd.DataFrame({"lo": np.where(gone, a, c), "hi": np.where(gone, b, d)})

    return of


def match_renames(vanished: DataFrame, newcomers: DataFrame, calendar: DataFrame, max_gap: int = MAX_GAP, tolerance: float = TOLERANCE) -> DataFrame:
    """(ticker, newcomer, isin, first_date): a vanished ticker (ticker, last_date, last_close) and a newcomer (ticker, isin, first_date, first_close) that starts 0
    to max_gap sessions later at a price within the tolerance, if neither has another such match. Days that are no sessions match nothing, and
    neither do closes that are not above 0.

    Pairs are counted and not made: the prices of a session lie in order, and how many of the other side are within reach of one is the difference of two running
    counts. Where it is 1, the count itself is the place of the match.
    """
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance must be between 0 and 1")
    n = numbered(calendar)
    usable = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    v = vanished.where(usable("last_close")).join(n, vanished["last_date"] == n["date"]).select(F.lit(True).alias("gone"), "ticker", F.col("last_close").alias("price"), F.explode(F.sequence("n", F.col("n") + max_gap)).alias("n"))
    w = newcomers.where(usable("first_close")).join(n, newcomers["first_date"] == n["date"]).select(F.lit(False).alias("gone"), "ticker", F.col("first_close").alias("price"), "n", "isin", "first_date")
    sides = v.unionByName(w, allowMissingColumns=True).withColumn("_r", _reaches(tolerance)("price", "gone"))
    # Each row stands at its price and, before and after all equal prices, at the ends of its reach.
    points = [F.struct(F.col(c).alias("at"), F.lit(k).alias("kind")) for c, k in (("_r.lo", 0), ("price", 1), ("_r.hi", 2))]
    placed = sides.select("gone", "ticker", "n", "isin", "first_date", F.explode(F.array(*points)).alias("_p")).select("*", "_p.*").drop("_p")
    upto = Window.partitionBy("n").orderBy("at", "kind", "gone", "ticker", "isin").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("kind") == 1
    placed = placed.withColumns({"_v": F.sum((own & F.col("gone")).cast("bigint")).over(upto), "_w": F.sum((own & ~F.col("gone")).cast("bigint")).over(upto)})
    other = F.when(F.col("gone"), F.col("_w")).otherwise(F.col("_v"))
    counted = placed.groupBy("gone", "ticker", "n", "isin", "first_date").agg(
        F.max(F.when(F.col("kind") == 0, other)).alias("_before"), F.max(F.when(F.col("kind") == 2, other)).alias("_last"), F.max(F.when(own, F.col("_w"))).alias("place"),
    ).withColumn("matches", F.col("_last") - F.col("_before"))
    match = F.when(F.col("matches") == 1, F.struct("n", F.col("_last").alias("place")))
    gone = counted.where("gone").groupBy("ticker").agg(F.sum("matches").alias("_k"), F.max(match).alias("_m")).where("_k = 1").select("ticker", "_m.*")
    total = F.sum("matches").over(Window.partitionBy("ticker"))
    come = counted.where("not gone").withColumn("_k", total).where("_k = 1 and matches = 1").select("n", "place", F.col("ticker").alias("newcomer"), "isin", "first_date")
    return gone.join(come, ["n", "place"]).select("ticker", "newcomer", "isin", "first_date")


def resolve(seen: DataFrame, bridge: DataFrame, renames: DataFrame, calendar: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """(ticker, kind, identity, gap_sessions): what became of each early ticker (ticker, last_date).

    A ticker that has an ISIN later (bridge: ticker, isin, first_date) is bridged to it if its bars start within max_gap sessions, else quarantined: the gap is too wide to tell a
    suspension from a ticker given to another company. One without is renamed, with the newcomer's ISIN, or dead. The quarantined and the dead get an identity of
    their own. gap_sessions: null for the dead, and where one of the days is no session or the second comes first, which is no small gap.
    """
    n = numbered(calendar)
    later = bridge.select("ticker", F.col("isin").alias("_isin"), F.col("first_date").alias("_first"))
    names = renames.select("ticker", F.col("isin").alias("_new"), F.col("first_date").alias("_began"))
    rows = seen.select("ticker", "last_date").join(later, "ticker", "left").join(names, "ticker", "left").withColumn("_to", F.when(F.col("_isin").isNotNull(), F.col("_first")).otherwise(F.col("_began")))
    rows = rows.join(n.select(F.col("date").alias("last_date"), F.col("n").alias("_a")), "last_date", "left").join(n.select(F.col("date").alias("_to"), F.col("n").alias("_b")), "_to", "left")
    gap = F.when(F.col("_b") >= F.col("_a"), F.col("_b") - F.col("_a"))
    held = F.when(F.coalesce(gap <= max_gap, F.lit(False)), "bridged").otherwise("quarantined")
    kind = F.when(F.col("_isin").isNotNull(), held).when(F.col("_new").isNotNull(), "renamed").otherwise("dead")
    own = F.concat(F.lit("X-NSE-"), F.upper(F.trim("ticker")))
    identity = F.when(F.col("kind") == "bridged", F.col("_isin")).when(F.col("kind") == "renamed", F.col("_new")).otherwise(own)
    return rows.withColumns({"kind": kind, "gap_sessions": gap.cast("bigint")}).select("ticker", "kind", identity.alias("identity"), "gap_sessions", "last_date", F.col("_to").alias("first_date"))


def assignments(observed: DataFrame, bridge: DataFrame, calendar: DataFrame, scan_start: str | None = None, max_gap: int = MAX_GAP, tolerance: float = TOLERANCE) -> DataFrame:
    """resolve() of the tickers observed before ISINs (ticker, first_date, first_close, last_date, last_close), given those that have one later (ticker, isin, first_date,
    first_close). Vanished are the observed without an ISIN; newcomers are those with one, from their first session of either era, but for tickers
    that were there on the scan's first day, which look new to any scan that begins on it."""
    start = F.lit(scan_start).cast("date") if scan_start else None
    first = observed.agg(F.min("first_date").alias("_start")) if start is None else observed.sparkSession.range(1).select(start.alias("_start"))
    known = bridge.select("ticker", "isin", F.col("first_date").alias("_d"), F.col("first_close").alias("_c"))
    early = observed.join(known, "ticker").crossJoin(F.broadcast(first)).where("first_date > _start").select("ticker", "isin", "first_date", "first_close")  # one row
    late = bridge.join(observed.select("ticker"), "ticker", "left_anti").select("ticker", "isin", "first_date", "first_close")
    vanished = observed.join(bridge.select("ticker"), "ticker", "left_anti").select("ticker", "last_date", "last_close")
    return resolve(observed, bridge, match_renames(vanished, early.unionByName(late), calendar, max_gap, tolerance), calendar, max_gap)


def summary(found: DataFrame) -> DataFrame:
    """(bridged, dead, quarantined, renamed, total) of assignments."""
    return found.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("bridged", "dead", "quarantined", "renamed")], F.count(F.lit(1)).alias("total"))


def write_proposal(found: DataFrame, path: str, first: str, last: str, at: str, max_gap: int = MAX_GAP) -> dict:
    """A proposal for a person to review: `summary` (one JSON object with the span, the gap and the counts) and `assignments` (JSON lines by ticker) under a folder.
    Nothing is stored of it. Returns the summary."""
    found = kept(found, "assignments")
    counts = summary(found).first().asDict() | {"from": first, "to": last, "generated_at": at, "max_gap_sessions": max_gap}
    found.orderBy("ticker").write.mode("error").json(f"{path}/assignments")
    write_bytes(found.sparkSession, f"{path}/summary.json", json.dumps(counts, sort_keys=True).encode())
    return counts
