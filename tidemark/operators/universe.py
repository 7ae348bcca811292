"""The tradable universe as it could be known on a day."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SOURCES
from .bitemporal import Pin, bars_at, believed, between, members_on
from .checks import or_raise


def window_days(bars: DataFrame, source: str, as_of: str, lookback: int, pin: Pin, span_days: int | None = None) -> DataFrame:
    """The last `lookback` sessions up to a day, of all series, found within span_days (2 * lookback + 14 for daily bars)."""
    since = date.fromisoformat(as_of) - timedelta(days=span_days or 2 * lookback + 14)
    return believed(between(bars, source, since, as_of), pin).select("date").distinct().orderBy(F.desc("date")).limit(lookback)


class Window(NamedTuple):
    """The sessions that a ranking looks at; known even where nobody ranks."""

    sessions: int
    first_session: date | None
    last_session: date | None


def window_of(bars: DataFrame, source: str, as_of: str, lookback: int, pin: Pin, span_days: int | None = None) -> Window:
    """`bars` may be the kept table of sessions."""
    days = window_days(bars, source, as_of, lookback, pin, span_days)
    return Window(*days.agg(F.count(F.lit(1)), F.min("date"), F.max("date")).first())


def ranking(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, as_of: str, lookback: int, pin: Pin, allow_stale: bool = False, span_days: int | None = None, check: bool = True,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Every entity that passes presence (at least 80 % of the sessions) and liveness (it traded on the last one), with its median turnover,
    days_present, rows and fragments (symbols seen), its last boundary up to the day, the label in force, and the window. With check, an entity with two bars on a day is an error. calendar: the kept table of sessions, if
    there is one; else the days are looked for in the bars."""
    if lookback <= 0 or source not in SOURCES:
        raise ValueError("lookback must be positive and the source one of " + ", ".join(SOURCES))
    found = window_of(bars if calendar is None else calendar, source, as_of, lookback, pin, span_days)
    first = found.first_session or date.fromisoformat(as_of)
    # The window's sessions are all sessions from its first to the day, so that a range of dates selects them.
    rows = bars_at(bars, source, pin, first - timedelta(days=1), as_of).where("series = 'EQ'")
    rows = rows.join(members_on(symbols, links, as_of, pin), "symbol_id")
    turnover = F.coalesce(F.col("turnover").cast("double"), F.col("close").cast("double") * F.col("volume"))
    per = rows.groupBy("entity_id").agg(
        F.percentile(turnover, 0.5).alias("median_turnover"),
        F.size(F.collect_set("date")).cast("bigint").alias("days_present"),
        F.count(F.lit(1)).alias("rows"),
        F.size(F.collect_set("symbol_id")).cast("bigint").alias("fragments"),
        F.max("date").alias("last_seen"),
        *[F.any_value(c).alias(c) for c in ("label_id", "isin", "ticker", "last_break")],  # one value per entity
    )
    live = F.lit(True) if allow_stale else F.col("last_seen") == F.lit(found.last_session)
    kept = per.withColumns({"sessions": F.lit(found.sessions).cast("bigint"), "last_session": F.lit(found.last_session).cast("date")})
    kept = kept.where((F.col("days_present") >= -(-found.sessions * 8 // 10)) & live)
    if not check:
        return kept
    return kept.withColumn("entity_id", or_raise(F.col("rows") == F.col("days_present"), F.col("entity_id"), "members of an entity overlap"))


def universe_as_of(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, as_of: str, lookback: int, n: int, pin: Pin,
    allow_stale: bool = False, equities_only: bool = False, span_days: int | None = None, check: bool = True, calendar: DataFrame | None = None,
) -> DataFrame:
    """The n entities with the highest median turnover over the last sessions up to a day, as known at the pin.

    Two bars of an entity on one day anywhere in the ranking are an error, before the cut. Ties go by ticker, then by entity. Where nobody
    ranks there are no rows; window_of() has the sessions all the same.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    out = ranking(bars, symbols, links, source, as_of, lookback, pin, allow_stale, span_days, check, calendar).withColumn("symbol_id", F.col("label_id"))
    if equities_only:
        out = out.where(F.col("isin").startswith("INE"))
    top = out.orderBy(F.col("median_turnover").desc_nulls_last(), "ticker", "entity_id").limit(n)
    return top.select("entity_id", "symbol_id", "isin", "ticker", "median_turnover", "days_present", "fragments", "last_break", "sessions", "last_session")


def text_of(members: list, found: Window, as_of: str) -> str:
    """The universe as lines for a person: the window, then one line per member in order."""
    head = f"universe as of {as_of}: {len(members)} names over {found.sessions} sessions up to {found.last_session or '-'}"
    lines = [f"{i:>4}  {r['ticker']:<20} {r['isin']:<12} {r['median_turnover'] or 0.0:>18,.2f}  {r['days_present']:>4}" + (f"  {r['fragments']} symbols" if r["fragments"] > 1 else "") for i, r in enumerate(members, 1)]
    return "\n".join([head, *lines])
