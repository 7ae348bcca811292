"""Reads at an ingest pin: latest versions, entities behind symbols, labels in force, sessions and bars of a day.

Every read takes `pin` and sees only rows with ingested_at <= pin. Without a pin it sees all.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checks import or_raise

Pin = str | None
EVER = "0001-01-01"


def parse_pin(text: str, now: datetime | None = None) -> str:
    """A pin as a time in UTC: an RFC 3339 time, which names its offset, a day, which is its midnight in UTC, or nothing, which is now."""
    if not text:
        moment = now or datetime.now(timezone.utc)
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        moment = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})", text):
        moment = datetime.fromisoformat(text)
    else:
        raise ValueError(f"a pin is a time with its offset or a day, not {text!r}")
    return moment.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")


def believed(table: DataFrame, pin: Pin) -> DataFrame:
    return table if pin is None else table.where(F.col("ingested_at") <= F.lit(pin).cast("timestamp"))


def latest_version(table: DataFrame, key: tuple[str, ...] | list[str], pin: Pin) -> DataFrame:
    """Of each key the row ingested last at the pin. Keys are unique by ingested_at, so there are no ties.

    Where rows carry superseded_at, which is when their key's next version came, that is a filter which the scan takes."""
    if "superseded_at" in table.columns:
        open_ = F.col("superseded_at").isNull()
        return believed(table, pin).where(open_ if pin is None else open_ | (F.col("superseded_at") > F.lit(pin).cast("timestamp"))).drop("superseded_at")
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ingested_at")))
    return believed(table, pin).withColumn("_v", last).where("_v = 1").drop("_v")


def symbol_links_at(symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(symbol_id, entity_id, boundary) of every symbol known at the pin. Symbols and links meet in one aggregation."""
    known = believed(symbols, pin).select("symbol_id", F.lit(True).alias("_known"), F.lit(None).cast("timestamp").alias("_at"), F.lit(None).cast("bigint").alias("_e"), F.lit(None).cast("date").alias("_b"))
    linked = believed(links, pin).select("symbol_id", F.lit(False).alias("_known"), F.col("ingested_at").alias("_at"), F.col("entity_id").alias("_e"), F.col("boundary").alias("_b"))
    per = known.unionByName(linked).groupBy("symbol_id").agg(F.bool_or("_known").alias("_known"), F.max_by(F.struct("_e", "_b"), "_at").alias("_l"))
    return per.where("_known").select("symbol_id", F.coalesce("_l._e", "symbol_id").alias("entity_id"), F.col("_l._b").alias("boundary"))


def entity_map(symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(symbol_id, entity_id) of every symbol known at the pin: its latest link's entity, else itself. One hop."""
    return symbol_links_at(symbols, links, pin).select("symbol_id", "entity_id")


def labels_in_force(symbols: DataFrame, on: str | date, pin: Pin, names: tuple[str, ...] = ("isin", "ticker")) -> DataFrame:
    """Of each symbol the label in force on a day: the latest valid_from not after it, else the earliest there is; of
    equal valid_from the one ingested last."""
    started = F.col("valid_from") <= F.lit(on).cast("date")
    nearest = F.when(started, F.unix_date("valid_from")).otherwise(-F.unix_date("valid_from"))
    best = F.max_by(F.struct(*names, "valid_from"), F.struct(started, nearest, "ingested_at")).alias("_l")
    return believed(symbols, pin).groupBy("symbol_id").agg(best).select("symbol_id", "_l.*")


def entity_members(symbols: DataFrame, links: DataFrame, on: str | date, pin: Pin) -> DataFrame:
    """(entity_id, symbol_id): the member in force on a day, that is the one with the latest boundary not after it."""
    started = F.coalesce("boundary", F.lit(EVER).cast("date")) <= F.lit(on).cast("date")
    order = F.struct(started, F.col("boundary").isNotNull(), F.coalesce(F.unix_date("boundary"), F.lit(0)), -F.col("symbol_id"))
    return symbol_links_at(symbols, links, pin).groupBy("entity_id").agg(F.max_by("symbol_id", order).alias("symbol_id"))


def entity_labels(symbols: DataFrame, links: DataFrame, on: str | date, pin: Pin) -> DataFrame:
    """(entity_id, symbol_id, isin, ticker) in force on a day."""
    return entity_members(symbols, links, on, pin).join(labels_in_force(symbols, on, pin), "symbol_id").select("entity_id", "symbol_id", "isin", "ticker")


def between(bars: DataFrame, source: str, after: str | date | None = None, upto: str | date | None = None) -> DataFrame:
    """Rows of a source with after < date <= upto. Year partitions outside the window are pruned."""
    rows = bars.where(F.col("source") == source)
    for bound, op in ((after, "gt"), (upto, "le")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            rows = rows.where(F.col("date") > day if op == "gt" else F.col("date") <= day)
            if "year" in bars.columns:
                rows = rows.where(F.col("year") >= F.year(day) if op == "gt" else F.col("year") <= F.year(day))
    return rows


def sessions(bars: DataFrame, source: str, start: str | None, end: str | None, pin: Pin) -> DataFrame:
    """Distinct dates of a source, both ends included. `bars` may be the kept table of sessions, which has one row per date."""
    after = None if start is None else date.fromisoformat(str(start)) - timedelta(days=1)
    return believed(between(bars, source, after, end), pin).select("date").distinct()


def bars_at(bars: DataFrame, source: str, pin: Pin, after: str | date | None = None, upto: str | date | None = None) -> DataFrame:
    """Latest versions of a source's bars with after < date <= upto. The window and the year partitions are pruned before versions are ranked."""
    return latest_version(between(bars, source, after, upto), ["symbol_id", "date"], pin)


def members_on(symbols: DataFrame, links: DataFrame, on: str | date, pin: Pin) -> DataFrame:
    """(symbol_id, entity_id, label_id, isin, ticker, last_break) of every symbol known at the pin: its entity, the member in force on a day with its label, and the
    entity's last boundary up to the day. Links and labels meet by symbol, members by entity; an entity has few members."""
    day = F.lit(on).cast("date")
    state = symbol_links_at(symbols, links, pin).join(labels_in_force(symbols, on, pin), "symbol_id")
    started = F.coalesce("boundary", F.lit(EVER).cast("date")) <= day
    order = F.struct(started, F.col("boundary").isNotNull(), F.coalesce(F.unix_date("boundary"), F.lit(0)), -F.col("symbol_id"))
    best = F.max_by(F.struct(F.col("symbol_id").alias("label_id"), "isin", "ticker"), order).alias("_l")
    entities = state.groupBy("entity_id").agg(F.collect_list("symbol_id").alias("_members"), best, F.max(F.when(F.col("boundary") <= day, F.col("boundary"))).alias("last_break"))
    return entities.select("entity_id", "_l.label_id", "_l.isin", "_l.ticker", "last_break", F.explode("_members").alias("symbol_id"))


def bars_for_date(bars: DataFrame, symbols: DataFrame, links: DataFrame, source: str, on: str, pin: Pin, check: bool = True) -> DataFrame:
    """The bars of a day with entity and label. An entity with two members that day is an error, raised as the rows are read."""
    day = date.fromisoformat(on)
    member = members_on(symbols, links, on, pin).select("symbol_id", "entity_id", "isin", "ticker")
    out = bars_at(bars, source, pin, day - timedelta(days=1), day).join(member, "symbol_id")
    if check:
        traded = F.count(F.lit(1)).over(Window.partitionBy("entity_id"))
        out = out.withColumn("_n", traded).withColumn("entity_id", or_raise(F.col("_n") <= 1, F.col("entity_id"), "more than one member of an entity traded"))
    return out.select("entity_id", "symbol_id", "isin", "ticker", "date", "series", "open", "high", "low", "close", "volume", "turnover")
