"""Content hashes: a row is a new version only if its hash differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: str, kind: str) -> Column:
    return F.coalesce(F.col(col).cast(kind).cast("string"), F.lit("-"))


def bar_hash() -> Column:
    """Over symbol, date, series, prices to four places, volume, turnover and delivery; nulls as a dash. Decimal text is the same in any engine."""
    parts = [F.col("symbol_id").cast("string"), F.col("date").cast("string"), F.col("series")]
    parts += [_text(k, "decimal(14,4)") for k in ("open", "high", "low", "close")]
    parts += [F.col("volume").cast("string"), _text("turnover", "decimal(20,2)"), _text("delivery_qty", "bigint")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def index_hash() -> Column:
    names = ("open", "high", "low", "close", "points_change", "pct_change", "pe", "pb", "div_yield")
    parts = [F.col("index_code"), F.col("date").cast("string"), F.col("index_name")]
    parts += [_text(k, "decimal(14,4)") for k in names] + [_text("volume", "bigint"), _text("turnover", "decimal(20,2)")]
    return F.sha2(F.concat_ws("|", *parts), 256)
