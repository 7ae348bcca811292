"""Errors that must stop a read or a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Rows break a rule of the store."""


def assert_empty(df: DataFrame, message: str, show: int = 3) -> None:
    """Raises if df has rows, quoting a few."""
    if found := df.limit(show).collect():
        raise IntegrityError(f"{message}: {[r.asDict() for r in found]}")


def or_raise(ok: Column, value: Column, message: str) -> Column:
    """The value where a condition holds; elsewhere the read fails with the message and the value. No second run of the plan is needed."""
    told = F.raise_error(F.concat(F.lit(f"{message}: "), value.cast("string"))).cast("bigint")
    return F.when(ok, value).otherwise(told)
