"""Index levels: closes, renames, gaps, and how an index agrees with what tracks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import plain_name
from .bitemporal import Pin, latest_version

MAX_GAP_DAYS, MAX_JUMP, WILD_DIFFERENCE, MIN_CORRELATION, MIN_PAIRS = 5, 0.06, 0.25, 0.95, 30
KEY = ["index_code", "date", "source"]


def index_closes(levels: DataFrame, code: str, start: str, end: str, pin: Pin) -> DataFrame:
    rows = levels.where((F.col("index_code") == code) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return latest_version(rows, KEY, pin).select("date", F.col("close").cast("double").alias("close"))


def name_changes(levels: DataFrame, pin: Pin, tolerance: float = MAX_JUMP) -> DataFrame:
    """Days on which an index goes by another name, with the gap and the jump to its last level: verdict UNVERIFIABLE after a gap of
    more than five days or a last level of 0, REBASED after a jump above the tolerance, else CONTINUOUS. Case and spaces make no other name."""
    order = Window.partitionBy("index_code", "source").orderBy("date")
    rows = latest_version(levels, KEY, pin).select("index_code", "source", "date", "index_name", F.col("close").cast("double").alias("close"))
    rows = rows.select("*", *[F.lag(k).over(order).alias(f"prev_{k}") for k in ("date", "index_name", "close")])
    rows = rows.where(plain_name("index_name") != plain_name("prev_index_name"))
    gap, jump = F.datediff("date", "prev_date"), F.try_divide("close", "prev_close") - 1.0
    verdict = F.when((gap > MAX_GAP_DAYS) | jump.isNull(), "UNVERIFIABLE").when(F.abs(jump) > tolerance, "REBASED").otherwise("CONTINUOUS")
    return rows.select("index_code", "date", "prev_index_name", "index_name", gap.cast("bigint").alias("gap_days"), jump.alias("jump"), verdict.alias("verdict"))


def gaps(levels: DataFrame, pin: Pin, longer_than: int = MAX_GAP_DAYS) -> DataFrame:
    """Stretches of more than `longer_than` days without a level, longest first."""
    days = latest_version(levels, KEY, pin).select("index_code", "date").distinct()
    days = days.withColumn("after", F.lag("date").over(Window.partitionBy("index_code").orderBy("date")))
    return days.withColumn("gap_days", F.datediff("date", "after").cast("bigint")).where(F.col("gap_days") > longer_than).select("index_code", "after", F.col("date").alias("until"), "gap_days").orderBy(F.desc("gap_days"), "after")


def calendar_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """Of two sets of dates: how many are in both, in the first only and in the second only."""
    a, b = one.select("date", F.lit(True).alias("_a")).distinct(), other.select("date", F.lit(True).alias("_b")).distinct()
    both = a.join(b, "date", "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("first_only"), F.count_if(F.col("_a").isNull()).alias("second_only"))


def moves_of(one: DataFrame, other: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(date, a, b, diff): daily returns of two close series (date, close) on common dates and how far they lie apart. A return from a close of 0, and dates of
    `excluded` (date), are left out."""
    order = Window.orderBy("date")  # one row per session of an index
    both = one.select("date", F.col("close").alias("_a")).join(other.select("date", F.col("close").alias("_b")), "date")
    moves = both.select("date", *[(F.try_divide(c, F.lag(c).over(order)) - 1.0).alias(n) for c, n in (("_a", "a"), ("_b", "b"))]).where("a is not null and b is not null")
    if excluded is not None:
        moves = moves.join(excluded.select("date").distinct(), "date", "left_anti")
    return moves.withColumn("diff", F.abs(F.col("a") - F.col("b")))


def tracking(one: DataFrame, other: DataFrame, wild: float = WILD_DIFFERENCE, excluded: DataFrame | None = None) -> DataFrame:
    """Daily returns of two close series on common dates: pairs, those dropped for a difference above `wild`, correlation, mean absolute
    difference and the worst day. Dates of `excluded` take no part."""
    moves = moves_of(one, other, excluded)
    kept = F.col("diff") <= wild
    return moves.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~kept).alias("dropped"), F.corr(F.when(kept, F.col("a")), F.when(kept, F.col("b"))).alias("correlation"),
        F.avg(F.when(kept, F.col("diff"))).alias("mean_difference"), F.max_by(F.when(kept, F.col("date")), F.when(kept, F.struct("diff", "date"))).alias("worst_day"),
    )


def tracking_verdict(stats: DataFrame, least: int = MIN_PAIRS) -> DataFrame:
    """tracking() with its verdict: UNVERIFIABLE below so many pairs kept, TRACKS at a correlation of at least MIN_CORRELATION, else DIVERGES."""
    few = F.col("pairs") - F.col("dropped") < least
    return stats.withColumn("verdict", F.when(few | F.col("correlation").isNull(), "UNVERIFIABLE").when(F.col("correlation") >= MIN_CORRELATION, "TRACKS").otherwise("DIVERGES"))
