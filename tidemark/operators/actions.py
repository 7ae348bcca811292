"""Corporate actions: found as steps between an unadjusted and an adjusted price series, read back at a pin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import simple_fraction
from .bitemporal import Pin, believed, entity_map, latest_version

CORROBORATION = 0.10
KEY = ["entity_id", "ex_date"]


def keyed_symbols(symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(symbol_id, entity_id, key): each symbol under its entity and under its latest ticker, as either may bridge what the other breaks."""
    label = latest_version(symbols, ["symbol_id"], pin).select("symbol_id", "ticker")
    keys = F.array(F.concat(F.lit("e:"), F.col("entity_id").cast("string")), F.concat(F.lit("t:"), F.col("ticker")))
    return entity_map(symbols, links, pin).join(label, "symbol_id").select("symbol_id", "entity_id", F.explode(keys).alias("key"))


def factor_steps(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin, min_step: float = 0.02) -> DataFrame:
    """Days on which the factor between the two series moves by more than min_step: one row per entity and day."""
    if not 0 < min_step < 1:
        raise ValueError("min_step must be between 0 and 1")
    keys = keyed_symbols(symbols, links, pin)

    def series(source: str) -> DataFrame:
        rows = believed(bars.where((F.col("source") == source) & (F.col("close") > 0)), pin).join(keys, "symbol_id")
        newest = Window.partitionBy("key", "date").orderBy(F.desc("ingested_at"), F.desc("symbol_id"))
        return rows.withColumn("_v", F.row_number().over(newest)).where("_v = 1").select("key", "date", "entity_id", F.col("close").cast("double").alias("close"))

    both = series("nse-bhavcopy").join(series("eod2").select("key", "date", F.col("close").alias("_adjusted")), ["key", "date"])
    both = both.withColumn("factor", F.col("close") / F.col("_adjusted"))
    order = Window.partitionBy("key").orderBy("date")
    steps = both.select("*", *[F.lag(x).over(order).alias(f"prev_{y}") for x, y in (("factor", "factor"), ("close", "close"), ("date", "date"))])
    steps = steps.withColumn("ratio", F.col("prev_factor") / F.col("factor")).where(F.abs(F.col("ratio") - 1.0) > min_step)
    one = Window.partitionBy("entity_id", "date").orderBy("key")
    return steps.withColumn("_k", F.row_number().over(one)).where("_k = 1").select("entity_id", F.col("date").alias("ex_date"), "prev_date", "ratio", "prev_close", "close", "prev_factor", "factor", "key")


def detect(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin, min_step: float = 0.02, fraction_tolerance: float = 0.01) -> DataFrame:
    """Each step with its outcome: `share action` with the exact ratio, `unclassified` (no simple fraction) or `uncorroborated`
    (the price did not move against it within 10 %)."""
    steps = factor_steps(bars, symbols, links, pin, min_step).withColumn("_f", simple_fraction("ratio", fraction_tolerance))
    exact = F.col("_f.num").cast("double") / F.col("_f.den")
    agrees = F.abs(F.col("close") / F.col("prev_close") * exact - 1.0) <= CORROBORATION
    outcome = F.when(F.col("_f").isNull(), "unclassified").when(agrees, "share action").otherwise("uncorroborated")
    return steps.select("entity_id", "ex_date", "prev_date", "ratio", "prev_close", "close", F.col("_f.num").alias("num"), F.col("_f.den").alias("den"), exact.alias("exact"), outcome.alias("outcome"))


def detection_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_") + "s" * (o == "share action")) for o in ("unclassified", "uncorroborated", "share action")])


def current_actions(adjustments: DataFrame, pin: Pin, source: str | None = None) -> DataFrame:
    """(entity_id, ex_date, ratio as double): the latest row of each entity and day at the pin, of one source if named."""
    rows = adjustments if source is None else adjustments.where(F.col("source") == source)
    return latest_version(rows, KEY, pin).select(*KEY, F.col("ratio").cast("double").alias("ratio"))


def actions_on(adjustments: DataFrame, day: str, pin: Pin) -> DataFrame:
    return current_actions(adjustments, pin).where(F.col("ex_date") == F.lit(day).cast("date"))


def actions_between(adjustments: DataFrame, after: str, upto: str, pin: Pin) -> DataFrame:
    """Per entity with actions in (after, upto]: their number, dates in order, and the product of their ratios."""
    rows = current_actions(adjustments, pin).where((F.col("ex_date") > F.lit(after).cast("date")) & (F.col("ex_date") <= F.lit(upto).cast("date")))
    listed = F.array_sort(F.collect_list(F.struct("ex_date", "ratio")))
    return rows.groupBy("entity_id").agg(listed.alias("actions"), F.product("ratio").alias("product"))


def coverage(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """How many entities have both series, and how many the unadjusted one only."""
    rows = believed(bars, pin).select("symbol_id", "source").distinct().join(entity_map(symbols, links, pin), "symbol_id")
    per = rows.groupBy("entity_id").agg(F.bool_or(F.col("source") == "nse-bhavcopy").alias("raw"), F.bool_or(F.col("source") == "eod2").alias("adjusted"))
    return per.where("raw").agg(F.count_if("adjusted").alias("both"), F.count_if(~F.col("adjusted")).alias("unadjusted_only"))
