"""Reports over equity curves and fills, as queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def growth(first: Column, last: Column, years: Column) -> Column:
    """Yearly growth; 0 if a value or the time is not positive."""
    ok = (first > 0) & (last > 0) & (years > 0)
    return F.when(ok, F.pow(last / F.when(first > 0, first), 1 / F.when(years > 0, years)) - 1).otherwise(0.0)


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / 365.25


def drawdowns(curve: DataFrame) -> DataFrame:
    """An equity curve (run, date, equity) with its peak so far and the fall from it."""
    peak = F.max("equity").over(Window.partitionBy("run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, 1 - F.col("equity") / F.col("peak")).otherwise(0.0))


def summary(curve: DataFrame, costs: DataFrame, benchmark: DataFrame, capital: float) -> DataFrame:
    """Per run (curve: run, date, equity, held; costs: run, costs, traded; benchmark: date, close): growth net and before costs, excess over
    the benchmark, deepest fall, sessions without a position, cost share and turnover."""
    per = drawdowns(curve).groupBy("run").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("date").alias("_from"), F.max("date").alias("_to"), F.max_by("equity", "date").alias("final"),
        F.max("drawdown").alias("max_drawdown"), F.count_if(F.col("held") == 0).alias("sessions_in_cash"), F.avg("equity").alias("_mean"),
    )
    level = benchmark.agg(F.min_by("close", "date").alias("_b0"), F.max_by("close", "date").alias("_b1"))
    rows = per.join(costs, "run", "left").crossJoin(F.broadcast(level)).na.fill(0.0, ["costs", "traded"])  # one row
    years, start = years_between(F.col("_from"), F.col("_to")), F.lit(capital)
    net, bench = growth(start, F.col("final"), years), growth(F.col("_b0"), F.col("_b1"), years)
    turnover = F.when((years > 0) & (F.col("_mean") > 0), F.col("traded") / F.when(F.col("_mean") > 0, F.col("_mean")) / F.when(years > 0, years)).otherwise(0.0)
    return rows.select(
        "run", "sessions", "final", net.alias("net_growth"), growth(start, F.col("final") + F.col("costs"), years).alias("gross_growth"), bench.alias("benchmark_growth"),
        (net - bench).alias("excess"), "max_drawdown", "sessions_in_cash", (F.col("costs") / start).alias("cost_share"), turnover.alias("turnover"),
    )


def by_year(curve: DataFrame, benchmark: DataFrame, capital: float) -> DataFrame:
    """Per run and year: the last equity, its return on the year before (the first year on the capital) and the benchmark's; null on a value of 0."""
    last = curve.groupBy("run", F.year("date").alias("year")).agg(F.max_by("equity", "date").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy("run").orderBy("year"))
    bench = benchmark.groupBy(F.year("date").alias("year")).agg(F.max_by("close", "date").alias("_level"), F.min_by("close", "date").alias("_first"))
    bench = bench.withColumn("_before", F.coalesce(F.lag("_level").over(Window.orderBy("year")), F.col("_first")))  # one row per year
    rows = last.withColumn("_prev", F.coalesce(before, F.lit(capital))).join(bench, "year", "left")
    return rows.select("run", "year", "equity", (F.try_divide("equity", "_prev") - 1).alias("return"), (F.try_divide("_level", "_before") - 1).alias("benchmark"))


def worst_days(curve: DataFrame, k: int) -> DataFrame:
    """The k sessions of each run with the largest fall since the session before; a session after an equity of 0 has none."""
    change = F.try_divide("equity", F.lag("equity").over(Window.partitionBy("run").orderBy("date"))) - 1
    rows = curve.withColumn("change", change).where("change is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("change", "date"))).where(F.col("place") <= k).select("run", "place", "date", "change")


TRIPS = "run string, entity_id bigint, seq int, exit date, basis double, proceeds double"


def _values(column) -> list:
    """A column of a batch as a list; nulls stay None."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _fold(batches):
    """Sales of fills that come ordered by entity, run and seq. What is held goes on from batch to batch, so no entity's fills need fit in one row or batch. Only what the
    fold reckons with becomes Python values; sales take the rest from the batch."""
    at_run, at_entity, qty, basis = None, None, 0.0, 0.0
    for batch in batches:
        places, taken, proceeds = [], [], []
        read = [_values(batch.column(c)) for c in ("run", "entity_id", "side", "qty", "value", "costs")]
        for place, (run, entity, side, n, value, costs) in enumerate(zip(*read, strict=True)):
            if entity != at_entity or run != at_run:
                at_run, at_entity, qty, basis = run, entity, 0.0, 0.0
            if side == "buy":
                qty, basis = qty + n, basis + value + costs
            elif qty >= n and qty:
                sold = basis * n / qty
                qty, basis = qty - n, basis - sold
                if sold > 0:
                    places.append(place)
                    taken.append(sold)
                    proceeds.append(value - costs)
        rows = batch.select(["run", "entity_id", "seq", "date"]).take(pa.array(places, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(taken, pa.float64()), pa.array(proceeds, pa.float64())], [x.split(" ")[0] for x in TRIPS.split(", ")])


def round_trips(fills: DataFrame) -> DataFrame:
    """Sales (run, entity_id, seq, date, side, qty, value, costs) with their basis at average cost, proceeds and return.

    A fold over each entity's fills in order of seq; a sale of more than is held is skipped, as is one without basis. Fills are sorted within partitions and pass through as a
    stream: the state is two numbers, whatever the number of an entity's fills. They are sorted by entity before run: a sort compares the first column by itself, and runs are few.
    """
    rows = fills.select("run", F.col("entity_id").cast("bigint"), F.col("seq").cast("int"), "date", "side", F.col("qty").cast("double"), F.col("value").cast("double"), F.col("costs").cast("double"))
    folded = rows.repartition("run", "entity_id").sortWithinPartitions("entity_id", "run", "seq", "side").mapInArrow(_fold, TRIPS)
    return folded.withColumn("return", F.col("proceeds") / F.col("basis") - 1)


def trade_stats(trips: DataFrame) -> DataFrame:
    """Per run: trades, mean and sample deviation of their returns, share of winners."""
    return trips.groupBy("run").agg(F.count(F.lit(1)).alias("trades"), F.avg("return").alias("mean"), F.coalesce(F.stddev_samp("return"), F.lit(0.0)).alias("deviation"), F.avg((F.col("return") > 0).cast("double")).alias("win_rate"))


def reasons(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind).groupBy("run", "detail").agg(F.count(F.lit(1)).alias("count"))


def rupees(amount: float) -> str:
    """Digits grouped as in India: the last three, then by twos."""
    whole, part = f"{abs(amount):.2f}".split(".")
    head, tail = whole[:-3], whole[-3:]
    while head:
        head, tail = head[:-2], head[-2:] + "," + tail
    return ("-" if amount < 0 else "") + f"{tail}.{part}"
