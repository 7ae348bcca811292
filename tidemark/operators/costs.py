"""What a trade costs: dated rates, charges per trade and per day, and the smallest order worth placing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import round2

START, NOTE = "1990-01-01", "2026-09-07"
#: Component, product, side, broker (None: any), effective from, basis, value, cap, floor, verified.
RATES = [
    ("brokerage", None, None, "zerodha", START, "zero", 0.0, None, None, False),
    ("brokerage", None, None, "angelone", NOTE, "capped", 0.001, 20.0, 5.0, True),
    ("brokerage", None, None, "angelone", START, "capped", 0.001, 20.0, 5.0, False),
    ("stt", "equity", None, None, START, "percent", 0.001, None, None, False),
    ("stt", "fund", "buy", None, NOTE, "zero", 0.0, None, None, True),
    ("stt", "fund", "buy", None, START, "zero", 0.0, None, None, False),
    ("stt", "fund", "sell", None, START, "percent", 0.00001, None, None, False),
    ("exchange", None, None, None, NOTE, "percent", 0.000030699, None, None, True),
    ("exchange", None, None, None, START, "percent", 0.000030699, None, None, False),
    ("sebi", None, None, None, NOTE, "percent", 0.000001, None, None, True),
    ("sebi", None, None, None, START, "percent", 0.000001, None, None, False),
    ("ipf", None, None, None, NOTE, "zero", 0.0, None, None, True),
    ("ipf", None, None, None, START, "zero", 0.0, None, None, False),
    ("stamp", None, "buy", None, NOTE, "percent", 0.00015, None, None, True),
    ("stamp", None, "buy", None, "2020-07-01", "percent", 0.00015, None, None, False),
    ("stamp", None, "buy", None, START, "percent", 0.00015, None, None, False),
    ("stamp", None, "sell", None, START, "zero", 0.0, None, None, True),
    ("gst", None, None, None, NOTE, "percent", 0.18, None, None, True),
    ("gst", None, None, None, "2017-07-01", "percent", 0.18, None, None, False),
    ("gst", None, None, None, START, "percent", 0.18, None, None, False),
    ("dp", None, "sell", "zerodha", START, "flat", 15.34, None, None, False),
    ("dp", None, "sell", "angelone", START, "flat", 23.60, None, None, False),
]
COMPONENTS = ("brokerage", "stt", "exchange", "sebi", "ipf", "stamp", "gst")
BROKERS = ("zerodha", "angelone")


RATE = "since date, basis string, value double, cap double, floor double, verified boolean"


def rate_at(component: str, rates=RATES) -> Column:
    """The rate of a component for a row with broker, product, side and date: the most specific that applies, then the latest in
    effect; null if there is none. The table is a short fixed list, so it becomes one expression and no join."""
    fits = sorted((r for r in rates if r[0] == component), key=lambda r: (sum(x is not None for x in r[1:4]), r[4]), reverse=True)
    out = None
    for _, product, side, broker, since, basis, value, cap, floor, verified in fits:
        when = F.lit(since).cast("date") <= F.col("date")
        for name, wanted in (("product", product), ("side", side), ("broker", broker)):
            if wanted is not None:
                when = when & (F.col(name) == wanted)
        fields = zip(RATE.split(", "), (since, basis, value, cap, floor, verified), strict=True)
        rate = F.struct(*[F.lit(x).cast(f.split()[1]).alias(f.split()[0]) for f, x in fields])
        out = F.when(when, rate) if out is None else out.when(when, rate)
    return F.lit(None).cast(f"struct<{RATE.replace(' ', ':').replace(',:', ',')}>") if out is None else out


def rates_in_force(trades: DataFrame, components: tuple[str, ...], rates=RATES) -> DataFrame:
    """Each trade (broker, product, side, date) with its rate of each component. A component without one is left out; callers treat that as an error."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), rate_at(c, rates).alias("r")) for c in components]))
    rows = trades.select("*", each.alias("_rate")).where("_rate.r is not null")
    return rows.select(*trades.columns, "_rate.component", "_rate.r.*")


def term(rate: Column) -> Column:
    """A rate as struct(flat, share, cap, floor, verified) for rupees(): flat is null where a share of the base is charged, cap and floor are null where nothing bounds it."""
    shared, capped = rate["basis"].isin("percent", "capped"), rate["basis"] == "capped"
    flat = F.when(~F.coalesce(shared, F.lit(False)), F.when(rate["basis"] == "flat", rate["value"]).otherwise(0.0))
    return F.when(rate.isNotNull(), F.struct(flat.alias("flat"), rate["value"].alias("share"), F.when(capped, rate["cap"]).alias("cap"), F.when(capped, rate["floor"]).alias("floor"), rate["verified"].alias("verified")))


def rupees(base: Column, term: Column) -> Column:
    """The charge of a term on a base, to the paisa. least and greatest pass over nulls."""
    return round2(F.coalesce(term["flat"], F.greatest(F.least(term["share"] * base, term["cap"]), term["floor"])))


def with_terms(trades: DataFrame, components: tuple[str, ...], rates=RATES) -> DataFrame:
    """Trades (broker, product, side, date) with the term of each component as `_<component>`, null if it has no rate.

    Rates change only on the days they name, and values that none of them names fare alike. So one sheet has a row for each kind of trade and stretch of days, as rate_at()
    finds it, and goes to the trades. As expressions of each trade, all components' rates make a method of over 8,000 bytes, which the JVM does not compile."""
    own = [r for r in rates if r[0] in components]
    kinds, keys = [()], {}
    for i, name in enumerate(("product", "side", "broker"), start=1):
        named = sorted({r[i] for r in own if r[i] is not None})
        kinds = [(*k, v) for k in kinds for v in (*named, None)]
        keys[name] = F.when(F.col(name).isin(named), F.col(name)) if named else F.lit(None).cast("string")
    days = sorted({r[4] for r in own}, reverse=True)
    keys["since"] = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("date") >= F.lit(d).cast("date"), F.lit(d)) for d in days])
    kinds = pa.Table.from_pylist([dict(zip(keys, (*k, d), strict=True)) for k in kinds for d in days], pa.schema([(k, pa.string()) for k in keys]))
    sheet = trades.sparkSession.createDataFrame(kinds).withColumn("date", F.col("since").cast("date"))
    sheet = sheet.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[term(rate_at(c, rates)).alias(f"_{c}") for c in components])
    rows = trades.withColumns({f"_its_{k}": v for k, v in keys.items()})
    same = [F.col(f"_its_{k}").eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(F.broadcast(sheet), same, "left").drop(*[f"_{x}_{k}" for x in ("its", "of") for k in keys])


def trade_charges(trades: DataFrame, rates=RATES) -> DataFrame:
    """Trades (broker, product, side, date, qty, price) with turnover, each charge, taxable, gst, verified, total and net
    (what leaves the account; negative for a sale). Each line is rounded; tax is rounded once on the rounded sum. Nothing is shuffled.
    A trade for which a component has no rate is an error."""
    rows = with_terms(trades.withColumn("turnover", round2(F.col("qty").cast("double") * F.col("price"))), COMPONENTS, rates)
    known = F.lit(True)
    for c in COMPONENTS:
        known = known & F.col(f"_{c}").isNotNull()
    ident = F.concat_ws(" ", "broker", "product", "side", F.col("date").cast("string"))
    missing = F.when(known, 0.0).otherwise(F.raise_error(F.concat(F.lit("no rate for "), ident)).cast("double"))
    verified = F.lit(True)
    for c in COMPONENTS:
        verified = verified & F.col(f"_{c}.verified")
    rows = rows.withColumns({c: rupees(F.col("turnover"), F.col(f"_{c}")) for c in COMPONENTS if c != "gst"} | {"verified": verified})
    rows = rows.withColumn("taxable", round2(missing + F.col("brokerage") + F.col("exchange") + F.col("sebi") + F.col("ipf")))
    rows = rows.withColumn("gst", round2(F.col("_gst.share") * F.col("taxable"))).drop(*[f"_{c}" for c in COMPONENTS])
    rows = rows.withColumn("total", round2(F.col("taxable") + F.col("gst") + F.col("stt") + F.col("stamp")))
    sign = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
    return rows.withColumn("net", round2(sign * F.col("turnover") + F.col("total")))


def day_charges(trades: DataFrame, rates=RATES) -> DataFrame:
    """Per account and day: charges of all trades, and the depository's charge, flat per distinct scrip sold. One shuffle; a group holds
    the scrips that one account sold on one day."""
    sold = F.col("side") == "sell"
    sums = trade_charges(trades, rates).groupBy("account", "broker", "date").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("total").alias("_t"), F.size(F.collect_set(F.when(sold, F.col("scrip")))).cast("bigint").alias("scrips_sold"),
        F.max_by(F.when(sold, F.col("product")), F.when(sold, F.col("trade_id"))).alias("product"),
    )
    flat = F.col("_dp.value")
    out = sums.withColumn("side", F.lit("sell")).withColumn("_dp", rate_at("dp", rates)).withColumn("dp", round2(F.coalesce(F.col("scrips_sold") * flat, F.lit(0.0))))
    return out.select("account", "broker", "date", "trades", "scrips_sold", round2("_t").alias("charges"), "dp", round2(F.col("_t") + F.col("dp")).alias("total"))


def round_trips(spark: SparkSession, on: str = NOTE, product: str = "equity", slippage_bps: float = 0.0, lowest: int = 100, highest: int = 2_000_000, step: int = 100, brokers=BROKERS, sizes: DataFrame | None = None) -> DataFrame:
    """(broker, notional, cost, share): what buying and selling one order of each size costs, with slippage on both ways. sizes (notional): the sizes to look at; by
    default a range of them."""
    if sizes is None:
        sizes = spark.range(lowest, highest + 1, step).select(F.col("id").alias("notional"))
    both = sizes.crossJoin(spark.createDataFrame([(b, s) for b in brokers for s in ("buy", "sell")], "broker string, side string"))
    asked = both.select(F.concat_ws("|", "broker", "side", F.col("notional").cast("string")).alias("trade_id"), "broker", F.lit(product).alias("product"), "side", F.lit(on).cast("date").alias("date"), F.lit(1).alias("qty"), F.col("notional").cast("double").alias("price"), "notional")
    priced = trade_charges(asked).groupBy("broker", "notional").agg(F.sum("total").alias("_c"))
    priced = priced.withColumns({"product": F.lit(product), "side": F.lit("sell"), "date": F.lit(on).cast("date")}).withColumn("_dp", rate_at("dp"))
    cost = round2(F.col("_c") + F.col("_dp.value") + 2.0 * F.col("notional") * slippage_bps / 10000.0)
    return priced.select("broker", "notional", cost.alias("cost"), (cost / F.col("notional")).alias("share"))


def min_notional(curve: DataFrame, cap: float = 0.005) -> DataFrame:
    """The smallest order of each broker whose round trip costs at most a share of it. A share that no order reaches is an error."""
    least = F.min(F.when(F.col("share") <= cap, F.col("notional")))
    return curve.groupBy("broker").agg(F.coalesce(least, F.raise_error(F.concat(F.lit("no order is worth placing with "), F.col("broker"))).cast("bigint")).alias("min_notional"))
