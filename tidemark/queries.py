"""The registry: each query opens the staged tables of a folder and applies one operator. Dates go out as text, decimals as doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DateType, DecimalType, TimestampType

from .functions import aliases, scalars
from .functions.scalars import fixed6
from .operators import actions, backtest, bitemporal, costs, identity, indices, preisin, provenance, report, returns, signals, universe
from .operators.hashing import bar_hash
from .oracle import AS_OF, BEFORE_ACTIONS, DECISIONS, GUARD_SPAN, LOOKBACK, SPAN, STALE, WINDOWS
from .plans import ingest, storage
from .plans.staging import PIN, PIN_NEW, PIN_OLD, Tables, stage

Query = Callable[[SparkSession, str], DataFrame]
NSE = "nse-bhavcopy"
WEEKLY = {"span": GUARD_SPAN, "stale": STALE}


def plain(df: DataFrame, *rounded: str) -> DataFrame:
    """Dates and times as text, decimals as doubles, the named columns to six places."""
    out = {}
    for f in df.schema.fields:
        if f.name in rounded:
            out[f.name] = fixed6(f.name)
        elif isinstance(f.dataType, (DateType, TimestampType)):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, DecimalType):
            out[f.name] = F.col(f.name).cast("double")
    return df.withColumns(out) if out else df


def on(f: Callable[[Tables], DataFrame], *rounded: str) -> Query:
    return lambda spark, sf_dir: plain(f(stage(spark, sf_dir)), *rounded)


def _bars(df: DataFrame) -> DataFrame:
    return df.select("symbol_id", "date", "source", "ingested_at", "series", "close", "volume", "turnover")


def _universe(**kw) -> Query:
    args = {"source": NSE, "as_of": AS_OF, "pin": PIN} | kw
    return on(lambda t: universe.universe_as_of(t.bars, t.symbols, t.symbol_links, lookback=LOOKBACK, n=50, span_days=SPAN, calendar=t.sessions, **args), "median_turnover")


def _returns(t: Tables, pin: str = PIN) -> DataFrame:
    return returns.entity_returns(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, WINDOWS, pin, **WEEKLY, calendar=t.sessions)


def _closes(t: Tables) -> DataFrame:
    return returns.entity_closes(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, "1997-01-06", "1998-12-28", PIN, span=GUARD_SPAN, calendar=t.sessions)


def _detect(t: Tables) -> DataFrame:
    return actions.detect(t.bars, t.symbols, t.symbol_links, PIN)


def _changed(t: Tables) -> DataFrame:
    """Versions of a bar whose content differs from the version before."""
    rows = t.bars.select("source", "symbol_id", "date", "ingested_at", bar_hash().alias("new_hash"))
    before = F.lag("new_hash").over(Window.partitionBy("source", "symbol_id", "date").orderBy("ingested_at"))
    return rows.withColumn("old_hash", before).where("old_hash <> new_hash").select("source", "symbol_id", "date", "old_hash", "new_hash")


def _rerun(t: Tables) -> DataFrame:
    """Inserts all bars of a source, as believed at the pin, into an empty store, and then once more."""
    spark = t.bars.sparkSession
    names = bitemporal.latest_version(t.symbols, ["symbol_id"], PIN).select("symbol_id", "isin", "ticker")
    batch = bitemporal.bars_at(t.bars, NSE, PIN).join(names, "symbol_id").select("isin", "ticker", "date", "series", "open", "high", "low", "close", "volume", "turnover")
    root = storage.new_path(spark, "rerun")
    added = [(i, ingest.insert_bars(spark, root, NSE, batch, f"2003-01-0{i + 1} 00:00:00")) for i in (1, 2)]
    return spark.createDataFrame(added, "run int, rows_added bigint")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from the order lines: one of each account, broker, side, supplier and day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keyed = lines.select(
        F.concat(F.lit("acc"), (F.col("l_suppkey") % 5).cast("string")).alias("account"), F.when(F.col("l_orderkey") % 2 == 0, "zerodha").otherwise("angelone").alias("broker"),
        F.when(F.col("l_suppkey") % 13 == 6, "fund").otherwise("equity").alias("product"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("scrip"), "l_quantity", "l_extendedprice",
    )
    per = keyed.groupBy("account", "broker", "product", "side", "date", "scrip").agg(F.sum("l_quantity").cast("bigint").alias("qty"), F.max("l_extendedprice").alias("_p"))
    ident = F.concat_ws("|", "account", "broker", "side", F.col("scrip").cast("string"), F.col("date").cast("string"))
    return per.select("*", ident.alias("trade_id"), (F.floor(F.col("_p") / F.col("qty") * 100) / 100).cast("double").alias("price")).drop("_p")


def _trade_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.trade_charges(trades(spark, sf_dir)).select("trade_id", "turnover", "brokerage", "stt", "exchange", "sebi", "ipf", "stamp", "taxable", "gst", "total", "net", "verified")


def _day_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(costs.day_charges(trades(spark, sf_dir)).select("account", "broker", "date", "trades", "scrips_sold", "charges", "dp"))


def _rate_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = trades(spark, sf_dir).select("broker", "product", "side").distinct().crossJoin(spark.range(21))
    asked = kinds.select("broker", "product", "side", F.date_add(F.lit("2026-09-07").cast("date"), (F.col("id") * 400 - 8000).cast("int")).alias("date"), F.concat("broker", "product", "side", F.col("id").cast("string")).alias("trade_id"))
    return plain(costs.rates_in_force(asked, costs.COMPONENTS).select("trade_id", "component", "since", "basis", "value", "verified"))


def _gates(t: Tables) -> DataFrame:
    return identity.gate_results(t.bars, t.symbols, t.symbol_links, t.ingest_log, NSE, PIN, max_gap_days=8, expected=t.cal.select(F.col("d").alias("date")), calendar=t.sessions)


def _asked_pairs(t: Tables) -> DataFrame:
    """Pairs that no generator proposes: every first issue with the second issue of other suppliers."""
    rows = t.symbols.select((F.col("symbol_id") / 2).cast("bigint").alias("s")).distinct()
    other = rows.select("s", F.explode(F.array(F.lit(-3), F.lit(5), F.lit(10))).alias("k")).where("s + k >= 0")
    return other.select((2 * F.col("s")).alias("predecessor"), (2 * (F.col("s") + F.col("k")) + 1).alias("successor"))


def _pair_evidence(t: Tables) -> DataFrame:
    found = identity.gate_results(t.bars, t.symbols, t.symbol_links, t.ingest_log, NSE, PIN, calendar=t.sessions, pairs=_asked_pairs(t))
    return found.select("predecessor", "successor", "shared_days", "sessions_between", "unsettled_between", "days_between", "ratio", "band", "serial", "predecessor_bars", "successor_bars", *identity.GATES, "accepted")


def _tangled(t: Tables) -> DataFrame:
    """The real links and, beside them, links that break the rules for the invariants to find: every first issue is hung on its neighbour's, in
    chains of two hops over symbols that trade on the same days."""
    rows = t.symbols.select((F.col("symbol_id") / 2).cast("bigint").alias("s")).distinct()
    made = rows.select((2 * F.col("s")).alias("symbol_id"), (2 * F.col("s") + 2).alias("entity_id"), F.lit("manual").alias("reason"), F.lit(None).cast("date").alias("boundary"), F.lit(None).cast("bigint").alias("predecessor"), F.lit("2002-06-01").cast("timestamp").alias("ingested_at"))
    return made.unionByName(t.symbol_links.select(*made.columns))


def _early_names(t: Tables) -> DataFrame:
    """Prices under names that change every 13 to 16 sessions, of every sixth supplier every 40."""
    rows = bitemporal.bars_at(t.bars, NSE, PIN).join(t.cal, F.col("date") == F.col("d")).withColumn("s", (F.col("symbol_id") / 2).cast("bigint"))
    width = F.when(F.col("s") % 6 == 0, 40).otherwise(13 + F.col("s") % 4)
    name = F.concat(F.lit("T"), F.col("s").cast("string"), F.lit("-"), ((F.col("n") - 1 + 7 * F.col("s")) / width).cast("bigint").cast("string"))
    return rows.select("date", "n", "s", name.alias("ticker"), (F.col("close").cast("double") * (1 + F.col("s"))).alias("close"))


def _pre_isin(t: Tables) -> DataFrame:
    """Names up to session 130 are observed without ISIN, those from it on have one; every sixth supplier is away until session 150."""
    rows = _early_names(t)
    ends = [F.min("date").alias("first_date"), F.min_by("close", "date").alias("first_close"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close")]
    observed = rows.where("n <= 130").groupBy("ticker").agg(*ends)
    later = rows.where("n >= 130 and not (s % 6 = 0 and n < 150)").groupBy("ticker").agg(*ends[:2]).withColumn("isin", F.concat(F.lit("INE"), "ticker"))
    return preisin.assignments(observed, later, _sessions(t)).select("ticker", "kind", "identity", "gap_sessions")


def _isins(t: Tables) -> DataFrame:
    """Identifiers right and wrong: each ISIN and one with its last digit moved on."""
    good = t.symbols.select("isin").distinct()
    return good.unionByName(good.select(F.concat(F.substring("isin", 1, 11), ((F.substring("isin", 12, 1).cast("int") + 1) % 10).cast("string")).alias("isin")))


def _ratios(t: Tables) -> DataFrame:
    """How many times its last close each close is, to four places."""
    before = F.lag("close").over(Window.partitionBy("symbol_id").orderBy("date"))
    rows = bitemporal.bars_at(t.bars, NSE, PIN).select("symbol_id", "date", F.col("close").cast("double").alias("close"))
    rows = rows.withColumn("_before", before).where("_before > 0")
    return rows.select(scalars.round4(F.col("close") / F.col("_before")).alias("ratio")).distinct()


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of all trades, in hundreds."""
    return trades(spark, sf_dir).select((F.ceil(F.col("qty") * F.col("price") / 100) * 100).cast("bigint").alias("notional")).distinct()


def _names(t: Tables) -> DataFrame:
    named = t.index_levels.select("index_name", "date")
    return named.unionByName(named.select(F.when(F.dayofmonth("date") == 1, "CNX  nifty").otherwise("S&P CNX Nifty").alias("index_name"), "date"))


def _ranked(t: Tables, kind: str) -> DataFrame:
    days = t.bars.sparkSession.createDataFrame([(d,) for d in DECISIONS], "date string").select(F.col("date").cast("date"))
    members = signals.universes(t.bars, t.symbols, t.symbol_links, NSE, days, LOOKBACK, 40, PIN, t.sessions)
    if kind == "turnover":
        return members.select(F.col("as_of"), "entity_id", "median_turnover", F.col("place").alias("rank"))
    members = storage.kept(members, "members")
    formation, skip = (12, 1) if kind == "momentum" else (1, 0)
    windows = signals.return_windows(DECISIONS, formation, skip)
    got = returns.entity_returns(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, windows, PIN, ids=members.select("entity_id").distinct(), **WEEKLY, calendar=t.sessions).where("status = 'priced'")
    named = t.bars.sparkSession.createDataFrame(list(enumerate(DECISIONS)), "window int, as_of string").select("window", F.col("as_of").cast("date"))
    rows = got.join(named, "window").select("as_of", "entity_id", "return").join(members.select("as_of", "entity_id"), ["as_of", "entity_id"])
    return signals.rank_by(rows, "return", kind == "reversal").select("as_of", "entity_id", "return", "rank")


def _accounted(t: Tables) -> DataFrame:
    """Each member of the universes of the decision days with its momentum rank, or why it has none."""
    days = t.bars.sparkSession.createDataFrame([(d,) for d in DECISIONS], "date string").select(F.col("date").cast("date"))
    members = storage.kept(signals.universes(t.bars, t.symbols, t.symbol_links, NSE, days, LOOKBACK, 40, PIN, t.sessions), "members")
    got = returns.entity_returns(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, signals.return_windows(DECISIONS, 12, 1), PIN, ids=members.select("entity_id").distinct(), **WEEKLY, calendar=t.sessions)
    named = t.bars.sparkSession.createDataFrame(list(enumerate(DECISIONS)), "window int, as_of string").select("window", F.col("as_of").cast("date"))
    rows = got.join(named, "window").join(members.select("as_of", "entity_id"), ["as_of", "entity_id"])
    ranked = signals.rank_by(rows.where("status = 'priced'").select("as_of", "entity_id", "return"), "return", False)
    return signals.accounted(ranked, members, rows)


def _low_volatility(t: Tables) -> DataFrame:
    members = universe.universe_as_of(t.bars, t.symbols, t.symbol_links, NSE, AS_OF, LOOKBACK, 40, PIN, span_days=SPAN, calendar=t.sessions)
    vol = returns.entity_volatility(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, "1999-09-25", AS_OF, PIN, ids=members, span=GUARD_SPAN, min_returns=30, calendar=t.sessions)
    return signals.rank_by(vol.withColumn("as_of", F.lit(AS_OF)), "volatility", True).select("entity_id", "volatility", "rank")


def _sessions(t: Tables) -> DataFrame:
    return t.cal.select(F.col("d").alias("date"))


def _curve(t: Tables) -> DataFrame:
    """A deterministic equity curve of two runs from the index."""
    rows = t.index_levels.select("date", F.col("close").cast("double").alias("close"), F.dayofyear("date").alias("k"))
    runs = [rows.select(F.lit(r).alias("run"), "date", (F.col("close") * (1 + F.lit(a) * F.sin(F.col("k") / 10.0)) * 4).alias("equity"), F.when(F.col("k") % 11 == 0, 0).otherwise(5).alias("held")) for r, a in (("calm", 0.01), ("wild", 0.2))]
    return runs[0].unionByName(runs[1])


def _bench(t: Tables) -> DataFrame:
    return t.index_levels.select("date", F.col("close").cast("double").alias("close"))


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from the trades: odd days sell, with a number in the order of the day."""
    rows = costs.trade_charges(trades(spark, sf_dir)).withColumn("run", F.col("broker"))
    one = rows.groupBy("run", F.col("scrip").alias("entity_id"), "date", "side").agg(F.sum("qty").alias("qty"), F.sum("turnover").alias("value"), F.sum("total").alias("costs"))
    return one.select("*", (F.datediff("date", F.lit("1990-01-01").cast("date")) * 2 + (F.col("side") == "sell").cast("int")).alias("seq"))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.round_trips(_fills(spark, sf_dir))


def _setups(offsets: list[int], **kw) -> dict[str, backtest.Setup]:
    return {f"momentum+{o}": backtest.Setup(**{"top": 8, "max_stock": 0.5} | kw) for o in offsets}


def _events(t: Tables, offsets: list[int], **kw) -> DataFrame:
    """Momentum backtests, one for each number of sessions between month end and decision."""
    spark = t.bars.sparkSession
    sessions = _sessions(t)
    calendar = {o: [str(r["date"]) for r in signals.rebalance_calendar(sessions, 3, o).orderBy("date").collect()] for o in offsets}
    days = sorted({d for ds in calendar.values() for d in ds})  # a few decision days a year
    frame = spark.createDataFrame([(d,) for d in days], "date string").select(F.col("date").cast("date"))
    members = storage.kept(signals.universes(t.bars, t.symbols, t.symbol_links, NSE, frame, LOOKBACK, 40, PIN, t.sessions).select("as_of", "entity_id"), "members")
    got = returns.entity_returns(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, signals.return_windows(days, 12, 1), PIN, ids=members.select("entity_id").distinct(), **WEEKLY, calendar=t.sessions).where("status = 'priced'")
    named = spark.createDataFrame(list(enumerate(days)), "window int, as_of string").select("window", F.col("as_of").cast("date"))
    ranked = storage.kept(signals.rank_by(got.join(named, "window").join(members, ["as_of", "entity_id"]), "return", False).select(F.col("as_of").alias("date"), "entity_id", "rank"), "ranked")
    runs = spark.createDataFrame([(f"momentum+{o}", d) for o, ds in calendar.items() for d in ds], "run string, date string").select("run", F.col("date").cast("date"))
    stance = signals.trend_stance(t.index_levels, "NIFTYX", sessions, 20, PIN)
    # Only names that some day ranks, at most its universe, have their prices read: their symbols go to the bars.
    ever = bitemporal.entity_map(t.symbols, t.symbol_links, PIN).join(F.broadcast(ranked.select("entity_id").distinct()), "entity_id", "left_semi")
    prices = bitemporal.bars_at(t.bars, NSE, PIN).join(F.broadcast(ever), "symbol_id").select("date", "entity_id", "open", "close")
    return backtest.backtests(prices, actions.current_actions(t.adjustments, PIN), ranked.join(runs, "date"), stance, _setups(offsets, **kw))


def _backtest_report(t: Tables, offsets: list[int]) -> DataFrame:
    events = _events(t, offsets)
    curve = events.where("kind = 'equity'").select("run", "date", F.col("amount").alias("equity"), "held")
    spent = events.where("kind = 'fill'").groupBy("run").agg(F.sum("charges").alias("costs"), F.sum("amount").alias("traded"))
    return report.summary(curve, spent, _bench(t), 500_000.0)


def _snapshot(t: Tables) -> DataFrame:
    return provenance.snapshot_parts(t.bars, t.symbols, t.symbol_links, t.index_levels, t.adjustments, PIN)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of runs: one for each tenth of the customers and year of their orders, with one of three configurations."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 10).alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").cast("date").alias("d"))
    per = orders.groupBy("k", "y").agg(F.max("d").alias("period_to"))
    hashes = F.element_at(F.array(*[F.lit(provenance.digest_of({"top": i})) for i in range(3)]), (F.col("k") % 3 + 1).cast("int"))
    return per.select(F.concat_ws("-", F.lit("run"), "k", "y").alias("run_id"), hashes.alias("config_hash"), "period_to", F.date_add("period_to", (F.col("k") + 1).cast("int")).cast("timestamp").alias("finished_at"))


def _lanes(t: Tables) -> DataFrame:
    return provenance.lane_parts(t.bars, PIN)


def queries() -> dict[str, Query]:
    B, U = bitemporal, universe
    return {
        "bars_latest_at_pin": on(lambda t: _bars(B.latest_version(t.bars, ["source", "symbol_id", "date"], PIN))),
        "bars_unpinned_latest": on(lambda t: _bars(B.latest_version(t.bars, ["source", "symbol_id", "date"], None))),
        "symbols_latest": on(lambda t: B.latest_version(t.symbols, ["symbol_id"], PIN).select("symbol_id", "isin", "ticker", "valid_from")),
        "label_as_of": on(lambda t: B.labels_in_force(t.symbols, AS_OF, PIN)),
        "label_prehistory_fallback": on(lambda t: B.labels_in_force(t.symbols, "0001-01-01", PIN)),
        "entity_map_at_pin": on(lambda t: B.entity_map(t.symbols, t.symbol_links, PIN)),
        "entity_map_before_links": on(lambda t: B.entity_map(t.symbols, t.symbol_links, "2002-01-01")),
        "entity_map_after_retractions": on(lambda t: B.entity_map(t.symbols, t.symbol_links, PIN_NEW)),
        "entity_member_in_force": on(lambda t: B.entity_members(t.symbols, t.symbol_links, "1997-10-01", PIN)),
        "entity_label": on(lambda t: B.entity_labels(t.symbols, t.symbol_links, AS_OF, PIN)),
        "sessions_range": on(lambda t: B.sessions(t.sessions, "eod2", "1997-01-06", "1999-12-27", PIN)),
        "bars_for_date": on(lambda t: B.bars_for_date(t.bars, t.symbols, t.symbol_links, NSE, AS_OF, PIN).drop("open", "high", "low")),
        "universe_default": _universe(),
        "universe_allow_stale": _universe(allow_stale=True),
        "universe_equities_only": _universe(equities_only=True),
        "universe_eod2": _universe(source="eod2"),
        "universe_at_new_pin": _universe(pin=PIN_NEW),
        "universe_at_old_pin": _universe(pin=PIN_OLD),
        "universe_across_split": _universe(as_of="1998-06-08"),
        "universe_window_size": on(lambda t: U.window_days(t.sessions, NSE, AS_OF, LOOKBACK, PIN, SPAN).agg(F.count(F.lit(1)).alias("sessions"), F.max("date").alias("last_session"))),
        "boundaries": on(lambda t: returns.boundaries(t.symbols, t.symbol_links, PIN)),
        "guard_starts": on(lambda t: returns.guard_starts(returns.boundaries(t.symbols, t.symbol_links, PIN), B.sessions(t.sessions, NSE, None, None, PIN), span=GUARD_SPAN)),
        "endpoint_closes": on(lambda t: returns.endpoint_closes(t.bars, t.symbols, t.symbol_links, NSE, WINDOWS, PIN, STALE), "f_close", "t_close"),
        "returns_status": on(lambda t: _returns(t).select("window", "entity_id", "status", "reason")),
        "returns_before_actions": on(lambda t: _returns(t, BEFORE_ACTIONS).select("window", "entity_id", "status", F.when(F.col("reason") == "boundary", F.col("boundary")).alias("boundary"))),
        "returns_priced": on(lambda t: _returns(t).where("status = 'priced'").select("window", "entity_id", "ratio", "return"), "ratio", "return"),
        "closes_back_adjusted": on(_closes, "adjusted"),
        "volatility_annualised": on(lambda t: returns.entity_volatility(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, "1997-01-06", "2000-09-25", PIN, span=GUARD_SPAN, min_returns=60, calendar=t.sessions), "volatility"),
        "volatility_status": on(lambda t: returns.volatility_status(t.bars, t.symbols, t.symbol_links, t.adjustments, NSE, "1997-01-06", "2000-09-25", PIN, span=GUARD_SPAN, min_returns=60, calendar=t.sessions), "volatility"),
        "momentum_accounted": on(_accounted),
        "factor_steps": on(lambda t: actions.factor_steps(t.bars, t.symbols, t.symbol_links, PIN).select("entity_id", "ex_date", "prev_date", "ratio", "prev_close", "close", "key"), "ratio"),
        "share_actions": on(lambda t: _detect(t).select("entity_id", "ex_date", "ratio", "num", "den", "outcome"), "ratio"),
        "detection_summary": on(lambda t: actions.detection_summary(_detect(t))),
        "actions_between_product": on(lambda t: actions.actions_between(t.adjustments, "1997-01-06", "1998-06-08", PIN).select("entity_id", F.size("actions").cast("bigint").alias("actions"), "product"), "product"),
        "action_coverage": on(lambda t: actions.coverage(t.bars, t.symbols, t.symbol_links, PIN)),
        "index_closes": on(lambda t: indices.index_closes(t.index_levels, "NIFTYX", "1997-12-01", "1998-02-01", PIN)),
        "index_name_changes": on(lambda t: indices.name_changes(t.index_levels, PIN), "jump"),
        "index_gaps": on(lambda t: indices.gaps(t.index_levels, PIN)),
        "calendar_agreement": on(lambda t: indices.calendar_agreement(B.sessions(t.sessions, NSE, None, None, None), t.index_levels)),
        "content_hash_change_detect": on(_changed),
        "ingest_noop_rerun": on(_rerun),
        "trade_charges": _trade_charges,
        "day_charges": _day_charges,
        "rate_in_force": _rate_in_force,
        "round_trip_curve": lambda spark, sf_dir: plain(costs.round_trips(spark, sizes=_sizes(spark, sf_dir)), "share"),
        "min_notional_by_broker": lambda spark, sf_dir: costs.min_notional(costs.round_trips(spark, sizes=_sizes(spark, sf_dir))),
        "succession_candidates": on(lambda t: identity.candidates(identity.symbol_facts(t.bars, t.symbols, NSE, PIN, t.sessions))),
        "gate_results": on(lambda t: _gates(t).select("predecessor", "successor", "generator", "last_date", "first_date", *identity.GATES, "retracted", "g5_path", "accepted")),
        "pair_evidence": on(_pair_evidence),
        "unlinked_candidates": on(lambda t: identity.unlinked(_gates(t), t.symbols, t.symbol_links, "2002-01-01")),
        "archive_holes": on(lambda t: identity.archive_holes(t.ingest_log, NSE, expected=_sessions(t))),
        "invariant_flatness": on(lambda t: identity.flatness(_tangled(t), PIN)),
        "invariant_overlap": on(lambda t: identity.overlaps(t.bars, t.symbols, _tangled(t), PIN)),
        "invariant_issuer": on(lambda t: identity.issuers(t.symbols, _tangled(t), PIN)),
        "invariant_violations": on(lambda t: identity.violations(t.bars, t.symbols, _tangled(t), PIN)),
        "isin_check_digit": on(lambda t: _isins(t).select("isin", scalars.well_formed_isin("isin").alias("well_formed"), scalars.isin_check_ok("isin").alias("check_ok"))),
        "issuer_prefix_serial": on(lambda t: _isins(t).select("isin", scalars.issuer_prefix("isin").alias("issuer"), scalars.issue_serial("isin").alias("serial"))),
        "ratio_band": on(lambda t: _ratios(t).select("ratio", scalars.ratio_band("ratio").alias("band"))),
        "simple_fraction": on(lambda t: _ratios(t).withColumn("_f", scalars.simple_fraction("ratio", 0.01)).select("ratio", "_f.num", "_f.den")),
        "slug_codes": on(lambda t: aliases.with_code(_names(t)).groupBy("index_name", "index_code").agg(F.count(F.lit(1)).alias("days"))),
        "month_windows": on(lambda t: _sessions(t).select("date", *[scalars.months_before("date", k).alias(f"back_{k}") for k in (1, 12)])),
        "pre_isin_bridge": on(lambda t: preisin.pre_isin_bridge(t.bars, t.symbols, NSE, PIN)),
        "pre_isin_resolution": on(_pre_isin),
        "close_on_day": on(lambda t: preisin.close_on(t.bars, t.symbols, NSE, AS_OF, PIN)),
        "rebalance_calendar": on(lambda t: signals.rebalance_calendar(_sessions(t), 3, 2)),
        "turnover_rank": on(lambda t: _ranked(t, "turnover"), "median_turnover"),
        "momentum_rank": on(lambda t: _ranked(t, "momentum"), "return"),
        "reversal_rank": on(lambda t: _ranked(t, "reversal"), "return"),
        "lowvol_rank": on(_low_volatility, "volatility"),
        "trend_stance": on(lambda t: signals.trend_stance(t.index_levels, "NIFTYX", _sessions(t), 200, PIN)),
        "tracking_stats": on(lambda t: indices.tracking(_curve(t).where("run = 'calm'").select("date", F.col("equity").alias("close")), _curve(t).where("run = 'wild'").select("date", F.col("equity").alias("close"))), "correlation", "mean_difference"),
        "drawdown": on(lambda t: report.drawdowns(_curve(t)).select("run", "date", "peak", "drawdown"), "peak", "drawdown"),
        "growth_report": on(lambda t: report.summary(_curve(t), t.bars.sparkSession.createDataFrame([("calm", 1000.0, 9e5), ("wild", 2000.0, 5e6)], "run string, costs double, traded double"), _bench(t), 1e6), "final", "net_growth", "gross_growth", "benchmark_growth", "excess", "max_drawdown", "cost_share", "turnover"),
        "by_year": on(lambda t: report.by_year(_curve(t), _bench(t), 1e6), "equity", "return", "benchmark"),
        "worst_days": on(lambda t: report.worst_days(_curve(t), 5), "change"),
        "round_trips": lambda spark, sf_dir: plain(_trips(spark, sf_dir), "basis", "proceeds", "return"),
        "trade_stats": lambda spark, sf_dir: plain(report.trade_stats(_trips(spark, sf_dir)), "mean", "deviation", "win_rate"),
        "snapshot_parts": on(_snapshot),
        "snapshot_digest": on(lambda t: provenance.table_digests(_snapshot(t))),
        "snapshot_lanes": on(lambda t: _lanes(t).select("source", "date", "rows", "digest")),
        "snapshot_years": on(lambda t: provenance.year_digests(_lanes(t))),
        "prior_runs": lambda spark, sf_dir: plain(provenance.prior_runs(_runs(spark, sf_dir), provenance.digest_of({"top": 1}))),
        "holdout_runs": lambda spark, sf_dir: plain(provenance.holdout_runs(_runs(spark, sf_dir), "1997-01-01")),
        "backtest_events": on(lambda t: _events(t, [0]).where("kind <> 'equity'"), "price", "charges", "amount", "cash"),
        "equity_curve": on(lambda t: _events(t, [0]).where("kind = 'equity'").select("run", "date", "amount", "cash", "held"), "amount", "cash"),
        "gate_decisions": on(lambda t: report.reasons(_events(t, [0], max_positions=5), "rejected")),
        "backtest_momentum": on(lambda t: _backtest_report(t, [0]), "final", "net_growth", "gross_growth", "benchmark_growth", "excess", "max_drawdown", "cost_share", "turnover"),
        "backtest_offset_sweep": on(lambda t: _backtest_report(t, list(range(21))), "final", "net_growth", "gross_growth", "benchmark_growth", "excess", "max_drawdown", "cost_share", "turnover"),
    }
