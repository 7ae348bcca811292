import pandas as pd
import pytest

from tidemark.operators import backtest, costs, report

NOTE = ("t", "angelone", "fund", "buy", "2026-09-07", 98, 272.29)
TRADE = "trade_id string, broker string, product string, side string, date string, qty bigint, price double"


def priced(spark, *rows):
    from pyspark.sql import functions as F

    return costs.trade_charges(spark.createDataFrame(list(rows), TRADE).withColumn("date", F.col("date").cast("date"))).orderBy("trade_id").collect()


def test_contract_note(spark):
    (r,) = priced(spark, NOTE)
    got = (r["turnover"], r["brokerage"], r["exchange"], r["sebi"], r["ipf"], r["taxable"], r["gst"], r["stamp"], r["stt"])
    assert got == (26684.42, 20.0, 0.82, 0.03, 0.0, 20.85, 3.75, 4.0, 0.0) and r["verified"]


def test_fold_prices_as_the_table_does(spark):
    rows = [(f"{b}{s}{p}{q}", b, "equity", s, d, q, float(p)) for b in costs.BROKERS for s in ("buy", "sell") for p in (17.35, 999.9) for q in (3, 250) for d in ("2015-03-02", "2026-09-08")]
    rows = [(f"{i:03d}", *r[1:]) for i, r in enumerate(rows)]
    for r, x in zip(priced(spark, *rows), rows, strict=True):
        assert r["total"] == pytest.approx(backtest.charge(x[5], x[6], x[3], x[1], x[4]), abs=1e-9)


def test_smallest_orders(spark):
    got = {r["broker"]: r["min_notional"] for r in costs.min_notional(costs.round_trips(spark, highest=40_000)).collect()}
    assert got == {"zerodha": 5600, "angelone": 25600}


def test_depository_charge_is_per_scrip_and_day(spark):
    from pyspark.sql import functions as F

    rows = [(f"t{i}", "zerodha", "equity", "sell", "2024-05-06", 10, 100.0, "acc", s) for i, s in enumerate((7, 7, 7))]
    df = spark.createDataFrame(rows, TRADE + ", account string, scrip bigint").withColumn("date", F.col("date").cast("date"))
    assert costs.day_charges(df).first()["dp"] == 15.34


def session(day, rows, stance="risk on", rebalance=False):
    cols = ["date", "entity_id", "open", "close", "ratio", "rank", "stance", "rebalance"]
    return pd.DataFrame([(pd.Timestamp(day), e, o, c, r, k, stance, rebalance) for e, o, c, r, k in rows], columns=cols)


def walk(*sessions, **kw):
    s = backtest.Setup(**({"capital": 100_000.0, "top": 1, "floor": 100.0, "max_stock": 1.0} | kw))
    return backtest.walk("r", pd.concat(sessions), s)


def test_orders_fill_at_the_next_open_and_the_last_never():
    out = walk(session("2024-01-01", [(5, 98.0, 100.0, None, 1)], rebalance=True), session("2024-01-02", [(5, 150.0, 160.0, None, 1)], rebalance=True), cash_buffer=0.5)
    (fill,) = out[out.kind == "fill"].to_dict("records")
    assert (str(fill["date"])[:10], fill["price"], fill["qty"]) == ("2024-01-02", 150.0, 500)


def test_orders_beyond_the_cash_do_not_fill():
    out = walk(session("2024-01-01", [(5, 98.0, 100.0, None, 1)], rebalance=True), session("2024-01-02", [(5, 150.0, 160.0, None, 1)]))
    assert out[out.kind == "unfilled"].detail.tolist() == ["insufficient cash"]


def test_halted_name_keeps_its_mark():
    days = [session("2024-01-01", [(5, 100.0, 100.0, None, 1)], rebalance=True), session("2024-01-02", [(5, 100.0, 120.0, None, None)]), session("2024-01-03", [(6, 1.0, 1.0, None, None)]), session("2024-01-04", [(5, 130.0, 130.0, None, None)])]
    eq = walk(*days, cash_buffer=0.05).query("kind == 'equity'").amount.tolist()
    assert eq[2] == eq[1] and eq[3] > eq[2]


def test_flat_round_trip_costs_what_was_charged():
    days = [session("2024-01-01", [(5, 100.0, 100.0, None, 1)], rebalance=True), session("2024-01-02", [(5, 100.0, 100.0, None, None)]), session("2024-01-03", [(5, 100.0, 100.0, None, None)], "risk off"), session("2024-01-04", [(5, 100.0, 100.0, None, None)], "unknown")]
    out = walk(*days, cash_buffer=0.05)
    fills = out[out.kind == "fill"]
    assert fills.side.tolist() == ["buy", "sell"]
    assert 100_000 - out[out.kind == "equity"].cash.iloc[-1] == pytest.approx(fills.charges.sum())


def test_split_scales_held_and_pending_and_is_no_drop():
    days = [session("2024-01-01", [(5, 100.0, 100.0, None, 1)], rebalance=True), session("2024-01-02", [(5, 50.0, 50.0, 2.0, None)]), session("2024-01-03", [(5, 25.0, 25.0, 2.0, None)]), session("2024-01-04", [(5, 10.0, 10.0, None, None)])]
    out = walk(*days, cash_buffer=0.05)
    fill = out[out.kind == "fill"].iloc[0]
    assert fill.qty == 950 * 2 and out[out.kind == "action"].qty.tolist() == [1900]
    assert out[out.kind == "drop"].date.astype(str).str[:10].tolist() == ["2024-01-04"]


def test_gate_order():
    s = backtest.Setup(floor=1000.0, max_positions=1, max_stock=0.5)
    got = [r for _, r in backtest.gate([(1, "buy", 10, 50.0), (1, "buy", 10, 400.0), (2, "buy", 10, 400.0), (1, "buy", 10, 400.0), (1, "sell", 100, 400.0), (2, "buy", 10, 400.0), (3, "buy", 0, 1.0)], {}, 10_000.0, s)]
    assert got == ["below the floor", "", "too many positions", "too much of one name", "", "", "malformed"]
    assert [r for _, r in backtest.gate([(1, "sell", 1, 1.0)], {}, 1.0, backtest.Setup(kill="stop"))] == ["kill switch"]


def test_round_trips_against_a_plain_fold(spark):
    rows = [("r", 1, 1, "2024-01-01", "buy", 10, 1000.0, 5.0), ("r", 1, 2, "2024-01-02", "sell", 4, 480.0, 2.0), ("r", 1, 3, "2024-01-03", "sell", 9, 1.0, 1.0), ("r", 1, 4, "2024-01-04", "sell", 6, 500.0, 2.0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "run string, entity_id bigint, seq int, date string, side string, qty bigint, value double, costs double").withColumn("date", F.col("date").cast("date"))
    got = [(r["seq"], round(r["basis"], 6), r["proceeds"]) for r in report.round_trips(df).orderBy("seq").collect()]
    assert got == [(2, 402.0, 478.0), (4, 603.0, 498.0)]


def test_rupees():
    assert [report.rupees(x) for x in (0, 999.5, 123456.789, -12345678.9)] == ["0.00", "999.50", "1,23,456.79", "-1,23,45,678.90"]


def test_floor_is_what_charges_make_it():
    assert backtest.smallest_order("zerodha") == 5600.0 and backtest.smallest_order("angelone") == 25_600.0


def test_sales_make_room_in_the_book_and_ids_begin_at_one():
    s = backtest.Setup(floor=1.0, max_book=100.0, max_stock=10.0)
    got = backtest.gate([(1, "sell", 10, 50.0), (2, "buy", 1, 90.0), (0, "buy", 1, 5.0)], {1: 80.0}, 100.0, s)
    assert [r for _, r in got] == ["", "", "malformed"]
    assert [r for _, r in backtest.gate([(2, "buy", 1, 30.0)], {1: 80.0}, 100.0, s)] == ["book too large"]


def test_the_sheet_has_what_rate_at_finds(spark):
    from pyspark.sql import functions as F

    days = ["1989-12-31", "1990-01-01", "2017-06-30", "2017-07-01", "2020-06-30", "2020-07-01", "2026-09-06", "2026-09-07", None]
    kinds = [(b, p, s, d) for b in ("zerodha", "angelone", "other", None) for p in ("equity", "fund", "bond", None) for s in ("buy", "sell", "short", None) for d in days]
    rows = spark.createDataFrame(kinds, "broker string, product string, side string, date string").withColumn("date", F.col("date").cast("date"))
    for components in (costs.COMPONENTS, ("dp",), ("ipf",)):
        found = costs.with_terms(rows, components)
        assert found.count() == len(kinds)
        for c in components:
            assert found.where(~F.col(f"_{c}").eqNullSafe(costs.term(costs.rate_at(c)))).count() == 0


def test_terms_charge_by_their_basis(spark):
    rates = [("x", None, None, None, "1990-01-01", basis, 0.5, 20.0, 5.0, True) for basis in ("flat", "zero", "percent", "capped")]
    for rate, expected in zip(rates, ([0.5, 0.5, 0.5, 0.5], [0.0, 0.0, 0.0, 0.0], [1.0, 15.0, 50.0, None], [5.0, 15.0, 20.0, 20.0]), strict=True):
        rows = spark.createDataFrame([(1, 2.0), (2, 30.0), (3, 100.0), (4, None)], "i int, base double").selectExpr("*", "date'2020-01-01' AS date", "'a' AS broker", "'b' AS product", "'c' AS side")
        rows = costs.with_terms(rows, ("x",), [rate])
        assert [r[0] for r in rows.orderBy("i").select(costs.rupees(rows["base"], rows["_x"])).collect()] == expected


def test_a_trade_without_a_rate_is_an_error(spark):
    with pytest.raises(Exception, match="no rate for zerodha equity buy 1989-12-31"):
        priced(spark, ("t", "zerodha", "equity", "buy", "1989-12-31", 1, 1.0))


def test_round_trips_make_no_method_that_the_jvm_leaves_uncompiled(spark, sf, capsys):
    import re

    import __spark_entry__ as entry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        entry.queries()["round_trips"](spark, sf).explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_holdings_go_on_from_batch_to_batch():
    import datetime

    import pyarrow as pa

    rows = [("r", 1, 1, "buy", 10.0, 1000.0, 5.0), ("r", 1, 2, "sell", 4.0, 480.0, 2.0), ("r", 1, 4, "sell", 6.0, 500.0, 2.0), ("s", 1, 1, "sell", 1.0, 1.0, 1.0), (None, None, 1, "buy", 1.0, 7.0, 0.0), (None, None, 2, "sell", 1.0, 9.0, 0.0), (None, None, 3, None, None, None, None)]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("run", "entity_id", "seq", "side", "qty", "value", "costs"))}).append_column("date", pa.array([datetime.date(2024, 1, 1)] * 7))
    expected = [("r", 1, 2, 402.0, 478.0), ("r", 1, 4, 603.0, 498.0), (None, None, 2, 7.0, 9.0)]
    for size in (1, 2, 6):
        got = pa.Table.from_batches(list(report._fold(table.slice(0, 6).to_batches(size)))).to_pylist()
        assert [(r["run"], r["entity_id"], r["seq"], r["basis"], r["proceeds"]) for r in got] == expected
    with pytest.raises(TypeError):
        list(report._fold(table.to_batches()))
