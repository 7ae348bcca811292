"""Reports and index reads on values that stop a division, and folds over many fills."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indices, report

START = date(2020, 1, 1)


def closes(spark, values):
    return spark.createDataFrame([(START + timedelta(days=i), float(v)) for i, v in enumerate(values)], "date date, close double")


def test_a_level_of_zero_before_a_rename_is_unverifiable(spark):
    rows = [("X", "2020-01-01", "Old", 0.0), ("X", "2020-01-02", "New", 5.0), ("X", "2020-01-03", "Newer", 5.1)]
    levels = spark.createDataFrame(rows, "index_code string, date string, index_name string, close double").select(
        "index_code", F.col("date").cast("date"), F.lit("n").alias("source"), F.lit("2020-02-01").cast("timestamp").alias("ingested_at"), "index_name", F.col("close").cast("decimal(14,4)")
    )
    got = {r["index_name"]: (r["verdict"], r["jump"]) for r in indices.name_changes(levels, None).collect()}
    assert got["New"] == ("UNVERIFIABLE", None) and got["Newer"][0] == "CONTINUOUS"


def test_tracking_leaves_out_excluded_days_and_returns_from_zero(spark):
    a = closes(spark, [10, 0, 10, 11, 12.1, 13.31])
    b = closes(spark, [10, 1, 10, 11, 20, 22])
    got = indices.tracking(a, b, wild=5.0).first()
    assert got["pairs"] == 4  # not from the close of 0
    out = spark.createDataFrame([(START + timedelta(days=4),)], "date date")
    got = indices.tracking(a, b, wild=5.0, excluded=out).first()
    assert got["pairs"] == 3 and str(got["worst_day"]) == "2020-01-02"
    assert got["mean_difference"] == pytest.approx(0.9 - 0.0 and (abs(-1.0 + 0.9) + 0.0 + 0.0) / 3)


def test_tracking_needs_thirty_sessions(spark):
    level = [100 * 1.01 ** (i % 7) for i in range(40)]
    few, many = (indices.tracking_verdict(indices.tracking(closes(spark, level[:n]), closes(spark, [2 * x for x in level[:n]]))).first() for n in (30, 31))
    assert (few["pairs"], few["verdict"]) == (29, "UNVERIFIABLE") and (many["pairs"], many["verdict"]) == (30, "TRACKS")
    apart = indices.tracking_verdict(indices.tracking(closes(spark, level), closes(spark, [x * (1 + 0.05 * (i % 3)) for i, x in enumerate(level)]))).first()
    assert apart["verdict"] == "DIVERGES"


def test_years_and_days_after_an_equity_of_zero(spark):
    curve = spark.createDataFrame([("r", date(2020, 12, 31), 0.0), ("r", date(2021, 6, 1), 5.0), ("r", date(2021, 12, 31), 4.0)], "run string, date date, equity double")
    years = {r["year"]: (r["return"], r["benchmark"]) for r in report.by_year(curve, closes(spark, [0.0, 1.0]), 10.0).collect()}
    assert years[2020] == (-1.0, None) and years[2021][0] is None
    assert [(str(r["date"]), round(r["change"], 6)) for r in report.worst_days(curve, 3).collect()] == [("2021-12-31", -0.2)]


def plain(fills):
    held, out = {}, []
    for run, entity, seq, day, side, n, value, costs in sorted(fills, key=lambda f: (f[0], f[1], f[2], f[4])):
        q, b = held.get((run, entity), (0.0, 0.0))
        if side == "buy":
            q, b = q + n, b + value + costs
        elif q >= n and q:
            sold = b * n / q
            q, b = q - n, b - sold
            if sold > 0:
                out.append((run, entity, seq, sold, value - costs))
        held[run, entity] = (q, b)
    return sorted(out)


@pytest.mark.parametrize("records", [10_000, 7])
def test_fills_fold_alike_whatever_the_batches(spark, records):
    fills = []
    for k in range(600):
        entity = 0 if k % 3 else k % 5  # one entity has most of the rows
        side = "sell" if k % 4 == 3 or k % 11 == 0 else "buy"
        fills.append(("a" if k % 2 else "b", entity, k, START + timedelta(days=k), side, 1 + k * 7 % 23, 100.0 + k, 1.0 + k % 3))
    df = spark.createDataFrame(fills, "run string, entity_id bigint, seq int, date date, side string, qty bigint, value double, costs double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = sorted((r["run"], r["entity_id"], r["seq"], r["basis"], r["proceeds"]) for r in report.round_trips(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(fills) and len(got) > 100
