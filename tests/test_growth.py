"""That what is moved and what one task takes grow no faster than the tables."""

import random
import statistics
from datetime import date
from pathlib import Path

import pyarrow as pa
import pytest
from market import bars, links, symbols, weekdays
from pyspark.sql import functions as F

from tidemark.operators import identity, preisin, returns, signals
from tidemark.plans import storage

PIN = "2030-01-01"


@pytest.fixture
def small_parts(spark):
    """What counts as a large partition is small here."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    yield
    spark.conf.set(key, before)


def test_a_year_of_a_source_is_no_single_task(spark, tmp_path, small_parts):
    rows = spark.range(0, 20000, 1, 8).select((F.col("id") % 5000).alias("symbol_id"), F.date_add(F.lit("2021-03-01").cast("date"), (F.col("id") % 7).cast("int")).alias("date"), F.lit("eod2").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    storage.write_bars(rows, str(tmp_path / "bars"))
    assert len(list(Path(tmp_path / "bars/source=eod2/year=2021").glob("*.parquet"))) > 4
    assert storage.read_bars(spark, str(tmp_path / "bars")).count() == 20000


def test_an_end_meets_one_close_of_an_entity(spark):
    days = weekdays("2021-01-04", 60)
    b = bars(spark, [(s, d, 10.0 * s + i) for s in (1, 2, 3) for i, d in enumerate(days) if not (s == 3 and i % 9)])
    s = symbols(spark, [(i, f"INE00{i}A01010", f"T{i}", "2000-01-01", "0001-01-01") for i in (1, 2, 3)])
    windows = [(days[i], days[i + 20]) for i in range(0, 40)]
    seen = returns._ends_seen(b, s, links(spark, [(2, 1, "manual", "2021-01-04", 1, "2000-01-01")]), "nse-bhavcopy", windows, PIN, 8)
    got = {(r["window"], r["entity_id"], r["side"]): (r["symbol_id"], str(r["date"])) for r in seen.collect()}
    assert seen.count() == len(got)
    want = {}
    for w, ends in enumerate(windows):
        for side, end in zip("ft", ends, strict=True):
            want[(w, 1, side)] = (1, end)  # of two members on one day the first
            if late := [d for i, d in enumerate(days) if not i % 9 and d <= end and (date.fromisoformat(end) - date.fromisoformat(d)).days < 8]:
                want[(w, 3, side)] = (3, late[-1])
    assert got == want


def test_windows_of_all_days_are_looked_at_in_one_row():
    dice = random.Random(7)
    ends = [(date(2021, 1, n), n) for n in (3, 9, 10, 20)]
    often = lambda e: dice.choice([1, 1, 1, 2, e % 2])
    hist = {e: [(n, dice.choice([None, round(dice.random() * 50, 2)])) for n in range(1, 21) for _ in range(often(e))] for e in range(12)}
    batch = pa.RecordBatch.from_arrays([pa.array(list(hist)), pa.array([[n for n, _ in h] for h in hist.values()], pa.list_(pa.int32())), pa.array([[t for _, t in h] for h in hist.values()], pa.list_(pa.float64()))], ["entity_id", "n", "turnover"])
    got = {(r["as_of"], r["entity_id"]): r["median_turnover"] for out in signals._present([batch.slice(2), batch.slice(0, 2)], ends, 8) for r in out.to_pylist()}
    want = {}
    for d, end in ends:
        lo = max(1, end - 7)
        for e, h in hist.items():
            inside = [(n, t) for n, t in h if lo <= n <= end]
            if any(n == end for n, _ in inside) and len({n for n, _ in inside}) * 10 >= (end - lo + 1) * 8:
                known = [t for _, t in inside if t is not None]
                want[(d, e)] = statistics.median(known) if known else None
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)


def test_renames_are_counted_and_not_paired(spark):
    """Many tickers of one price end and begin on the same days: 9 million pairs before, a few rows for each ticker now."""
    days = spark.createDataFrame([(date.fromisoformat(d),) for d in weekdays("2011-01-03", 30)], "date date")
    many = spark.range(3000).select(F.concat(F.lit("V"), "id").alias("ticker"), F.lit("2011-01-10").cast("date").alias("day"), F.lit(100.0).alias("close"))
    lone = spark.createDataFrame([("OLD", date(2011, 1, 12), 7.0)], "ticker string, day date, close double")
    gone = many.unionByName(lone).toDF("ticker", "last_date", "last_close")
    come = many.union(lone).select(F.concat(F.lit("N"), "ticker").alias("ticker"), F.col("ticker").alias("isin"), F.date_add("day", 1).alias("first_date"), F.col("close").alias("first_close"))
    found = preisin.match_renames(gone, come, days)
    assert [tuple(r)[:3] for r in found.collect()] == [("OLD", "NOLD", "OLD")]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert "place" in joins[0]  # by the place that the count gives, not by cells of price that hold many


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_counted_renames_are_the_pairs_of_the_rule(spark, seed):
    dice, days = random.Random(seed), weekdays("2011-01-03", 30)
    price = lambda: dice.choice([100.0, 115.0, 85.0, 114.99999999999999, round(10 ** dice.uniform(0, 4), 2)])
    gone = [(f"V{i}", dice.randrange(20), price()) for i in range(60)]
    come = [(f"W{i}", dice.randrange(25), price()) for i in range(60)]
    pairs = [(v, w) for v, a, x in gone for w, b, y in come if 0 <= b - a <= 5 and abs(y / x - 1.0) <= 0.15]
    want = sorted(p for p in pairs if sum(q[0] == p[0] for q in pairs) == 1 and sum(q[1] == p[1] for q in pairs) == 1)
    got = preisin.match_renames(
        spark.createDataFrame([(t, date.fromisoformat(days[i]), c) for t, i, c in gone], "ticker string, last_date date, last_close double"),
        spark.createDataFrame([(t, f"I{t}", date.fromisoformat(days[i]), c) for t, i, c in come], "ticker string, isin string, first_date date, first_close double"),
        spark.createDataFrame([(date.fromisoformat(d),) for d in days], "date date"),
    )
    assert sorted((r["ticker"], r["newcomer"]) for r in got.collect()) == want and want


@pytest.mark.parametrize("validity", [False, True])
def test_more_bars_are_counted_by_more_tasks(spark, monkeypatch, validity):
    """Overlaps against brute force, with versions before and after the pin; a task's share stays as it is when bars are more."""
    monkeypatch.setattr(identity, "BARS_OF_A_TASK", 100, raising=False)
    rng, days = random.Random(7), weekdays("2021-01-04", 40)
    rows = [(s, d, 10.0) for s in range(1, 41) for d in days if rng.random() < 0.5]
    late = [(s, d, 11.0, at, "EQ") for s, d, _ in rows[::3] for at in (f"{d} 21:00:00", "2031-01-01 00:00:00")]
    first_late = [(s, "2021-06-01", 12.0, "2031-01-01 00:00:00", "EQ") for s in range(1, 41)]
    parts = {"nse-bhavcopy": rows + late + first_late, "eod2": rows[::2]}
    b = bars(spark, parts["nse-bhavcopy"]).unionByName(bars(spark, parts["eod2"], "eod2"))
    if validity:
        b = storage.with_validity(b, ["source", "symbol_id", "date"])
    s = symbols(spark, [(i, f"INE00{i:02d}01010", f"T{i}", "2000-01-01", "0001-01-01") for i in range(1, 41)])
    entity = {i: i - i % 4 if i % 4 and i > 8 else i for i in range(1, 41)}
    made = links(spark, [(i, e, "manual", None, e, "2000-01-01") for i, e in entity.items() if i != e])
    traded = {}
    for source, all_rows in parts.items():
        for i, d, *_ in all_rows:
            if d != "2021-06-01":
                traded.setdefault((entity[i], source, d), set()).add(i)
    found = identity.overlap_days(b, s, made, PIN)
    assert {(r["entity_id"], r["source"], str(r["date"])): r["members"] for r in found.collect()} == {k: len(v) for k, v in traded.items() if len(v) > 1}
    assert found.rdd.getNumPartitions() >= (len(parts["nse-bhavcopy"]) + len(parts["eod2"])) // 100
    assert sum(r["days"] for r in identity.overlaps(b, s, made, PIN).collect()) == found.count()
