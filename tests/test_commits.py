"""Commits, closings and kept sessions: what readers see of a write, before, after and when it dies half-way."""

import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal, provenance
from tidemark.operators.checks import IntegrityError
from tidemark.plans import commits, ingest, storage

NSE = "nse-bhavcopy"


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), "isin string, date string, close double")
    p = F.col("close").cast("decimal(14,4)")
    return df.select("isin", F.col("isin").alias("ticker"), F.col("date").cast("date"), F.lit("EQ").alias("series"), *[p.alias(k) for k in ("open", "high", "low", "close")], F.lit(5).cast("bigint").alias("volume"))


def seen(spark, root, pin=None):
    rows = bitemporal.latest_version(ingest.read(spark, f"{root}/bars", "bars"), ["source", "symbol_id", "date"], pin)
    return sorted((r["symbol_id"], str(r["date"]), float(r["close"])) for r in rows.collect())


def ranked(spark, root, pin=None):
    """The same by ranking all versions."""
    rows = ingest.read(spark, f"{root}/bars", "bars").drop("superseded_at")
    return sorted((r["symbol_id"], str(r["date"]), float(r["close"])) for r in bitemporal.latest_version(rows, ["source", "symbol_id", "date"], pin).collect())


def filled(spark, root):
    ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", "2019-12-31", 1.0), ("INE1", "2020-01-01", 1.5), ("INE2", "2020-01-01", 2.0)), "2020-01-02")
    ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", "2020-01-01", 1.6), ("INE3", "2020-01-02", 3.0)), "2020-01-05")
    ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", "2020-01-01", 1.7)), "2020-01-09")


def test_a_read_at_any_pin_is_a_filter_and_equals_ranking(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root)
    pins = (None, "2020-01-01", "2020-01-02", "2020-01-05", "2020-01-08", "2020-01-09")
    want = {pin: ranked(spark, root, pin) for pin in pins}
    assert want["2020-01-05"] == [(1, "2019-12-31", 1.0), (1, "2020-01-01", 1.6), (2, "2020-01-01", 2.0), (3, "2020-01-02", 3.0)]
    assert {pin: seen(spark, root, pin) for pin in pins} == want
    assert ingest.fold(spark, root) == 1  # one source and year
    assert {pin: seen(spark, root, pin) for pin in pins} == want
    _, held = commits.state(spark, root)
    assert not held["closings"] and ingest.fold(spark, root) == 0
    plan = bitemporal.latest_version(ingest.read(spark, f"{root}/bars", "bars"), ["source", "symbol_id", "date"], "2020-01-05")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan
    ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", "2020-01-01", 1.8)), "2020-02-01")
    assert seen(spark, root) == ranked(spark, root) and seen(spark, root, "2020-01-09") == want["2020-01-09"]


def test_validity_of_a_bulk_load_equals_ranking(spark, tmp_path):
    rows = spark.createDataFrame([(1, "d1", "2020-01-01"), (1, "d1", "2020-03-01"), (1, "d2", "2020-01-01")], "symbol_id bigint, date string, ingested_at string")
    rows = storage.with_validity(rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")), ["symbol_id", "date"])
    for pin in (None, "2020-01-01", "2020-02-01", "2020-03-01"):
        a, b = (sorted(map(tuple, bitemporal.latest_version(x, ["symbol_id", "date"], pin).collect())) for x in (rows, rows.drop("superseded_at")))
        assert a == b


def test_a_writer_that_dies_between_tables_leaves_the_state_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    filled(spark, root)
    before, symbols = seen(spark, root), ingest.read(spark, f"{root}/symbols", "symbols").count()
    append = commits.Commit.append

    def dies(self, table, rows):
        if table == "bars":
            raise OSError("the driver is gone")
        return append(self, table, rows)

    monkeypatch.setattr(commits.Commit, "append", dies)
    with pytest.raises(OSError):
        ingest.insert_bars(spark, root, NSE, batch(spark, ("INE9", "2020-01-03", 9.0)), "2020-01-20")
    monkeypatch.undo()
    assert len(list((tmp_path / "s" / "symbols").iterdir())) > 1  # its symbols are there, but no commit names them
    assert (seen(spark, root), ingest.read(spark, f"{root}/symbols", "symbols").count()) == (before, symbols)
    assert ingest.insert_bars(spark, root, NSE, batch(spark, ("INE9", "2020-01-03", 9.0)), "2020-01-20") == 1
    assert seen(spark, root)[-1] == (4, "2020-01-03", 9.0)


def test_two_writers_of_one_commit_number(spark, tmp_path):
    root = str(tmp_path / "s")
    one, two = commits.Commit(spark, root), commits.Commit(spark, root)
    rows = spark.createDataFrame([("n", 1)], "source string, k int").select("source", F.lit("2020-01-01").cast("date").alias("date"), F.lit("2020-01-01").cast("timestamp").alias("ingested_at"))
    one.append("sessions", rows)
    two.append("sessions", rows)
    assert one.publish() == 1
    with pytest.raises(commits.Conflict):
        two.publish()
    assert ingest.read(spark, f"{root}/sessions", "sessions").count() == 1


def test_a_lease_ends(spark, tmp_path):
    (tmp_path / "_writer").write_text(json.dumps({"owner": "dead", "until": time.time() - 1}))
    with commits.lease(spark, str(tmp_path)):
        assert json.loads((tmp_path / "_writer").read_text())["owner"] != "dead"
    (tmp_path / "_writer").write_text(json.dumps({"owner": "alive", "until": time.time() + 60}))
    with pytest.raises(RuntimeError), commits.lease(spark, str(tmp_path)):
        pass
    assert (tmp_path / "_writer").exists()


def test_states_bound_the_entries_that_readers_open(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "STATES", 2)
    root, opened = str(tmp_path / "s"), []
    for day in range(1, 6):
        ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", f"2020-01-0{day}", float(day))), f"2020-02-0{day}")
    load = commits._load
    monkeypatch.setattr(commits, "_load", lambda spark, path: opened.append(path) or load(spark, path))
    number, held = commits.state(spark, root)
    assert number == 5 and len(held["bars"]) == 5 and len(opened) == 2


def test_an_insert_reads_only_its_own_years(spark, tmp_path):
    root = str(tmp_path / "s")
    for year in range(2000, 2006):
        ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", f"{year}-01-03", 1.0), ("INE2", f"{year}-06-03", 1.0)), f"{year}-07-01")
    day = batch(spark, ("INE1", "2005-01-03", 2.0))
    beside = ingest.stored_beside(commits.Commit(spark, root), day, NSE)
    assert {f.split("year=")[1][:4] for f in beside._jdf.queryExecution().executedPlan().toString().split() if "year=" in f} <= {"2005"}
    files = beside.select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "year=2005" in files[0][0]
    assert ingest.insert_bars(spark, root, NSE, day, "2006-01-01") == 1


def test_older_batches_may_not_change_what_came_later(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root)
    with pytest.raises(IntegrityError, match="older"):
        ingest.insert_bars(spark, root, NSE, batch(spark, ("INE1", "2020-01-01", 9.0)), "2020-01-07")
    assert not (tmp_path / "s" / "_writer").exists()


def test_kept_sessions_equal_distinct_dates_at_any_pin(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root)
    bars, kept = ingest.read(spark, f"{root}/bars", "bars"), ingest.read(spark, f"{root}/sessions", "sessions")
    assert kept.count() == 3
    for pin in (None, "2020-01-01", "2020-01-02", "2020-01-05"):
        a, b = (sorted(map(tuple, bitemporal.sessions(x, NSE, None, None, pin).collect())) for x in (bars, kept))
        assert a == b


def test_ids_follow_the_order_of_isins_over_groups(spark):
    names = [f"INE{i:03d}A0101{i % 10}" for i in range(0, 300, 7)]
    rows = spark.createDataFrame([(n, n, "2020-01-01") for n in reversed(names)], "isin string, ticker string, date string").withColumn("date", F.col("date").cast("date"))
    empty = ingest.new_symbols(rows, spark.createDataFrame([], "symbol_id bigint, isin string, ticker string, ingested_at timestamp, valid_from date"), "2020-01-02")
    assert [(r["symbol_id"], r["isin"]) for r in empty.orderBy("symbol_id").collect()] == list(enumerate(names, 1))


def test_kept_digests_equal_those_from_scratch_at_any_pin(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root)
    bars, kept = ingest.read(spark, f"{root}/bars", "bars"), ingest.read(spark, f"{root}/digests", "digests")
    rows = lambda df: sorted(map(tuple, df.collect()))
    old = None
    for pin in (None, "2020-01-01", "2020-01-02", "2020-01-05", "2020-01-09"):
        scratch = rows(provenance.lane_parts(bars, pin))
        assert rows(provenance.kept_parts(kept, pin)) == scratch
        assert pin != "2020-01-01" or scratch == []
        old = scratch if pin == "2020-01-05" else old
    assert rows(provenance.kept_parts(kept, None)) != old
    assert kept.where("ingested_at = '2020-01-09'").count() == 1  # one part touched
    before, after = provenance.kept_parts(kept, "2020-01-02"), provenance.kept_parts(kept, "2020-01-05")
    assert rows(provenance.differing_parts(before, after).select("date")) == [(date(2020, 1, 1),), (date(2020, 1, 2),)]
    assert provenance.differing_parts(after, after).isEmpty()


def test_part_digests_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([(NSE, date(2020, 1, 1), f"{i:064x}"[::-1]) for i in range(50)], "source string, date date, content_hash string")
    one, other = (provenance.lane_digest(provenance.lane_sums(x)).collect() for x in (rows, rows.orderBy(F.rand(3)).repartition(5)))
    assert one == other
    assert provenance.lane_digest(provenance.lane_sums(rows.limit(49))).collect() != one
