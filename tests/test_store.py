import hashlib
from datetime import date, datetime, timezone

import pytest
from market import links
from pyspark.sql import functions as F

from tidemark.operators import provenance
from tidemark.operators import roster as identity
from tidemark.operators.checks import IntegrityError
from tidemark.plans import ingest
from tidemark.sources import addresses, archives
from tidemark.streaming.arrival import ingest_arrived

LEGACY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"
ROW = "AAA,EQ,10,11,9,10.5,10.5,10,1000,10500.5,13-JUL-2020,12,INE001A01010,"


def write(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_three_eras_of_files(spark, tmp_path):
    old = write(tmp_path, "old.csv", "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,", "BBB,EQ,1,1,1,1,1,1,5,5,3-NOV-1994,", "CCC,N1,1,1,1,1,1,1,5,5,3-NOV-1994,")
    new = write(tmp_path, "new.csv", "TradDt,TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal", "2024-07-08,AAA,BE,INE001A01010,1,1,1,2,3,4")
    legacy = write(tmp_path, "leg.csv", LEGACY, ROW)
    got = [tuple(map(str, archives.equity_bars(spark, p).select("date", "ticker", "isin", "close", "volume").first())) for p in (old, legacy, new)]
    assert got == [("1994-11-03", "BBB", "None", "1.0000", "5"), ("2020-07-13", "AAA", "INE001A01010", "10.5000", "1000"), ("2024-07-08", "AAA", "INE001A01010", "2.0000", "3")]
    assert archives.equity_bars(spark, old).count() == 1


@pytest.mark.parametrize("row", ["AAA,EQ,x,11,9,10.5,10.5,10,1000,10500.5,13-JUL-2020,12,INE001A01010,", "AAA,EQ,10,11,9,10.5,10.5,10,1000,1,13-JUL-2020,12,,", "AAA,EQ,10,11,9,NaN,10.5,10,1000,1,13-JUL-2020,12,INE001A01010,", "AAA,EQ,10,11,9,10,10.5,10,1000,1,nonsense,12,INE001A01010,"])
def test_malformed_rows_are_errors(spark, tmp_path, row):
    with pytest.raises(IntegrityError):
        archives.equity_bars(spark, write(tmp_path, "bad.csv", LEGACY, row))
    with pytest.raises(IntegrityError):
        archives.equity_bars(spark, write(tmp_path, "twice.csv", LEGACY, ROW, ROW.replace("AAA", "AAB")))


def test_index_file(spark, tmp_path):
    head = ",".join(archives.INDEX_COLUMNS)
    p = write(tmp_path, "i.csv", head, 'Nifty 50,04-07-2012,1,2,0.5,"5,302.5",-,1.2,100,-,18,3,1', "Twice,04-07-2012,1,1,1,1,1,1,1,1,1,1,1", "Twice,04-07-2012,1,1,1,2,1,1,1,1,1,1,1")
    rows, twice = archives.index_rows(spark, p, "2012-07-04")
    assert [(r["index_name"], r["close"], r["points_change"]) for r in rows.collect()] == [("Nifty 50", 5302.5, None)] and [r[0] for r in twice.collect()] == ["Twice"]
    with pytest.raises(IntegrityError):
        archives.index_rows(spark, p, "2012-08-04")


def test_adjusted_folder_and_symbol_map(spark, tmp_path):
    folder = tmp_path / "daily"
    folder.mkdir()
    write(folder, "aaa.csv", "Date,Open,High,Low,Close,Volume,DLV_QTY", "2020-01-01,1,2,1,1.5,10,4")
    write(folder, "ZZZ.CSV", "Date,Open,High,Low,Close,Volume,DLV_QTY", "2020-01-01,1,2,1,1.5,10,")
    m = archives.symbol_map(spark, write(tmp_path, "map.json", '{"sym2isin": {"AAA": "INE001A01010"}}'))
    rows, unmapped = archives.daily_bars(spark, str(folder), m)
    assert [(r["ticker"], r["delivery_qty"]) for r in rows.collect()] == [("AAA", 4)] and [r[0] for r in unmapped.collect()] == ["ZZZ"]


def batch(spark, rows):
    df = spark.createDataFrame(rows, "isin string, ticker string, date string, close double")
    p = F.col("close").cast("decimal(14,4)")
    return df.select("isin", "ticker", F.col("date").cast("date"), F.lit("EQ").alias("series"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(5).cast("bigint").alias("volume"))


def test_appending_twice_adds_nothing_and_corrections_are_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    first = batch(spark, [("INE1", "A", "2020-01-01", 1.0), ("INE2", "B", "2020-01-01", 2.0), ("INE2", "B", "2020-01-01", 2.0)])
    assert ingest.insert_bars(spark, root, "nse-bhavcopy", first, "2020-01-02") == 2
    assert ingest.insert_bars(spark, root, "nse-bhavcopy", first, "2020-01-03") == 0
    assert ingest.insert_bars(spark, root, "nse-bhavcopy", batch(spark, [("INE1", "A2", "2020-01-02", 1.0), ("INE2", "B", "2020-01-01", 2.5)]), "2020-01-04") == 2
    assert spark.read.parquet(f"{root}/bars").count() == 4
    s = sorted((r["symbol_id"], r["ticker"]) for r in spark.read.parquet(f"{root}/symbols").collect())
    assert s == [(1, "A"), (1, "A2"), (2, "B")]
    with pytest.raises(IntegrityError):
        ingest.insert_bars(spark, root, "nse-bhavcopy", batch(spark, [("INE1", "A", "2020-02-01", 1.0), ("INE1", "A", "2020-02-01", 3.0)]), "2020-03-01")


def test_arrival_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: sum(ingest_arrived(spark, str(inbox), LEGACY.split(","), "legacy", "nse-bhavcopy", str(tmp_path / "s"), str(tmp_path / "c"), lambda i: "2020-08-01"))
    write(inbox, "a.csv", LEGACY, ROW)
    assert run() == 1 and run() == 0
    write(inbox, "b.csv", LEGACY, ROW.replace("13-JUL", "14-JUL"))
    assert run() == 1


def test_arrival_refuses_what_a_batch_read_refuses(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox, "a.csv", LEGACY, ROW.replace("13-JUL", "13-XXX"))
    with pytest.raises(Exception, match="malformed rows"):
        ingest_arrived(spark, str(inbox), LEGACY.split(","), "legacy", "nse-bhavcopy", str(tmp_path / "s"), str(tmp_path / "c"), lambda i: "2020-08-01")


def test_arrival_of_the_layout_without_isin(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    header = ",".join(archives.LAYOUTS["preisin"][0])
    write(inbox, "a.csv", header, "03-NOV-1994,ABC,EQ,1,2,0.5,1.5,100,150")
    names = spark.createDataFrame([("ABC", "INE001A01010")], "ticker string, isin string")
    got = ingest_arrived(spark, str(inbox), header.split(","), "preisin", "nse-bhavcopy", str(tmp_path / "s"), str(tmp_path / "c"), lambda i: "2020-08-01", names)
    assert sum(got) == 1


def test_files_of_several_headers_are_read_by_their_own(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, "a.csv", "Date,Open,High,Low,Close,Volume", "2020-01-01,1,2,0.5,1.5,10")
    write(folder, "b.csv", "Date,Volume,Open,High,Low,Close,DLV_QTY", "2020-01-01,20,1,2,0.5,1.5,4")
    rows, _ = archives.daily_bars(spark, str(folder), {"A": "INE1", "B": "INE2"})
    assert {(r["ticker"], r["volume"], r["delivery_qty"]) for r in rows.collect()} == {("A", 10, None), ("B", 20, 4)}
    write(folder, "c.csv", "Date,Open,High,Low,Close,Volume", "2020-01-01,1,oops,0.5,1.5,10")
    with pytest.raises(IntegrityError):
        archives.daily_bars(spark, str(folder), {"A": "INE1"})


def test_backfill_unpacks_logs_and_can_be_run_again(spark, tmp_path):
    import io
    import zipfile

    root, asked = str(tmp_path / "s"), []

    def fetch(day):
        asked.append(day.day)
        if day.day == 14:
            return None
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            z.writestr("x.csv", f"{LEGACY}\n{ROW}\n" if day.day == 13 else f"{LEGACY}\n{ROW}\n")
        return body.getvalue()

    now = lambda: datetime(2020, 8, 1, tzinfo=timezone.utc)
    run = lambda: ingest.backfill(spark, root, "nse-bhavcopy", date(2020, 7, 13), date(2020, 7, 15), fetch, now)
    assert [(f.date.day, f.status, f.rows) for f in run()] == [(13, "ok", 1), (14, "no-file", 0), (15, "error", 0)]  # the 15th's file is of another day
    assert spark.read.parquet(f"{root}/bars").count() == 1 and spark.read.parquet(f"{root}/ingest_log").count() == 3
    asked.clear()
    run()
    assert asked == [15]


def test_one_writer_at_a_time(spark, tmp_path):
    from tidemark.plans.commits import lease as writer_lock

    with writer_lock(spark, str(tmp_path)), pytest.raises(RuntimeError), writer_lock(spark, str(tmp_path)):
        pass
    with writer_lock(spark, str(tmp_path)):
        pass


def test_index_levels_are_compared_on_all_days(spark, tmp_path):
    root = str(tmp_path / "i")
    df = spark.createDataFrame([("X", "Nifty X", "2020-01-01", 1.0), ("X", "Nifty X", "2020-01-02", 2.0)], "index_code string, index_name string, date string, close double")
    assert ingest.insert_index_levels(spark, root, "nse-index", df, "2020-02-01") == 2 and ingest.insert_index_levels(spark, root, "nse-index", df, "2020-02-02") == 0


def test_days_to_fetch_and_walk(spark):
    log = spark.createDataFrame([("n", date(2020, 1, 1), "ok"), ("n", date(2020, 1, 2), "error")], "source string, date date, status string")
    left = [r[0].day for r in addresses.days_to_fetch(spark, log, "n", date(2020, 1, 1), date(2020, 1, 3)).collect()]
    assert left == [2, 3]
    now = lambda: datetime(2020, 1, 3, tzinfo=timezone.utc)
    got = addresses.walk_days([date(2020, 1, 1), date(2020, 1, 2)], lambda d: None, lambda d, b: 0, now)
    assert [(f.date.day, f.status) for f in got] == [(1, "no-file")]
    with pytest.raises(RuntimeError):
        addresses.walk_days([date(2020, 1, i) for i in range(1, 9)], lambda d: 1 / 0, lambda d, b: 0, now)
    assert addresses.equity_file(date(2020, 7, 13)) == "2020/JUL/cm13JUL2020bhav.csv.zip"


def test_canonical_json():
    assert provenance.canonical_json({"b": 1.0, "a": [1e21, 0.000001, 1e-7, 4.5, -0.0], "ü": "\n"}) == '{"a":[1e+21,0.000001,1e-7,4.5,0],"b":1,"ü":"\\n"}'
    with pytest.raises(ValueError):
        provenance.canonical_json(float("nan"))
    assert provenance.digest_of({}) == hashlib.sha256(b"{}").hexdigest()


def roster(spark, *pairs):
    return spark.createDataFrame([(a, b, "2020-01-01", "manual", "") for a, b in pairs], "predecessor bigint, successor bigint, boundary string, reason string, note string").withColumn("boundary", F.col("boundary").cast("date"))


def test_roster_chain_apply_and_retract(spark):
    identity.validate_roster(roster(spark, (1, 2), (2, 3), (3, 4)))
    plan = identity.plan_links(roster(spark, (1, 2), (2, 3), (3, 4)), links(spark), "2021-01-01", "me")
    assert {(r["symbol_id"], r["entity_id"]) for r in plan.collect()} == {(2, 1), (3, 1), (4, 1)}
    identity.assert_flat(links(spark), plan)
    assert identity.plan_links(roster(spark, (1, 2), (2, 3), (3, 4)), plan, "2022-01-01", "me").count() == 0
    back = identity.plan_retraction(plan, "2022-01-01", "wrong", "me", entity_id=1)
    assert {(r["symbol_id"], r["entity_id"], r["reason"]) for r in back.collect()} == {(i, i, "retraction") for i in (2, 3, 4)}


def test_links_that_stand_otherwise_are_not_repointed(spark, tmp_path):
    chain = roster(spark, (1, 2), (2, 3))
    plan = identity.plan_links(chain, links(spark), "2021-01-01", "me")
    root = str(tmp_path / "l")
    assert ingest.insert_links(spark, root, plan) == 2
    stored = ingest.read(spark, f"{root}/symbol_links", "symbol_links")
    with pytest.raises(IntegrityError):  # another boundary
        identity.plan_links(chain.withColumn("boundary", F.lit("2020-02-02").cast("date")), stored, "2022-01-01", "me")
    with pytest.raises(IntegrityError):  # another predecessor
        identity.plan_links(roster(spark, (9, 3)), stored, "2022-01-01", "me")
    assert [(r["symbol_id"], r["entity_id"]) for r in identity.plan_links(roster(spark, (3, 4)), stored, "2022-01-01", "me").collect()] == [(4, 1)]
    known = spark.createDataFrame([(1,), (2,)], "symbol_id bigint")
    with pytest.raises(IntegrityError):
        identity.plan_links(chain, links(spark), "2021-01-01", "me", symbols=known)
    for kw in ({"symbol_id": 2}, {"symbol_id": 1}, {"symbol_id": 7}, {"entity_id": 7}):
        with pytest.raises(IntegrityError):
            identity.plan_retraction(stored, "2022-01-01", "wrong", "me", **kw)
    assert ingest.insert_links(spark, root, identity.plan_retraction(stored, "2022-01-01", "wrong", "me", entity_id=1)) == 2
    again = ingest.read(spark, f"{root}/symbol_links", "symbol_links")
    assert identity.plan_links(chain, again, "2023-01-01", "me").count() == 2


@pytest.mark.parametrize("pairs", [[(1, 1)], [(1, 2), (1, 3)], [(1, 3), (2, 3)], [(1, 2), (2, 3), (3, 1)], [(None, 2)]])
def test_bad_rosters_are_refused(spark, pairs):
    with pytest.raises(IntegrityError):
        identity.validate_roster(roster(spark, *pairs))


def test_links_of_two_hops_are_refused(spark):
    with pytest.raises(IntegrityError):
        identity.assert_flat(links(spark, [(2, 1, "manual", None, None, "2020-01-01")]), links(spark, [(3, 2, "manual", None, None, "2021-01-01")]))


def test_roster_file_round_trip():
    link = {"predecessor": 1, "successor": 2, "boundary": "2020-01-01", "reason": "manual", "note": "x"}
    text = identity.roster_document([link])
    assert identity.load_roster(text) == [link]
    with pytest.raises(ValueError):
        identity.load_roster(text.replace('"x"', '"y"'))
