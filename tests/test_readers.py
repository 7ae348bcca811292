"""One reader for batches and streams: headers in any order, zip files, errors with file and line, index files and their anomalies."""

import io
import zipfile
from datetime import date, datetime, timezone

import pytest

from tidemark.operators.checks import IntegrityError
from tidemark.plans import ingest
from tidemark.sources import archives, members
from tidemark.streaming.arrival import ingest_arrived, ingest_index_arrived

HEAD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"
SWAPPED = "SYMBOL,SERIES,OPEN,LOW,HIGH,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"
NEW = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal"
ROWS = {
    "a.csv": [HEAD, "AAA,EQ,10,11,9,10.5,10.5,10,1000,10500.5,13-JUL-2020,12,INE001A01010,", "FUT,XX,x,,,,,,,,,,,"],
    "b.csv": [SWAPPED, "BBB,EQ,10,9,11,10.5,10.5,10,1000,10500.5,14-JUL-2020,12,INE001A01011,"],
    "c.csv": [NEW, '2024-07-08,INE001A01012,"CCC",BE,1,2,0.5,1.5,3.7,4'],
}
INDEX_HEAD = ",".join(archives.INDEX_COLUMNS)
INDEX = [INDEX_HEAD, 'Nifty 50,04-07-2012,1,2,0.5,"5,302.5",-,1.2,100,-,18,3,1', "Twice,04-07-2012,1,1,1,1,1,1,1,1,1,1,1", "Twice,04-07-2012,1,1,1,2,1,1,1,1,1,1,1"]
LATER = datetime(2020, 8, 1, tzinfo=timezone.utc)


def put(folder, name, lines, zipped=False):
    folder.mkdir(exist_ok=True)
    body = ("﻿" + "\r\n".join(lines) + "\r\n").encode()
    if zipped:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, body)
        name, body = f"{name}.zip", out.getvalue()
    (folder / name).write_bytes(body)
    return str(folder / name)


def bars(df):
    return sorted((str(r["date"]), r["ticker"], float(r["low"]), float(r["high"]), float(r["close"]), r["volume"], float(r["turnover"])) for r in df.collect())


WANT = [("2020-07-13", "AAA", 9.0, 11.0, 10.5, 1000, 10500.5), ("2020-07-14", "BBB", 9.0, 11.0, 10.5, 1000, 10500.5), ("2024-07-08", "CCC", 0.5, 2.0, 1.5, 3, 4.0)]


@pytest.mark.parametrize("zipped", [False, True])
def test_stream_and_batch_read_files_by_their_own_headers(spark, tmp_path, zipped):
    for name, lines in ROWS.items():
        put(tmp_path / "in", name, lines, zipped)
    assert bars(archives.equity_bars(spark, str(tmp_path / "in"))) == WANT
    root = str(tmp_path / "s")
    assert sum(ingest_arrived(spark, str(tmp_path / "in"), None, None, "nse-bhavcopy", root, str(tmp_path / "c"), lambda i: "2024-08-01")) == 3
    stored = ingest.read(spark, f"{root}/bars", "bars").join(ingest.read(spark, f"{root}/symbols", "symbols").select("symbol_id", "ticker"), "symbol_id")
    assert bars(stored) == WANT


@pytest.mark.parametrize(
    ("row", "what"),
    [
        ("AAA,EQ,10,11,9,10.5,10.5,10,1000,oops,13-JUL-2020,12,INE001A01010,", "turnover oops"),
        ("AAA,EQ,10,11,9,10.5,10.5,10,1000,,13-JUL-2020,12,INE001A01010,", "turnover "),
        ("AAA,EQ,10,11,9,10.5,10.5,10,1e30,1,13-JUL-2020,12,INE001A01010,", "volume 1e30"),
        ("AAA,EQ,10,Infinity,9,10.5,10.5,10,1,1,13-JUL-2020,12,INE001A01010,", "high Infinity"),
        ("AAA,EQ,10,11,9,10.5", "date"),
    ],
)
def test_errors_name_file_line_and_value(spark, tmp_path, row, what):
    path = put(tmp_path / "in", "bad.csv", [HEAD, ROWS["a.csv"][1].replace("AAA", "OK").replace("1010", "1019"), "", row])
    with pytest.raises(IntegrityError, match=f"'file': 'bad.csv', 'line': 4, 'wrong': '{what}"):
        archives.equity_bars(spark, path)


def test_files_that_cannot_be_opened_are_errors(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "head.csv", ["A,B,C", "1,2,3"])
    (folder / "broken.zip").write_bytes(b"PK\x03\x04 not a zip file")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("one.csv", "x")
        z.writestr("two.csv", "y")
    (folder / "two.zip").write_bytes(out.getvalue())
    (folder / "latin.csv").write_bytes(b"SYMBOL,\xff\n")
    (folder / "blank.csv").write_bytes(b"\n")
    rows = archives.parsed(members.lines(members.batch_files(spark, str(folder))))
    wrong = {r["file"]: r["wrong"] for r in rows.collect()}
    assert set(wrong) == {"head.csv", "broken.zip", "two.zip", "latin.csv", "blank.csv"} and all(wrong.values())
    assert "unknown header" in wrong["head.csv"] and "one CSV expected" in wrong["two.zip"]
    with pytest.raises(IntegrityError):
        archives.equity_bars(spark, str(folder))


def test_index_files_of_a_stream_and_their_anomalies(spark, tmp_path):
    put(tmp_path / "in", "ind_close_all_04072012.csv", INDEX)
    put(tmp_path / "in", "ind_close_all_05072012.csv", [INDEX_HEAD, "Nifty 50,05/07/2012,1,2,0.5,5300,-,1.2,100,-,18,3,1", ",,,,,,,,,,,,"])
    levels, twice = archives.index_levels(archives.index_lines(members.lines(members.batch_files(spark, str(tmp_path / "in")))))
    assert sorted((str(r["date"]), r["index_name"], r["close"], r["points_change"]) for r in levels.collect()) == [("2012-07-04", "Nifty 50", 5302.5, None), ("2012-07-05", "Nifty 50", 5300.0, None)]
    assert [(str(r["date"]), r["index_name"], r["copies"]) for r in twice.collect()] == [("2012-07-04", "Twice", 2)]
    root = str(tmp_path / "s")
    run = lambda: sum(ingest_index_arrived(spark, str(tmp_path / "in"), "nse-index", root, str(tmp_path / "c"), lambda i: "2012-08-01"))
    assert run() == 2 and run() == 0
    put(tmp_path / "in", "ind_close_all_06072012.csv", [INDEX_HEAD, "Nifty 50,09/07/2012,1,2,0.5,5300,-,1.2,100,-,18,3,1"])
    with pytest.raises(Exception, match="a row of another day"):
        run()


def test_index_backfill_logs_anomalies_pages_and_its_floor(spark, tmp_path):
    root, asked = str(tmp_path / "s"), []

    def fetch(day):
        asked.append(day)
        if day == date(2012, 7, 4):
            return "\n".join(INDEX).encode()
        return b"<html>not found</html>" if day == date(2012, 7, 5) else "\n".join([INDEX_HEAD, "Nifty 50,09/07/2012,1,2,0.5,x,-,1.2,100,-,18,3,1"]).encode()

    got = ingest.index_backfill(spark, root, "nse-index", date(2012, 7, 4), date(2012, 7, 6), fetch, lambda: LATER)
    assert [(f.date.day, f.status, f.rows) for f in got] == [(4, "ok", 1), (5, "no-file", 0), (6, "error", 0)]
    log = {r["date"].day: (r["status"], r["note"]) for r in ingest.read(spark, f"{root}/ingest_log", "ingest_log").collect()}
    assert log[4] == ("ok", "'Twice' stands 2 times; all copies left out") and "a row of another day" in log[6][1]
    asked.clear()
    ingest.index_backfill(spark, root, "nse-index", date(2012, 1, 30), date(2012, 2, 2), lambda d: asked.append(d), lambda: LATER)
    assert asked == [date(2012, 2, 1), date(2012, 2, 2)]  # nothing before the archive's first day
