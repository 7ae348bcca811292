"""Tickers from before ISINs, by the rules that decide what may be joined."""

import json
from datetime import date

import pytest
from market import weekdays

from tidemark.operators import preisin

DAYS = weekdays("2011-01-03", 60)


def day(i):
    return date.fromisoformat(DAYS[i])


@pytest.fixture
def calendar(spark):
    return spark.createDataFrame([(date.fromisoformat(d),) for d in DAYS], "date date")


def vanished(spark, *rows):
    return spark.createDataFrame([(t, day(i), c) for t, i, c in rows], "ticker string, last_date date, last_close double")


def newcomers(spark, *rows):
    return spark.createDataFrame([(t, f"INE{t}", day(i), c) for t, i, c in rows], "ticker string, isin string, first_date date, first_close double")


def matched(spark, calendar, gone, come, **kw):
    return sorted((r["ticker"], r["newcomer"], r["isin"]) for r in preisin.match_renames(vanished(spark, *gone), newcomers(spark, *come), calendar, **kw).collect())


@pytest.mark.parametrize(("at", "close", "found"), [(20, 100.0, True), (21, 114.9, True), (25, 85.1, True), (26, 100.0, False), (19, 100.0, False), (21, 115.2, False), (21, 84.9, False), (21, 0.0, False)])
def test_gap_and_price_of_a_rename(spark, calendar, at, close, found):
    assert matched(spark, calendar, [("OLD", 20, 100.0)], [("NEW", at, close)]) == ([("OLD", "NEW", "INENEW")] if found else [])


def test_ambiguous_either_way_is_left_unpaired(spark, calendar):
    assert matched(spark, calendar, [("OLD", 20, 100.0)], [("N1", 21, 100.0), ("N2", 22, 101.0)]) == []
    assert matched(spark, calendar, [("O1", 20, 100.0), ("O2", 21, 100.0), ("O3", 20, 7.0)], [("N1", 21, 100.0), ("N3", 21, 7.1)]) == [("O3", "N3", "INEN3")]


def test_price_steps_lose_no_pair(spark, calendar):
    gone = [(f"V{i}", 20, 3.0 * 1.5**i) for i in range(40)]
    come = [(f"W{i}{k}", 22, 3.0 * 1.5**i * x) for i in range(40) for k, x in enumerate((0.8501,) if i % 2 else (1.1499,))]
    want = sorted((v, w, f"INE{w}") for v, _, a in gone for w, _, b in come if abs(b / a - 1) <= 0.15)
    assert len(want) == 40 and matched(spark, calendar, gone, come) == want


def observed(spark, *rows):
    return spark.createDataFrame([(t, day(a), x, day(b), y) for t, a, x, b, y in rows], "ticker string, first_date date, first_close double, last_date date, last_close double")


def test_the_four_kinds(spark, calendar, tmp_path):
    seen = observed(
        spark, ("STAYS", 0, 10.0, 30, 10.0), ("SAMEDAY", 0, 10.0, 31, 10.0), ("AWAY", 0, 70.0, 30, 70.0), ("GONE", 0, 500.0, 29, 500.0), ("DIES LATE", 0, 900.0, 30, 900.0), ("INFOSYSTCH", 0, 2865.0, 27, 2865.3),
        ("INFY", 28, 2881.75, 30, 2900.0),
    )
    bridge = newcomers(spark, ("STAYS", 32, 10.0), ("SAMEDAY", 31, 10.0), ("AWAY", 50, 70.0), ("INFY", 31, 2900.0), ("AWAY2", 31, 70.0), ("GONE2", 31, 500.0))
    found = preisin.assignments(seen, bridge, calendar)
    got = {r["ticker"]: (r["kind"], r["identity"], r["gap_sessions"]) for r in found.collect()}
    assert got == {
        "STAYS": ("bridged", "INESTAYS", 2), "SAMEDAY": ("bridged", "INESAMEDAY", 0),
        "AWAY": ("quarantined", "X-NSE-AWAY", 20),  # although AWAY2 would match: it has an ISIN of its own
        "GONE": ("renamed", "INEGONE2", 2), "DIES LATE": ("dead", "X-NSE-DIES LATE", None), "INFOSYSTCH": ("renamed", "INEINFY", 1), "INFY": ("bridged", "INEINFY", 1),
    }
    counts = preisin.write_proposal(found, str(tmp_path / "p"), DAYS[0], DAYS[31], "2020-01-01T00:00:00Z")
    assert {k: counts[k] for k in ("bridged", "dead", "quarantined", "renamed", "total")} == {"bridged": 3, "dead": 1, "quarantined": 1, "renamed": 2, "total": 7}
    assert json.loads((tmp_path / "p" / "summary.json").read_text()) == counts
    lines = [json.loads(r["value"])["ticker"] for r in spark.read.text(str(tmp_path / "p" / "assignments")).collect()]
    assert sorted(lines) == sorted(got)


def test_tickers_of_the_first_day_are_no_newcomers(spark, calendar):
    seen = observed(spark, ("OLD", 0, 5.0, 3, 5.0), ("FIRST", 0, 5.0, 30, 5.0))
    got = {r["ticker"]: r["kind"] for r in preisin.assignments(seen, newcomers(spark, ("FIRST", 31, 5.0)), calendar).collect()}
    assert got == {"OLD": "dead", "FIRST": "bridged"}


def test_days_that_are_no_sessions_are_never_adjacent(spark, calendar):
    seen = vanished(spark, ("T", 30, 1.0))
    bridge = spark.createDataFrame([("T", "INET", date(2011, 2, 13))], "ticker string, isin string, first_date date")  # a Sunday
    none = spark.createDataFrame([], "ticker string, newcomer string, isin string, first_date date")
    assert [(r["kind"], r["gap_sessions"]) for r in preisin.resolve(seen, bridge, none, calendar).collect()] == [("quarantined", None)]
