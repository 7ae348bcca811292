import pytest
from market import adjustments, bars, links, symbols, weekdays
from pyspark.sql import functions as F

from tidemark.operators import actions, bitemporal, returns, signals, universe
from tidemark.operators.checks import IntegrityError

PIN = "2030-01-01"


def test_latest_version_respects_the_pin(spark):
    b = bars(spark, [(1, "2020-01-01", 10.0), (1, "2020-01-01", 11.0, "2020-06-01 00:00:00", "EQ")])
    read = lambda pin: [r["close"] for r in bitemporal.latest_version(b, ["symbol_id", "date"], pin).select(F.col("close").cast("double")).collect()]
    assert read("2020-02-01") == [10.0] and read(None) == [11.0] and read("2019-01-01") == []


def test_labels_fall_back_to_the_earliest(spark):
    s = symbols(spark, [(1, "INE000101010", "OLD", "2010-01-01", "2010-01-01"), (1, "INE000101010", "NEW", "2015-01-01", "2015-01-01")])
    label = lambda day: bitemporal.labels_in_force(s, day, PIN).first()["ticker"]
    assert [label(d) for d in ("2000-01-01", "2012-01-01", "2015-01-01")] == ["OLD", "OLD", "NEW"]


def split_market(spark):
    """950 until 26 July, 959.40, then 100.35 and 107.60 under a new identifier from 29 July."""
    days = weekdays("2022-07-04", 30)
    price = lambda d: 950.0 if d <= "2022-07-26" else 959.40 if d == "2022-07-27" else 100.35 if d == "2022-07-28" else 107.60
    b = bars(spark, [(1 if d < "2022-07-29" else 2, d, price(d)) for d in days])
    s = symbols(spark, [(1, "INE081A01012", "T", "2000-01-01", "0001-01-01"), (2, "INE081A01020", "T", "2000-01-01", "0001-01-01")])
    return b, s, links(spark, [(2, 1, "succession", "2022-07-29", 1, "2000-01-01")])


@pytest.mark.parametrize(
    ("window", "status"),
    [(("2022-07-06", "2022-07-20"), "priced"), (("2022-07-06", "2022-07-22"), "refused"), (("2022-07-06", "2022-08-03"), "refused"), (("2022-07-29", "2022-08-05"), "priced")],
)
def test_fence_refuses_windows_that_reach_the_guard(spark, window, status):
    b, s, k = split_market(spark)
    row = returns.entity_returns(b, s, k, adjustments(spark), "nse-bhavcopy", [window], PIN).first()
    assert row["status"] == status
    if row["reason"] == "boundary":
        assert str(row["guard"]) == "2022-07-22"


def test_an_action_in_the_guard_opens_the_fence(spark):
    b, s, k = split_market(spark)
    row = returns.entity_returns(b, s, k, adjustments(spark, [(1, "2022-07-28", 10.0)]), "nse-bhavcopy", [("2022-07-06", "2022-08-03")], PIN).first()
    assert row["status"] == "priced" and row["return"] == pytest.approx(107.60 * 10 / 950 - 1)


def test_every_entity_is_accounted_for(spark):
    b, s, k = split_market(spark)
    ids = spark.createDataFrame([(1,), (77,)], "entity_id bigint")
    got = {r["entity_id"]: (r["status"], r["reason"]) for r in returns.entity_returns(b, s, k, adjustments(spark), "nse-bhavcopy", [("2022-07-06", "2022-07-20")], PIN, ids).collect()}
    assert got == {1: ("priced", None), 77: ("absent", "no close at either end")}


def test_universe_presence_liveness_and_window(spark):
    days = weekdays("2021-01-04", 125)
    b = bars(spark, [(1, d, 10.0) for d in days] + [(2, d, 20.0) for d in days[:100]] + [(3, d, 5.0) for d in days[60:]])
    s = symbols(spark, [(i, f"INE00{i}A01010", f"T{i}", "2000-01-01", "0001-01-01") for i in (1, 2, 3)])
    read = lambda **kw: [r["entity_id"] for r in universe.universe_as_of(b, s, links(spark), "nse-bhavcopy", days[-1], 125, 10, PIN, **kw).collect()]
    assert read() == [1] and read(allow_stale=True) == [2, 1]


def test_overlap_is_an_error(spark):
    d = weekdays("2021-01-04", 2)
    b = bars(spark, [(i, x, 10.0) for i in (1, 2) for x in d])
    s = symbols(spark, [(i, f"INE00{i}A01010", f"T{i}", "2000-01-01", "0001-01-01") for i in (1, 2)])
    k = links(spark, [(2, 1, "manual", None, None, "2000-01-01")])
    with pytest.raises(Exception, match="members of an entity overlap: 1"):
        universe.universe_as_of(b, s, k, "nse-bhavcopy", d[-1], 2, 5, PIN).collect()
    with pytest.raises(Exception, match="more than one member of an entity traded: 1"):
        bitemporal.bars_for_date(b, s, k, "nse-bhavcopy", d[0], PIN).collect()


def test_window_is_known_where_nobody_ranks(spark):
    b = bars(spark, [(1, "2021-01-04", 10.0)]).withColumn("series", F.lit("BE"))
    s = symbols(spark, [(1, "INE001A01010", "T", "2000-01-01", "0001-01-01")])
    assert universe.universe_as_of(b, s, links(spark), "nse-bhavcopy", "2021-01-04", 5, 5, PIN).count() == 0
    found = universe.window_of(b, "nse-bhavcopy", "2021-01-04", 5, PIN)
    assert (found.sessions, str(found.last_session)) == (1, "2021-01-04") and "0 names over 1 sessions" in universe.text_of([], found, "2021-01-04")


def test_unlinked_kinds(spark):
    from tidemark.operators import identity

    cands = spark.createDataFrame([(1, 2, True), (3, 4, True), (5, 6, False), (7, 8, False), (9, 10, True)], "predecessor bigint, successor bigint, accepted boolean")
    s = symbols(spark, [(i, f"INE00{i}", f"T{i}", "2000-01-01", "0001-01-01") for i in range(1, 9)])
    k = links(spark, [(2, 1, "succession", "2010-01-01", 1, "2011-01-01"), (8, 7, "succession", "2010-01-01", 7, "2011-01-01")])
    got = {(r["predecessor"], r["kind"]) for r in identity.unlinked(cands, s, k, PIN).collect()}
    assert got == {(3, "accepted"), (5, "quarantined"), (7, "stale"), (9, "accepted")}


def test_holes_are_days_without_a_row_too_and_the_tail_is_pending(spark):
    from tidemark.operators import identity

    log = spark.createDataFrame(
        [("n", d, s, t) for d, s, t in (("2020-01-01", "ok", "2020-01-02 00:00:00"), ("2020-01-03", "error", "2020-01-04 00:00:00"), ("2020-01-05", "no-file", "2020-01-06 00:00:00"), ("2020-01-06", "error", "2020-01-07 18:30:00"), ("2020-01-07", "error", "2020-01-07 18:30:00"))],
        "source string, date string, status string, fetched_at string",
    ).select("source", F.col("date").cast("date"), "status", F.col("fetched_at").cast("timestamp"))
    days = lambda **kw: sorted(r["date"].day for r in identity.archive_holes(log, "n", **kw).collect())
    assert days() == [2, 3, 4, 6]  # the 6th could settle at 18:30 of the 7th, to the second; the 7th is pending
    assert days(end="2020-01-03") == [2, 3]
    assert identity.archive_holes(log, "other").count() == 0


@pytest.mark.parametrize(("raw", "adjusted", "outcome", "ratio"), [((2202.5, 1069.8), (1101.25, 1069.8), "share action", 2.0), ((1850.0, 370.0), (370.0, 370.0), "share action", 5.0), ((200.0, 203.0), (100.0, 203.0), "uncorroborated", 2.0)])
def test_actions_need_a_fraction_and_a_matching_price(spark, raw, adjusted, outcome, ratio):
    days = weekdays("2024-01-01", 2)
    b = bars(spark, [(1, d, p) for d, p in zip(days, raw, strict=True)]).unionByName(bars(spark, [(1, d, p) for d, p in zip(days, adjusted, strict=True)], "eod2"))
    row = actions.detect(b, symbols(spark, [(1, "INE001A01010", "T", "2000-01-01", "0001-01-01")]), links(spark), PIN, fraction_tolerance=0.09).first()
    assert (row["outcome"], row["exact"]) == (outcome, ratio)


def test_unlinked_reissue_is_found_by_ticker(spark):
    days = weekdays("2024-01-01", 2)
    b = bars(spark, [(1, days[0], 1850.0), (2, days[1], 370.0)]).unionByName(bars(spark, [(2, d, 370.0) for d in days], "eod2"))
    s = symbols(spark, [(i, f"INE001A0101{i}", "T", "2000-01-01", "0001-01-01") for i in (1, 2)])
    row = actions.detect(b, s, links(spark), PIN).first()
    assert (row["entity_id"], row["exact"]) == (2, 5.0)


def test_rebalance_days_move_by_the_offset(spark):
    days = weekdays("2024-01-01", 130)
    df = spark.createDataFrame([(d,) for d in days], "date string").select(F.col("date").cast("date"))
    for offset in (0, 1, 3, 7):
        got = sorted(str(r["date"]) for r in signals.rebalance_calendar(df, 1, offset).collect())
        ends = [i for i in range(len(days) - 1) if days[i][:7] != days[i + 1][:7]]
        assert got == [days[i + offset] for i in ends if i + offset < len(days)]


@pytest.mark.parametrize(("text", "want"), [("2026-09-07", "2026-09-07 00:00:00.000000+00:00"), ("2026-09-07T18:30:00+05:30", "2026-09-07 13:00:00.000000+00:00"), ("2026-09-07T18:30:00.25Z", "2026-09-07 18:30:00.250000+00:00")])
def test_pins_are_times_in_utc(spark, text, want):
    assert bitemporal.parse_pin(text) == want
    rows = spark.sql(f"SELECT timestamp'{want}' AS ingested_at UNION ALL SELECT timestamp'{want}' + INTERVAL 1 MICROSECOND")
    assert bitemporal.believed(rows, bitemporal.parse_pin(text)).count() == 1


@pytest.mark.parametrize("text", ["yesterday", "2026-9-7", "2026-09-07T18:30:00", "07-09-2026"])
def test_what_is_no_pin_is_refused(text):
    with pytest.raises(ValueError):
        bitemporal.parse_pin(text)


def test_no_pin_is_now():
    from datetime import datetime, timezone

    assert bitemporal.parse_pin("", datetime(2026, 9, 7, 1, 2, 3, tzinfo=timezone.utc)) == "2026-09-07 01:02:03.000000+00:00"
