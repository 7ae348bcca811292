"""Gates from bitmaps and counted holes, rosters by their stated gates, merges of rosters, and applying one."""

from datetime import date, timedelta

import pytest
from market import bars, links, symbols, weekdays
from pyspark.sql import functions as F

from tidemark.operators import identity, roster
from tidemark.operators.checks import IntegrityError
from tidemark.plans import ingest

NSE, PIN = "nse-bhavcopy", "2030-01-01"


def isin(issuer: str, serial: int, country: str = "INE") -> str:
    body = f"{country}{issuer}{serial:02d}"
    digits = "".join(str(int(ch, 36)) for ch in body)
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return body + str(-total % 10)


A, B, C, D = (isin("001A01", k) for k in (1, 2, 3, 4))
OTHER = isin("002B01", 5)


def line(p=1, s=2, **kw):
    names = {1: A, 2: B, 3: C, 4: D}
    out = {
        "predecessor": p, "successor": s, "boundary": date(2020, 1, 6), "reason": "succession", "note": "", "predecessor_isin": names.get(p, OTHER), "successor_isin": names.get(s, OTHER),
        "last_date": date(2020, 1, 3), "first_date": date(2020, 1, 6), "check_digit": True, "issuer": "INE001A01", "serial": f"{p:02d}->{s:02d}", "sessions_between": 0, "unsettled_between": 0,
        "archive_unsettled": 0, "days_between": 3, "ratio": 1.01, "band": "1/1", "ratified_by": None, "ratified_at": None,
    }
    return out | kw


def frame(spark, *lines):
    return spark.createDataFrame([tuple(x.get(k) for k in roster.LINK) for x in lines], ", ".join(f"{k} {t}" for k, t in roster.LINK.items()))


SPLIT = {"ratio": 0.2, "band": "1/5"}
MANUAL = {"reason": "manual", "ratified_by": "me", "ratified_at": date(2020, 2, 1), "note": "circular 7"}


@pytest.mark.parametrize("kw", [{}, SPLIT, {"ratio": 0.5, "band": "1/2"}, {"ratio": 0.1, "band": "1/10"}, MANUAL | {"sessions_between": 40, "band": None, "ratio": 7.0, "days_between": 90, "issuer": "x", "serial": ""}])
def test_good_links_are_accepted(spark, kw):
    roster.validate_roster(frame(spark, line(**kw)), gates=True)


@pytest.mark.parametrize(
    ("kw", "rule"),
    [
        ({"successor_isin": B[:-1] + str((int(B[-1]) + 1) % 10)}, "G0"),
        ({"check_digit": False}, "G0"),
        (MANUAL | {"successor_isin": B[:-1] + str((int(B[-1]) + 1) % 10)}, "G0"),
        ({"predecessor_isin": isin("001A01", 1, "INF"), "issuer": "INF001A01"}, "G0: no equity"),
        ({"successor_isin": isin("009A01", 2)}, "G1"),
        ({"issuer": "INE999A01"}, "G1"),
        ({"predecessor_isin": B, "successor_isin": A, "serial": "02->01"}, "G2"),
        ({"serial": "01->03"}, "G2"),
        ({"last_date": date(2020, 1, 6), "days_between": 0}, "G3"),
        (MANUAL | {"last_date": date(2020, 1, 7)}, "G3"),
        ({"sessions_between": 1}, "G4: sessions"),
        ({"unsettled_between": 1}, "G4a"),
        ({"archive_unsettled": 2}, "G4a"),
        ({"unsettled_between": None}, "G4a"),
        ({"last_date": date(2020, 1, 1), "days_between": 5}, "G4b"),
        ({"days_between": 2}, "G4b"),
        ({"ratio": 0.8 * 0.9, "band": "1/1"}, "G6"),
        ({"ratio": 0.2, "band": "1/2"}, "G6"),
        ({"ratio": None, "band": None}, "G6"),
        ({"boundary": date(2020, 1, 7)}, "boundary"),
        (MANUAL | {"note": ""}, "note"),
        (MANUAL | {"ratified_by": None}, "ratifier"),
        (MANUAL | {"ratified_at": None}, "ratified"),
        ({"reason": "retraction"}, "reason"),
    ],
)
def test_bad_links_are_refused(spark, kw, rule):
    with pytest.raises(IntegrityError, match=rule):
        roster.validate_roster(frame(spark, line(**kw)), gates=True)


def test_chains_of_three_and_their_order(spark):
    second = line(2, 3, boundary=date(2021, 1, 4), last_date=date(2021, 1, 1), first_date=date(2021, 1, 4))
    roster.validate_roster(frame(spark, line(), second), gates=True)
    with pytest.raises(IntegrityError, match="ends before it begins"):
        early = {"boundary": date(2019, 1, 7), "last_date": date(2019, 1, 4), "first_date": date(2019, 1, 7)}
        roster.validate_roster(frame(spark, line(), line(2, 3, **early)), gates=True)


@pytest.mark.parametrize("pairs", [[(1, 2), (1, 3)], [(1, 3), (2, 3)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1)]])
def test_only_paths(spark, pairs):
    with pytest.raises(IntegrityError):
        roster.validate_roster(frame(spark, *(line(*p) for p in pairs)))


def pairs_of(df):
    return sorted((r["predecessor"], r["successor"], r["reason"]) for r in df.collect())


def test_manual_links_outlive_a_regenerate(spark):
    old = frame(spark, line(3, 4, **MANUAL), line(5, 6))
    got, adopted = roster.merged(frame(spark, line(1, 2)), old)
    assert pairs_of(got) == [(1, 2, "succession"), (3, 4, "manual")]  # the old generated link is not carried
    assert [(r["predecessor"], r["superseded_generated"], r["ratified_by"]) for r in adopted.collect()] == [(3, False, "me")]


def test_the_manual_link_stays_when_the_generator_finds_the_pair(spark):
    got, adopted = roster.merged(frame(spark, line(1, 2)), frame(spark, line(1, 2, **MANUAL)))
    assert pairs_of(got) == [(1, 2, "manual")] and adopted.first()["superseded_generated"]


@pytest.mark.parametrize("other", [{"boundary": date(2020, 1, 7)}, {"first_date": date(2020, 1, 7)}, {"last_date": date(2020, 1, 2)}])
def test_twins_that_disagree_about_the_boundary_are_an_error(spark, other):
    with pytest.raises(IntegrityError, match="boundary"):
        roster.merged(frame(spark, line(1, 2)), frame(spark, line(1, 2, **(MANUAL | other))))


@pytest.mark.parametrize("by_hand", [(1, 3), (3, 2)])
def test_a_manual_link_that_shares_an_end_with_another_is_an_error(spark, by_hand):
    with pytest.raises(IntegrityError, match="claim one symbol"):
        roster.merged(frame(spark, line(1, 2)), frame(spark, line(*by_hand, **MANUAL)))


def test_chained_manual_links_are_no_contradiction(spark):
    got, _ = roster.merged(frame(spark, line(1, 2)), frame(spark, line(2, 3, **MANUAL)))
    assert pairs_of(got) == [(1, 2, "succession"), (2, 3, "manual")]


def test_appending_a_manual_link(spark):
    one = frame(spark, line(1, 2))
    assert pairs_of(roster.append_manual(one, frame(spark, line(2, 3, **MANUAL)))) == [(1, 2, "succession"), (2, 3, "manual")]
    for bad in (line(1, 2, **MANUAL), line(1, 3, **MANUAL), line(2, 3)):
        with pytest.raises(IntegrityError):
            roster.append_manual(one, frame(spark, bad))


def test_apply_validates_plans_and_appends_at_once(spark, tmp_path):
    root = str(tmp_path / "s")
    batch = spark.createDataFrame([(i, "2020-01-01") for i in (A, B, C)], "isin string, date string").select(
        "isin", F.col("isin").alias("ticker"), F.col("date").cast("date"), F.lit("EQ").alias("series"), *[F.lit(1).cast("decimal(14,4)").alias(k) for k in ("open", "high", "low", "close")], F.lit(5).cast("bigint").alias("volume")
    )
    ingest.insert_bars(spark, root, NSE, batch, "2020-02-01")
    good = frame(spark, line())
    with pytest.raises(ValueError, match="digest"):
        ingest.apply_roster(spark, root, good, "", "me", "2020-03-01")
    with pytest.raises(IntegrityError):
        ingest.apply_roster(spark, root, frame(spark, line(sessions_between=3)), "d", "me", "2020-03-01")
    with pytest.raises(IntegrityError, match="does not know"):
        ingest.apply_roster(spark, root, frame(spark, line(), line(2, 4, boundary=date(2021, 1, 4), last_date=date(2021, 1, 1), first_date=date(2021, 1, 4))), "d", "me", "2020-03-01")
    stored = lambda: ingest.read(spark, f"{root}/symbol_links", "symbol_links")
    dry = ingest.apply_roster(spark, root, good, "d", "me", "2020-03-01", dry_run=True)
    assert (dry.rows.count(), dry.skipped, dry.written, stored().count()) == (1, 0, False, 0)
    done = ingest.apply_roster(spark, root, good, "d", "me", "2020-03-01")
    assert (done.rows.count(), done.skipped, done.written) == (1, 0, True)
    row = stored().first()
    assert (row["symbol_id"], row["entity_id"], row["roster_sha"]) == (2, 1, "d") and '"serial":"01->02"' in row["evidence"]
    again = ingest.apply_roster(spark, root, good, "d", "me", "2020-04-01")
    assert (again.rows.count(), again.skipped, again.written) == (0, 1, False)


def gated(spark, rows, log, facts=None, **kw):
    names = symbols(spark, facts or [(1, A, "X", "2000-01-01", "0001-01-01"), (2, B, "X", "2000-01-01", "0001-01-01")])
    logged = spark.createDataFrame([(NSE, date.fromisoformat(d), "ok") for d in log], "source string, date date, status string")
    return identity.gate_results(bars(spark, rows), names, links(spark), logged, NSE, PIN, **kw)


def test_a_gap_of_ten_years_is_counted_and_not_cut_off(spark):
    days = [(date(2005, 1, 3) + timedelta(days=i)).isoformat() for i in range(4000)]
    rows = [(1, days[0], 10.0), (2, days[-1], 10.0)]
    got = gated(spark, rows, [days[0], days[-1]]).first()
    assert (got["unsettled_between"], got["g4a_settled"], got["days_between"]) == (3998, False, 3999)
    got = gated(spark, rows, days).first()
    assert (got["unsettled_between"], got["g4a_settled"], got["g4_no_session"], got["g4b_gap"], got["accepted"]) == (0, True, True, False, False)
    got = gated(spark, rows, [d for d in days if d != days[2000]]).first()
    assert (got["unsettled_between"], got["g4a_settled"]) == (1, False)


def test_a_last_close_of_zero_fails_g6_and_nothing_else(spark):
    days = weekdays("2020-01-06", 4)
    got = gated(spark, [(1, days[0], 10.0), (1, days[1], 0.0), (2, days[2], 10.0), (2, days[3], 10.0)], days).first()
    assert got["ratio"] is None and not got["g6_ratio"] and not got["accepted"]
    assert all(got[g] for g in identity.GATES if g != "g6_ratio")


def test_ratios_are_rounded_before_the_band_is_looked_up(spark):
    days = weekdays("2020-01-06", 2)
    got = gated(spark, [(1, days[0], 10000.0), (2, days[1], 12500.4)], days).first()
    assert got["ratio"] == 1.25 and got["g6_ratio"]  # 1.25004 unrounded
    got = gated(spark, [(1, days[0], 10000.0), (2, days[1], 12500.6)], days).first()
    assert got["ratio"] == 1.2501 and not got["g6_ratio"]


def test_shared_days_are_the_and_of_two_bitmaps(spark):
    days = weekdays("1999-01-01", 3000)
    rows = [(1, d, 1.0) for d in days[:2000]] + [(2, d, 1.0) for d in days[500::3]]
    got = gated(spark, rows, days).first()
    assert got["shared_days"] == len(set(days[:2000]) & set(days[500::3])) and not got["g3_apart"]
    assert (got["predecessor_bars"], got["successor_bars"]) == (2000, len(days[500::3]))
    interleaved = [(1, d, 1.0) for d in days[0:20:2]] + [(2, d, 1.0) for d in days[1:20:2]]
    got = gated(spark, interleaved, days).first()
    assert got["shared_days"] == 0 and not got["g3_apart"]


def test_any_pair_can_be_looked_at(spark):
    days = weekdays("2020-01-06", 6)
    facts = [(1, A, "X", "2000-01-01", "0001-01-01"), (2, OTHER, "Y", "2000-01-01", "0001-01-01"), (3, C, "Z", "2000-01-01", "0001-01-01")]
    rows = [(1, days[0], 1.0), (2, days[1], 1.0), (3, days[5], 1.0)]
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "predecessor bigint, successor bigint")
    found = gated(spark, rows, days, facts, pairs=asked)
    assert {(r["predecessor"], r["successor"]) for r in found.collect()} == {(1, 2), (1, 3)}  # 9 has no bars
    one = {r["gate"]: (r["passed"], r["first_failure"]) for r in identity.evaluate_pair(found, 1, 2).collect()}
    assert one["g1_issuer"] == (False, True) and one["g3_apart"] == (True, False) and len(one) == 9
    assert [r["gate"] for r in identity.evaluate_pair(found, 1, 3).where("not passed").orderBy("place").collect()][0] == "g4_no_session"


def test_two_accepted_pairs_of_one_symbol_both_fail_g5(spark):
    days = weekdays("2020-01-06", 3)
    facts = [(1, A, "X", "2000-01-01", "0001-01-01"), (2, B, "Y", "2000-01-01", "0001-01-01"), (3, C, "X", "2000-01-01", "0001-01-01")]
    rows = [(1, days[0], 1.0), (2, days[1], 1.0), (3, days[1], 1.0)]
    asked = spark.createDataFrame([(1, 2), (1, 3)], "predecessor bigint, successor bigint")
    assert [(r["g5_path"], r["accepted"]) for r in gated(spark, rows, days, facts, pairs=asked).collect()] == [(False, False)] * 2


def test_review_lines_begin_with_a_header(spark):
    rows = spark.createDataFrame([(3, 4, 0.5), (1, 2, 1.0)], "predecessor bigint, successor bigint, ratio double")
    got = [r["value"] for r in roster.review_lines(rows, "2020-01-01").collect()]
    assert '"review_version":1' in got[0] and '"candidates":2' in got[0] and [x[:16] for x in got[1:]] == ['{"predecessor":1', '{"predecessor":3']
