"""Identity across reissued identifiers: candidates, gates and invariants of the links in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import isin_check_ok, issue_serial, issuer_prefix, ratio_band, round4
from ..plans.storage import kept
from .bitemporal import Pin, bars_at, believed, entity_map, latest_version, sessions
from .checks import assert_empty

GATES = ("g0_equity", "g1_issuer", "g2_serial", "g3_apart", "g4_no_session", "g4a_settled", "g4b_gap", "g6_ratio")
MAX_GAP_DAYS = 4


def day_maps(bars: DataFrame, source: str, pin: Pin) -> DataFrame:
    """Per symbol and bucket of days (a few human lifetimes each): a bitmap of the days with a bar, and the ends of the stretch with their closes. All that the
    gates ask of bars comes from this one pass."""
    day = F.unix_date("date").cast("bigint")
    close = F.col("close").cast("double")
    return bars_at(bars, source, pin).groupBy("symbol_id", F.bitmap_bucket_number(day).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(day)).alias("map"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by(close, "date").alias("first_close"), F.max_by(close, "date").alias("last_close"),
    )


def facts_of(maps: DataFrame, symbols: DataFrame, calendar: DataFrame, pin: Pin) -> DataFrame:
    """Per symbol with bars: label, first and last day, number of days, first and last close, and both days' numbers in the calendar (one row per session)."""
    per = maps.groupBy("symbol_id").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum(F.bitmap_count("map")).alias("days"),
        F.min_by("first_close", "first_date").alias("first_close"), F.max_by("last_close", "last_date").alias("last_close"),
    )
    numbered = calendar.select("date", F.row_number().over(Window.orderBy("date")).alias("n"))
    for end in ("first", "last"):
        per = per.join(numbered.select(F.col("date").alias(f"{end}_date"), F.col("n").alias(f"{end}_n")), f"{end}_date")
    return per.join(latest_version(symbols, ["symbol_id"], pin).select("symbol_id", "isin", "ticker"), "symbol_id")


def symbol_facts(bars: DataFrame, symbols: DataFrame, source: str, pin: Pin, calendar: DataFrame | None = None) -> DataFrame:
    """facts_of() of a source's bars. calendar: the kept table of sessions, if there is one."""
    return facts_of(day_maps(bars, source, pin), symbols, sessions(bars if calendar is None else calendar, source, None, None, pin), pin)


def consecutive(facts: DataFrame) -> DataFrame:
    """(predecessor, successor, generator, p, s): pairs of consecutive symbols, by first day, of one issuer (equity ISINs only) or of one last
    ticker, with the facts of both; a pair that both find counts for the issuer."""

    def pairs(rows: DataFrame, key: Column, name: str) -> DataFrame:
        order = Window.partitionBy("_key").orderBy("p.first_date", "p.symbol_id")
        rows = rows.select(key.alias("_key"), F.struct(*facts.columns).alias("p"))
        return rows.select("p", F.lead("p").over(order).alias("s"), F.lit(name).alias("generator")).where("s is not null")

    both = pairs(facts.where(F.col("isin").startswith("INE")), issuer_prefix("isin"), "issuer").unionByName(pairs(facts, F.col("ticker"), "ticker"))
    return both.groupBy(F.col("p.symbol_id").alias("predecessor"), F.col("s.symbol_id").alias("successor")).agg(F.min("generator").alias("generator"), F.any_value("p").alias("p"), F.any_value("s").alias("s"))


def candidates(facts: DataFrame) -> DataFrame:
    """The pairs of consecutive() without the facts."""
    return consecutive(facts).select("predecessor", "successor", "generator")


def any_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Any pairs (predecessor, successor) with the facts of both, as consecutive() gives them; a symbol without bars drops its pair."""
    out = pairs.select("predecessor", "successor", F.lit("asked").alias("generator")).distinct()
    for side, name in (("predecessor", "p"), ("successor", "s")):
        out = out.join(facts.select(F.col("symbol_id").alias(side), F.struct(*facts.columns).alias(name)), side)
    return out


def settled_days(log: DataFrame, source: str) -> DataFrame:
    return log.where((F.col("source") == source) & F.col("status").isin("ok", "no-file")).select("date").distinct()


def archive_holes(log: DataFrame, source: str, start: str | None = None, end: str | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Days from start to end (of the log, if not given) without a settled fetch, a row of the log or not, although the last fetch came when they could
    have settled: 24 hours after their end in Indian time. expected: the days that must be settled; all calendar days by default."""
    rows = log.where(F.col("source") == source)
    lo, hi = (F.lit(x).cast("date") if x else f("date") for x, f in ((start, F.min), (end, F.max)))
    span = rows.agg(lo.alias("_lo"), hi.alias("_hi"), F.max(F.unix_seconds("fetched_at")).alias("_last"))
    days = span.where("_lo <= _hi").select("_last", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    if expected is not None:
        days = days.join(expected.select("date").distinct(), "date", "left_semi")
    # The end of a day in India is 18:30 of it in UTC; as seconds, no session's time zone enters.
    could = (F.unix_date("date").cast("bigint") * 86400 + 66600 + 86400) <= F.col("_last")
    return days.where(could).join(settled_days(log, source), "date", "left_anti").select("date")


def holes_before(log: DataFrame, source: str, calendar: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(date, before, here): of each calendar day from the first to the last session, how many days before it have no settled fetch, and whether it has none
    itself. One row per day of history, so that a gap of any length is a difference of two counts."""
    days = calendar.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi")).where("_lo is not null").select(F.explode(F.sequence("_lo", "_hi")).alias("date"))
    days = days.join(settled_days(log, source).withColumn("_settled", F.lit(True)), "date", "left")
    here = F.col("_settled").isNull()
    if expected is not None:
        days = days.join(expected.select("date").distinct().withColumn("_due", F.lit(True)), "date", "left")
        here = here & F.col("_due").isNotNull()
    days = days.select("date", here.cast("int").alias("here"))
    return days.withColumn("before", F.coalesce(F.sum("here").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def shared_days(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """(predecessor, successor, shared): the days on which both have a bar, counted in the AND of their bitmaps; pairs that share none have no row."""
    ends = pairs.select("predecessor", "successor", F.explode(F.array("predecessor", "successor")).alias("symbol_id"))
    met = ends.join(maps.select("symbol_id", "bucket", "map"), "symbol_id").groupBy("predecessor", "successor", "bucket")
    both = met.agg(F.count(F.lit(1)).alias("_k"), F.bitmap_count(F.bitmap_and_agg("map")).alias("_n")).where("_k = 2")
    return both.groupBy("predecessor", "successor").agg(F.sum("_n").alias("shared")).where("shared > 0")


def evaluated(pairs: DataFrame, maps: DataFrame, links: DataFrame, log: DataFrame, source: str, pin: Pin, calendar: DataFrame, max_gap_days: int = MAX_GAP_DAYS, expected: DataFrame | None = None) -> DataFrame:
    """Each pair of consecutive() or any_pairs() with what the gates G0 to G4b and G6 measured and how they went, and whether its successor's latest link is a
    retraction. Nothing is enforced here. A last close of 0 has no ratio and fails G6."""
    rows = pairs.select("predecessor", "successor", "generator", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ps" for c in ("isin", "first_date", "last_date", "first_n", "last_n", "first_close", "last_close", "days")])
    # Stretches that do not meet share no day.
    overlapping = rows.where("p_last_date >= s_first_date").select("predecessor", "successor")
    rows = rows.join(shared_days(overlapping, maps), ["predecessor", "successor"], "left")
    holes = holes_before(log, source, calendar, expected)
    rows = rows.join(holes.select(F.col("date").alias("p_last_date"), (F.col("before") + F.col("here")).alias("_upto")), "p_last_date")
    rows = rows.join(holes.select(F.col("date").alias("s_first_date"), F.col("before").alias("_before")), "s_first_date")
    gone = latest_version(links, ["symbol_id"], pin).where("reason = 'retraction'").select(F.col("symbol_id").alias("successor"), F.lit(True).alias("_gone"))
    rows = rows.join(gone, "successor", "left")
    rows = rows.withColumns({
        "shared_days": F.coalesce("shared", F.lit(0)),
        "sessions_between": F.greatest(F.col("s_first_n") - F.col("p_last_n") - 1, F.lit(0)),
        "unsettled_between": F.greatest(F.col("_before") - F.col("_upto"), F.lit(0)),
        "days_between": F.datediff("s_first_date", "p_last_date"),
        "ratio": F.when(F.col("p_last_close") != 0, round4(F.col("s_first_close") / F.nullif("p_last_close", F.lit(0.0)))),
    })
    ps, ss = issue_serial("p_isin"), issue_serial("s_isin")
    gates = {
        "g0_equity": F.col("p_isin").startswith("INE") & F.col("s_isin").startswith("INE") & isin_check_ok("p_isin") & isin_check_ok("s_isin"),
        "g1_issuer": issuer_prefix("p_isin") == issuer_prefix("s_isin"),
        "g2_serial": F.coalesce(ss > ps, F.lit(False)),
        "g3_apart": (F.col("p_last_date") < F.col("s_first_date")) & (F.col("shared_days") == 0),
        "g4_no_session": F.col("sessions_between") == 0,
        "g4a_settled": F.col("unsettled_between") == 0,
        "g4b_gap": F.col("days_between").between(1, max_gap_days),
        "g6_ratio": ratio_band("ratio").isNotNull(),
    }
    measured = ("shared_days", "sessions_between", "unsettled_between", "days_between", "ratio")
    return rows.select(
        "predecessor", "successor", "generator", F.col("p_isin").alias("predecessor_isin"), F.col("s_isin").alias("successor_isin"), F.col("p_last_date").alias("last_date"),
        F.col("s_first_date").alias("first_date"), *measured, ratio_band("ratio").alias("band"), issuer_prefix("p_isin").alias("issuer"),
        F.concat(F.lpad(ps.cast("string"), 2, "0"), F.lit("->"), F.lpad(ss.cast("string"), 2, "0")).alias("serial"),
        (isin_check_ok("p_isin") & isin_check_ok("s_isin")).alias("check_digit"), F.col("p_days").alias("predecessor_bars"), F.col("s_days").alias("successor_bars"),
        *[v.alias(k) for k, v in gates.items()], F.coalesce("_gone", F.lit(False)).alias("retracted"),
    )


def enforced(rows: DataFrame) -> DataFrame:
    """Adds G5 (two pairs that pass all else and share a predecessor or a successor both fail) and whether a pair is accepted."""
    alone = ~F.col("retracted")
    for g in GATES:
        alone = alone & F.col(g)
    rows = rows.withColumn("_ok", alone)
    clash = (F.count_if("_ok").over(Window.partitionBy("predecessor")) > 1) | (F.count_if("_ok").over(Window.partitionBy("successor")) > 1)
    return rows.withColumn("g5_path", ~(F.col("_ok") & clash)).withColumn("accepted", F.col("_ok") & F.col("g5_path")).drop("_ok")


def gate_results(
    bars: DataFrame, symbols: DataFrame, links: DataFrame, log: DataFrame, source: str, pin: Pin, max_gap_days: int = MAX_GAP_DAYS, expected: DataFrame | None = None,
    calendar: DataFrame | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """Every candidate with each gate, what it measured, and whether it is accepted.

    expected: the days that must be settled; all calendar days by default. A successor whose latest link is a retraction is quarantined. Last, two accepted
    candidates that share a predecessor or a successor are both rejected. calendar: the kept table of sessions, if there is one. pairs: any pairs
    (predecessor, successor) to look at instead of the candidates. Bars are read once.
    """
    days = sessions(bars if calendar is None else calendar, source, None, None, pin)
    maps = kept(day_maps(bars, source, pin), "maps")
    facts = facts_of(maps, symbols, days, pin)
    looked_at = consecutive(facts) if pairs is None else any_pairs(pairs, facts)
    return enforced(evaluated(looked_at, maps, links, log, source, pin, days, max_gap_days, expected))


def unlinked(cands: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """Candidates that the map does not join, as accepted or quarantined, and as stale those that it joins although they no longer pass. A
    symbol that the map does not know is not joined."""
    m = entity_map(symbols, links, pin)
    rows = cands.select("predecessor", "successor", "accepted")
    for side in ("predecessor", "successor"):
        rows = rows.join(m.select(F.col("symbol_id").alias(side), F.col("entity_id").alias(f"_{side}")), side, "left")
    joined = F.coalesce(F.col("_predecessor") == F.col("_successor"), F.lit(False))
    kind = F.when(joined, "stale").when(F.col("accepted"), "accepted").otherwise("quarantined")
    return rows.where(~(joined & F.col("accepted"))).select("predecessor", "successor", kind.alias("kind"))


def evaluate_pair(gates: DataFrame, predecessor: int, successor: int) -> DataFrame:
    """One pair's gates, one row each, in order, and the first that fails marked. The gates are recorded and not enforced: a person who links the pair by hand
    sees what stands against it. gates: gate_results() with that pair among its pairs."""
    one = gates.where((F.col("predecessor") == predecessor) & (F.col("successor") == successor))
    each = F.posexplode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in (*GATES, "g5_path")])).alias("place", "_g")
    rows = one.select(each).select("place", "_g.gate", "_g.passed")
    first = F.min(F.when(~F.col("passed"), F.col("place"))).over(Window.partitionBy())  # one pair's gates
    return rows.withColumn("first_failure", F.coalesce(F.col("place") == first, F.lit(False)))


def propose(gates: DataFrame, log: DataFrame, source: str, expected: DataFrame | None = None, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Roster links of the accepted candidates, ratios to four places, and how many candidates fail each gate first. While the archive has a hole nothing
    is proposed: a session that was never fetched looks like a holiday."""
    assert_empty(archive_holes(log, source, start, end, expected), "the archive has holes")
    measured = ["predecessor_isin", "successor_isin", "last_date", "first_date", "check_digit", "issuer", "serial", "sessions_between", "unsettled_between", "days_between", "ratio", "band"]
    accepted = gates.where("accepted").select("predecessor", "successor", F.col("first_date").alias("boundary"), F.lit("succession").alias("reason"), F.lit(None).cast("string").alias("note"), *measured)
    failed = F.coalesce(*[F.when(~F.col(g), F.lit(g)) for g in (*GATES, "g5_path")], F.when(F.col("retracted"), "retracted"), F.lit("accepted"))
    return accepted, gates.groupBy(failed.alias("outcome")).agg(F.count(F.lit(1)).alias("candidates"))


def flatness(links: DataFrame, pin: Pin) -> DataFrame:
    """Links whose entity is itself linked to another one."""
    now = latest_version(links, ["symbol_id"], pin).select("symbol_id", "entity_id")
    up = now.select(F.col("symbol_id").alias("entity_id"), F.col("entity_id").alias("next_entity"))
    return now.join(up, "entity_id").where("next_entity <> entity_id").select("symbol_id", "entity_id", "next_entity")


#: About how many bars one task of overlap_days() counts: some 200 MB in an aggregation.
BARS_OF_A_TASK = 1_500_000


def overlap_days(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(entity_id, source, date, members): days on which more than one member of an entity has a bar of one source. Only bars of linked symbols are read.

    At a pin a symbol has one bar of a source and day, so that rows are members. Hardly any two bars share entity, source and day: counting before they move would only
    fill tables as large as the files read. They move once, to more tasks the more bars there are; the members go to the bars, two numbers a symbol."""
    m = entity_map(symbols, links, pin)
    linked = m.where("symbol_id <> entity_id")
    members = m.join(linked.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = latest_version(bars, ["source", "symbol_id", "date"], pin).select("symbol_id", "source", "date").join(F.broadcast(members), "symbol_id")
    tasks = max(bars.sparkSession.sparkContext.defaultParallelism, bars.count() // BARS_OF_A_TASK + 1)  # the count reads the files' footers only
    rows = rows.repartition(tasks, "entity_id", "source", "date")
    return rows.groupBy("entity_id", "source", "date").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def overlaps(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(entity_id, days): entities two of whose members have bars of one source on one day."""
    return overlap_days(bars, symbols, links, pin).groupBy("entity_id").agg(F.count(F.lit(1)).alias("days"))


def violations(bars: DataFrame, symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(kind, entity_id, detail, advisory): all that is wrong with the links at the pin, by kind, entity and detail: entities that lead on to others (flatness), members
    that trade on one day, each source and day (overlap), and, for a person to look at, entities of several issuers (issuer)."""
    hops = F.concat(F.lit("symbol "), F.col("symbol_id").cast("string"), F.lit(" leads to "), F.col("entity_id").cast("string"), F.lit(", which leads to "), F.col("next_entity").cast("string"))
    met = F.concat(F.col("members").cast("string"), F.lit(" members have a bar of "), F.col("source"), F.lit(" on "), F.col("date").cast("string"))
    parts = [
        flatness(links, pin).select(F.lit("flatness").alias("kind"), "entity_id", hops.alias("detail"), F.lit(False).alias("advisory")),
        overlap_days(bars, symbols, links, pin).select(F.lit("overlap").alias("kind"), "entity_id", met.alias("detail"), F.lit(False).alias("advisory")),
        issuers(symbols, links, pin).select(F.lit("issuer").alias("kind"), "entity_id", F.concat(F.lit("issuers "), F.col("issuers")).alias("detail"), F.lit(True).alias("advisory")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("kind", "entity_id", "detail")


def issuers(symbols: DataFrame, links: DataFrame, pin: Pin) -> DataFrame:
    """(entity_id, issuers): entities whose equity members have more than one issuer; for a person to look at."""
    isin = latest_version(symbols, ["symbol_id"], pin).where(F.col("isin").startswith("INE")).select("symbol_id", issuer_prefix("isin").alias("issuer"))
    per = entity_map(symbols, links, pin).join(isin, "symbol_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("issuer")).alias("_i"))
    return per.where(F.size("_i") > 1).select("entity_id", F.array_join("_i", ", ").alias("issuers"))
