"""Appending to the store: only what is new or changed, with symbols minted for new identifiers. A lock keeps it to one writer at a time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.bitemporal import EVER, latest_version
from ..operators.checks import assert_empty
from ..operators.hashing import bar_hash, index_hash
from ..operators.provenance import lane_sums
from ..operators.roster import assert_flat, plan_links, validate_roster
from ..schemas import REASONS, STATUSES, schema
from ..functions.aliases import with_code
from ..sources.addresses import FIRST_EQUITY, FIRST_INDEX, MOST_ERRORS, days_to_fetch, index_file, looks_like_index_file, walk_days
from ..sources.archives import equity_bars, index_levels, index_lines
from ..sources.members import batch_files, lines
from .commits import Commit, commit, read_folders, state
from .storage import kept, session_days, write_bytes


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table (at <root>/<table>) as the last commit left it, or an empty one where nothing has been written yet. Bars come with superseded_at in
    force: their own, or that of a closing which is not folded into them yet."""
    root = path.rstrip("/").removesuffix(f"/{table}")
    _, held = state(spark, root)
    rows = read_folders(spark, root, table, held.get(table, []))
    if table != "bars" or not held.get("closings"):
        return rows
    return closed(rows, read_folders(spark, root, "closings", held["closings"]))


def closed(bars: DataFrame, closings: DataFrame) -> DataFrame:
    """Bars with the closings of a delta beside them."""
    key = ["source", "symbol_id", "date", "ingested_at"]
    late = closings.select(*key, F.col("superseded_at").alias("_closed"))
    return bars.join(late, key, "left").withColumn("superseded_at", F.coalesce("superseded_at", "_closed")).select(*bars.columns)


def fold(spark: SparkSession, root: str) -> int:
    """Writes the closings into the bars that they close and drops the delta; only sources and years with closings are rewritten. Returns their number."""
    with commit(spark, root) as c:
        delta = c.held.get("closings", [])
        touched = {tuple(f.split("/")[1:]) for f in delta}
        folders = [f for f in c.held.get("bars", []) if tuple(f.split("/")[1:]) in touched]
        if folders:
            c.append("bars", closed(read_folders(spark, root, "bars", folders), c.read("closings")))
            c.remove("bars", folders)
        c.remove("closings", delta)
        return len(touched)


def one_of_each(rows: DataFrame, key: list[str], digest: str = "content_hash") -> DataFrame:
    """Drops repeated rows of a batch; two different rows of one key are an error."""
    assert_empty(rows.groupBy(*key).agg(F.countDistinct(digest).alias("contents")).where("contents > 1"), "conflicting rows in one batch")
    return rows.dropDuplicates(key)


def changed(rows: DataFrame, stored: DataFrame, key: list[str], digest: str = "content_hash") -> DataFrame:
    """The rows whose content is not that of the latest stored version."""
    now = latest_version(stored, key, None).select(*key, F.col(digest).alias("_h"))
    return rows.join(now, key, "left").where(~F.col(digest).eqNullSafe(F.col("_h"))).drop("_h")


def new_symbols(batch: DataFrame, symbols: DataFrame, at: str) -> DataFrame:
    """Symbol rows that a batch of bars (isin, ticker, date) adds: an id for each unknown ISIN in order of the ISIN, and a version where the
    ticker of the batch's latest day differs from the one in force then. A blank ISIN or a missing date is an error."""
    assert_empty(batch.where("isin is null or trim(isin) = '' or date is null").select("isin", "ticker", "date"), "bars without ISIN or date")
    named = batch.groupBy("isin").agg(F.max_by("ticker", F.struct("date", "ticker")).alias("ticker"), F.max("date").alias("_day"))
    top = symbols.agg(F.coalesce(F.max("symbol_id"), F.lit(0)).alias("_top"))
    known = symbols.select("isin", "symbol_id").distinct()
    fresh = named.join(known, "isin", "left_anti").withColumn("_group", F.substring("isin", 1, 8))
    # Numbers go on from group to group, and within a group of one issuer's neighbours by ISIN: no task sorts all identifiers.
    sizes = fresh.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_group", (F.sum("_size").over(Window.orderBy("_group")) - F.col("_size")).alias("_before"))
    fresh = fresh.join(before, "_group").crossJoin(F.broadcast(top))  # one row
    place = F.row_number().over(Window.partitionBy("_group").orderBy("isin"))
    fresh = fresh.select((F.col("_top") + F.col("_before") + place).alias("symbol_id"), "isin", "ticker", F.lit(EVER).cast("date").alias("valid_from"))
    versions = symbols.join(named.select("isin", F.col("ticker").alias("_ticker"), "_day"), "isin")
    in_force = Window.partitionBy("symbol_id").orderBy(F.desc(F.col("valid_from") <= F.col("_day")), F.when(F.col("valid_from") <= F.col("_day"), F.col("valid_from")).desc_nulls_last(), "valid_from", F.desc("ingested_at"))
    moved = versions.withColumn("_r", F.row_number().over(in_force)).where("_r = 1 and ticker <> _ticker").select("symbol_id", "isin", F.col("_ticker").alias("ticker"), F.col("_day").alias("valid_from"))
    return fresh.unionByName(moved).select("symbol_id", "isin", "ticker", F.lit(at).cast("timestamp").alias("ingested_at"), "valid_from")


def insert_bars(spark: SparkSession, root: str, source: str, batch: DataFrame, at: str) -> int:
    """Registers symbols and appends the bars of a batch that are new or changed, by source and year, all in one commit. Writing a batch again adds
    nothing. Returns the rows added.

    Only stored bars of the batch's years and days are read. A changed bar closes the version before it; a batch that is older than the version it would
    close is an error. New sessions go into the kept table of sessions."""
    key = ["source", "symbol_id", "date"]
    with commit(spark, root) as c:
        symbols = c.read("symbols")
        minted = c.append("symbols", new_symbols(batch, symbols, at))
        ids = symbols.unionByName(minted).select("isin", "symbol_id").distinct()
        rows = batch.join(ids, "isin").withColumn("source", F.lit(source))
        for col, kind in (("delivery_qty", "bigint"), ("turnover", "decimal(20,2)")):
            if col not in rows.columns:
                rows = rows.withColumn(col, F.lit(None).cast(kind))
        rows = one_of_each(rows.withColumn("content_hash", bar_hash()), key)
        now = stored_beside(c, batch, source).select(*key, F.col("content_hash").alias("_h"), F.col("ingested_at").alias("_since"))
        names = [f.name for f in schema("bars").fields]
        moment = F.lit(at).cast("timestamp")
        found = rows.join(now, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("_h"))).withColumns({"ingested_at": moment, "superseded_at": F.lit(None).cast("timestamp")})
        found = found.select(*names, "_since", "_h").persist()
        try:
            assert_empty(found.where(F.col("_since") >= moment).select(*key), "a batch that is older than what it changes")
            n, closes = found.agg(F.count(F.lit(1)), F.count("_since")).first()
            if n:
                c.append("bars", found.select(*names))
                # What the parts' digests change by: new contents come, closed ones leave.
                moved = F.explode(F.array(F.struct("content_hash", F.lit(1).alias("sign")), F.struct(F.col("_h").alias("content_hash"), F.lit(-1).alias("sign"))))
                change = found.select("source", "date", moved.alias("_m")).select("source", "date", "_m.*").where("content_hash is not null")
                c.append("digests", lane_sums(change, F.col("sign")).withColumn("ingested_at", moment))
                days = session_days(found).join(c.read("sessions").where(F.col("source") == source).select("source", "date"), ["source", "date"], "left_anti")
                c.append("sessions", days)
            if closes:
                c.append("closings", found.where("_since is not null").select(*key, F.col("_since").alias("ingested_at"), moment.alias("superseded_at")))
        finally:
            found.unpersist()
    return n


def stored_beside(c: Commit, batch: DataFrame, source: str) -> DataFrame:
    """The open versions of a source's stored bars between a batch's first and last day, of its years only: what an insert reads does not grow with the store."""
    years, lo, hi = batch.agg(F.collect_set(F.year("date")), F.min("date"), F.max("date")).first()  # a few years
    inside = (F.col("source") == source) & F.col("year").isin(years) & F.col("date").between(F.lit(lo), F.lit(hi))
    bars = c.read("bars").where(inside)
    if c.held.get("closings"):
        bars = closed(bars, c.read("closings").where(inside))
    return bars.where("superseded_at is null")


def insert_index_levels(spark: SparkSession, root: str, source: str, batch: DataFrame, at: str) -> int:
    """Appends index levels (with index_code) that are new or changed, compared on every day of the batch. A code twice on a day is an error."""
    key = ["source", "index_code", "date"]
    rows = batch.withColumn("source", F.lit(source))
    for f in schema("index_levels").fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            rows = rows.withColumn(f.name, F.col(f.name).cast(f.dataType))
    rows = rows.withColumn("content_hash", index_hash())
    assert_empty(rows.groupBy(*key).count().where("count > 1"), "an index twice on a day")
    with commit(spark, root) as c:
        lo, hi = rows.agg(F.min("date"), F.max("date")).first()
        stored = c.read("index_levels").where((F.col("source") == source) & F.col("date").between(F.lit(lo), F.lit(hi)))
        return _append_as(changed(rows, stored, key).withColumn("ingested_at", F.lit(at).cast("timestamp")), c, "index_levels")


def changed_actions(found: DataFrame, stored: DataFrame, step: float = 1e-8) -> DataFrame:
    """Detected actions (entity_id, ex_date, source, ratio) that are new or whose ratio moved by at least `step`. Ratios of 1 or not above 0 are errors."""
    assert_empty(found.where("ratio <= 0 or ratio = 1"), "a ratio that changes nothing")
    now = latest_version(stored, ["entity_id", "ex_date", "source"], None).select("entity_id", "ex_date", "source", F.col("ratio").cast("double").alias("_r"))
    return found.join(now, ["entity_id", "ex_date", "source"], "left").where(F.col("_r").isNull() | (F.abs(F.col("ratio").cast("double") - F.col("_r")) >= step)).drop("_r")


def log_rows(spark: SparkSession, source: str, fetched: list, at: str) -> DataFrame:
    """Rows of the ingest log of a walk over days."""
    if bad := {f.status for f in fetched} - set(STATUSES):
        raise ValueError(f"unknown status {sorted(bad)}")
    rows = [(source, f.date, f.status, f.rows, f.note) for f in fetched]
    return spark.createDataFrame(rows, "source string, date date, status string, rows int, note string").withColumn("fetched_at", F.lit(at).cast("timestamp"))


def insert_actions(spark: SparkSession, root: str, found: DataFrame, at: str) -> int:
    """Appends detected actions that are new or changed. Returns the rows added."""
    with commit(spark, root) as c:
        return _append_as(changed_actions(found, c.read("adjustments")).withColumn("ingested_at", F.lit(at).cast("timestamp")), c, "adjustments")


def insert_links(spark: SparkSession, root: str, planned: DataFrame) -> int:
    """Appends planned links or retractions (see identity.plan_links and plan_retraction) after a look that the map stays flat. Returns the rows added."""
    known = F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))
    own = F.col("symbol_id") == F.col("entity_id")
    shaped = F.when(F.col("reason") == "retraction", own & F.col("boundary").isNull() & F.col("predecessor").isNull()).otherwise(~own & F.col("boundary").isNotNull() & F.col("predecessor").isNotNull())
    assert_empty(planned.where(~known | ~shaped), "no proper link")
    with commit(spark, root) as c:
        assert_flat(c.read("symbol_links"), planned)
        return _append_as(planned, c, "symbol_links")


class Applied(NamedTuple):
    """What applying a roster adds, as rows, how many links stood already, and whether they were written."""

    rows: DataFrame
    skipped: int
    written: bool


def apply_roster(spark: SparkSession, root: str, roster: DataFrame, digest: str, seeded_by: str, at: str, dry_run: bool = False) -> Applied:
    """Validates a roster with its gates, plans its links, looks that the map stays flat and appends them, all under one commit. Without a digest, which says where an
    irreversible merge came from, nothing is written. A dry run does all but write."""
    validate_roster(roster, gates=True)
    if not digest:
        raise ValueError("a roster without a digest is not applied")
    with commit(spark, root) as c:
        links = c.read("symbol_links")
        planned = kept(plan_links(roster, links, at, seeded_by, digest, c.read("symbols")), "planned")
        assert_flat(links, planned)
        n = planned.count()
        if n and not dry_run:
            _append_as(planned, c, "symbol_links")
        return Applied(planned, roster.count() - n, bool(n) and not dry_run)


def log_days(spark: SparkSession, root: str, source: str, fetched: list, at: str) -> int:
    """Appends a walk over days to the ingest log."""
    if not fetched:
        return 0
    with commit(spark, root) as c:
        return _append_as(log_rows(spark, source, fetched, at), c, "ingest_log")


def record_run(spark: SparkSession, root: str, row: DataFrame) -> int:
    """Appends one run to the ledger; see provenance.run_row."""
    with commit(spark, root) as c:
        return _append_as(row, c, "runs")


def _append_as(df: DataFrame, c: Commit, table: str) -> int:
    """Appends rows in the stored schema; columns that they lack are null."""
    fields = schema(table).fields
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).persist()
    n = rows.count()
    if n:
        c.append(table, rows)
    rows.unpersist()
    return n


Fetch = Callable[[date], bytes | None]


def backfill(spark: SparkSession, root: str, source: str, start: date, end: date, fetch: Fetch, now: Callable[[], datetime], refetch: bool = False, first: date = FIRST_EQUITY) -> list:
    """Fetches, unpacks, parses, inserts and logs every day from start to end, not before the archive's first, that the log does not have as settled. fetch(day) gives a zip file or a
    CSV, or None where there is no file. Days done before an error stay logged, so that the walk can be taken up again."""

    def store(day: date, body: bytes) -> int:
        path = f"{root}/incoming/{source}-{day:%Y%m%d}.csv"
        write_bytes(spark, path, body)
        bars = equity_bars(spark, path).drop("file")
        assert_empty(bars.where(F.col("date") != F.lit(day)).select("date", "ticker"), f"rows of another day than {day}")
        return insert_bars(spark, root, source, bars, f"{now():%Y-%m-%d %H:%M:%S}")

    return _walk(spark, root, source, start, end, fetch, store, now, refetch, first)


def index_backfill(spark: SparkSession, root: str, source: str, start: date, end: date, fetch: Fetch, now: Callable[[], datetime], refetch: bool = False, first: date = FIRST_INDEX) -> list:
    """The same for index files. A page in place of a file counts as no file. Names that stand more than once in a session are left out of it, and the log's note
    says so."""
    notes: dict[date, str] = {}

    def found(day: date) -> bytes | None:
        body = fetch(day)
        return body if body is not None and looks_like_index_file(body) else None

    def store(day: date, body: bytes) -> int:
        path = f"{root}/incoming/{source}-{index_file(day)}"
        write_bytes(spark, path, body)
        levels, twice = index_levels(index_lines(lines(batch_files(spark, path))))
        names = twice.collect()  # the names of one session
        notes[day] = "; ".join(f"{r['index_name']!r} stands {r['copies']} times; all copies left out" for r in names)
        return insert_index_levels(spark, root, source, with_code(levels), f"{now():%Y-%m-%d %H:%M:%S}")

    return _walk(spark, root, source, start, end, found, store, now, refetch, first, notes)


def _walk(spark, root, source, start, end, fetch, store, now, refetch, first, notes=None) -> list:
    todo = [r["date"] for r in days_to_fetch(spark, read(spark, f"{root}/ingest_log", "ingest_log"), source, start, end, first=first, refetch=refetch).collect()]
    done: list = []
    try:
        for day in todo:
            done += walk_days([day], fetch, store, now)
            if notes and done and done[-1].date == day and done[-1].status == "ok":
                done[-1].note = notes.get(day, "")
            if len(done) >= MOST_ERRORS and all(f.status == "error" for f in done[-MOST_ERRORS:]):
                raise RuntimeError(f"{MOST_ERRORS} errors in a row, the last on {day}: {done[-1].note}")
    finally:
        log_days(spark, root, source, done, f"{now():%Y-%m-%d %H:%M:%S}")
    return done
