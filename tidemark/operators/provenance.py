"""Digests of what was read, canonical documents, and the ledger of runs."""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS
from .bitemporal import Pin, believed, latest_version


def canonical_json(value) -> str:
    """JSON in one form: keys in UTF-16 order, no spaces, numbers as ECMAScript writes them. NaN and infinities are errors."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical_json(str(k))}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("no canonical form")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text and abs(x) >= 1e-6:
        return text
    mantissa, _, exponent = f"{x:e}".partition("e") if "e" not in text else text.partition("e")
    exp = int(exponent)
    if -7 < exp < 0:
        digits = mantissa.replace(".", "").replace("-", "")
        return ("-" if x < 0 else "") + "0." + "0" * (-exp - 1) + digits.rstrip("0")
    return f"{mantissa.removesuffix('.0')}e{'+' if exp > 0 else '-'}{abs(exp)}"


def digest_of(value) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def group_digests(table: DataFrame, name: str, group: str, content: list[str], pin: Pin) -> DataFrame:
    """(table, part, rows, digest): per group the md5 of its rows' content in order, so that no one string holds the table."""
    rows = latest_version(table, list(KEYS[name]), pin)
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in content])
    per = rows.groupBy(F.col(group).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5(line))), "")).alias("digest"))
    return per.select(F.lit(name).alias("table"), "part", "rows", "digest")


LANES = 4
_FULL = 1 << 60


def lanes_of(digest: str) -> list[Column]:
    """A sha256 in hex as LANES numbers of 60 bits."""
    return [F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)]


def lane_sums(rows: DataFrame, sign: Column | None = None) -> DataFrame:
    """(source, date, rows, lane0, ...): of each part, the number of rows and the sums of their content hashes' lanes; with a sign, rows that leave count
    against those that come. Sums need no order, so a part is never gathered in one place."""
    times = F.lit(1) if sign is None else sign
    signed = rows.select("source", "date", times.cast("bigint").alias("_s"), *lanes_of("content_hash"))
    return signed.groupBy("source", "date").agg(F.sum("_s").alias("rows"), *[F.sum(F.col(f"lane{i}") * F.col("_s")).cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)])


def lane_digest(sums: DataFrame) -> DataFrame:
    """(source, date, rows, digest): each part's lanes, modulo 2**60, in hex. Parts without rows are left out."""
    full = F.lit(_FULL).cast("decimal(38,0)")
    one = lambda i: F.lpad(F.lower(F.hex(F.pmod(F.col(f"lane{i}"), full).cast("bigint"))), 15, "0")
    return sums.where("rows <> 0").select("source", "date", "rows", F.concat(*[one(i) for i in range(LANES)]).alias("digest"))


def lane_parts(bars: DataFrame, pin: Pin) -> DataFrame:
    """The digest of each source and day, from all bars that are believed at the pin."""
    return lane_digest(lane_sums(latest_version(bars, list(KEYS["bars"]), pin)))


def kept_parts(digests: DataFrame, pin: Pin) -> DataFrame:
    """The same from the changes that commits wrote down: a few numbers for each part that a commit touched, so that no bar is read."""
    rows = believed(digests, pin).groupBy("source", "date")
    return lane_digest(rows.agg(F.sum("rows").alias("rows"), *[F.sum(f"lane{i}").cast("decimal(38,0)").alias(f"lane{i}") for i in range(LANES)]))


def year_digests(parts: DataFrame) -> DataFrame:
    """(source, year, rows, digest): the level above the days, over at most 366 of them in order. Two stores whose years agree agree in their days."""
    line = F.concat_ws("|", F.col("date").cast("string"), F.col("rows").cast("string"), "digest")
    per = parts.groupBy("source", F.year("date").alias("year")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(line)).alias("_l"))
    return per.select("source", "year", "rows", F.sha2(F.array_join("_l", ";"), 256).alias("digest"))


def differing_parts(one: DataFrame, other: DataFrame) -> DataFrame:
    """(source, date): days whose digests differ between two stores, or that only one has; only days of years that differ are compared."""
    years = [year_digests(x).select("source", "year", "digest") for x in (one, other)]
    apart = years[0].exceptAll(years[1]).union(years[1].exceptAll(years[0])).select("source", "year").distinct()
    days = [x.withColumn("year", F.year("date")).join(apart, ["source", "year"], "left_semi").select("source", "date", "digest") for x in (one, other)]
    return days[0].exceptAll(days[1]).union(days[1].exceptAll(days[0])).select("source", "date").distinct()


def table_digests(parts: DataFrame) -> DataFrame:
    """(table, rows, digest): the sha256 over a table's parts in order."""
    listed = F.array_sort(F.collect_list(F.concat_ws("|", "part", F.col("rows").cast("string"), "digest")))
    return parts.groupBy("table").agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(listed, ";"), 256).alias("digest"))


def snapshot_parts(bars: DataFrame, symbols: DataFrame, links: DataFrame, levels: DataFrame, adjustments: DataFrame, pin: Pin) -> DataFrame:
    """The digests of all tables that can change an answer, actions among them: dated tables by date, others by ranges of
    a thousand ids, so that parts grow in number and not in size."""
    parts = [
        group_digests(bars, "bars", "date", ["source", "symbol_id", "series", "open", "high", "low", "close", "volume", "turnover", "delivery_qty"], pin),
        group_digests(levels, "index_levels", "date", ["source", "index_code", "index_name", "close"], pin),
        group_digests(symbols.withColumn("_g", F.expr("symbol_id div 1000")), "symbols", "_g", ["symbol_id", "isin", "ticker", "valid_from"], pin),
        group_digests(links.withColumn("_g", F.expr("symbol_id div 1000")), "symbol_links", "_g", ["symbol_id", "entity_id", "reason", "boundary", "predecessor"], pin),
        group_digests(adjustments.withColumn("_g", F.expr("entity_id div 1000")), "adjustments", "_g", ["entity_id", "ex_date", "source", "ratio"], pin),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_id(digests: DataFrame) -> str:
    """One digest over the few rows of table_digests()."""
    rows = sorted((r["table"], r["rows"], r["digest"]) for r in digests.collect())
    return hashlib.sha256("\n".join(f"{t}|{n}|{d}" for t, n, d in rows).encode()).hexdigest()


def run_row(spark: SparkSession, mode: str, strategy: str, config: dict, snapshot: str, pin: str, period: tuple[str, str], result: dict, started: str, finished: str, git_sha: str = "") -> DataFrame:
    """One row of the ledger of runs, written once, when the run is over."""
    row = (str(uuid.uuid4()), mode, strategy, git_sha, digest_of(config), snapshot, pin, *period, canonical_json(result), started, finished)
    df = spark.createDataFrame([row], "run_id string, mode string, strategy string, git_sha string, config_hash string, snapshot_id string, ingest_pin string, period_from string, period_to string, result string, started_at string, finished_at string")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("ingest_pin", "started_at", "finished_at")} | {c: F.col(c).cast("date") for c in ("period_from", "period_to")})


def prior_runs(runs: DataFrame, config_hash: str) -> DataFrame:
    """Earlier runs of a configuration, the latest first."""
    return runs.where(F.col("config_hash") == config_hash).orderBy(F.desc("finished_at"), "run_id")


def holdout_runs(runs: DataFrame, holdout: str) -> DataFrame:
    """Runs whose period reached into the holdout."""
    return runs.where(F.col("period_to") >= F.lit(holdout).cast("date")).orderBy("finished_at", "run_id")


def roster_digests(links: DataFrame, pin: Pin) -> DataFrame:
    rows = links if pin is None else links.where(F.col("ingested_at") <= F.lit(pin).cast("timestamp"))
    return rows.where("roster_sha is not null").select("roster_sha").distinct().orderBy("roster_sha")
