"""Domain tables derived from the synthetic order tables: a weekly market with splits, reissued identifiers, renames,
corrections, delistings and an index. STAGING is one list of SQL steps that Spark and the checking engine both read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.actions import detect
from ..operators.hashing import bar_hash
from ..schemas import KEYS
from .storage import append, new_path, read_bars, session_days, with_validity, write_bars

PIN_OLD, PIN, PIN_NEW = "2001-01-01", "2003-01-01", "2006-01-01"


def _check_digit(digits: str, n: int) -> str:
    """SQL for the check digit after n digits, the last of them doubled, then every second one."""
    parts = []
    for i in range(1, n + 1):
        d = f"CAST(substr({digits}, {i}, 1) AS INT)"
        parts.append(f"(CASE WHEN {d} >= 5 THEN {d} * 2 - 9 ELSE {d} * 2 END)" if (n - i) % 2 == 0 else d)
    return f"CAST((10 - ({' + '.join(parts)}) % 10) % 10 AS STRING)"


#: Digits of an ISIN: issuers are numbers of up to six digits.
_BODY = "concat(CASE WHEN s % 13 = 6 THEN '182315' ELSE '182314' END, lpad(CAST(s AS STRING), 6, '0'), serial)"
STAGING: list[tuple[str, str]] = [
    ("cal", "SELECT d, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS n FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem)"),
    ("weekly", "SELECT l_suppkey AS s, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS val FROM lineitem GROUP BY 1, 2"),
    ("priced", "SELECT s, w.d, n, qty, val, CAST(floor(CAST(sum(val) OVER (PARTITION BY s ORDER BY w.d) AS DOUBLE) / CAST(sum(qty) OVER (PARTITION BY s ORDER BY w.d) AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS p FROM weekly w JOIN cal ON w.d = cal.d"),
    ("plan", "SELECT s, name, ex, CASE s % 4 WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 15 END AS r10, ex + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS reissue FROM (SELECT s_suppkey AS s, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 120 + s_suppkey % 60 END AS ex FROM supplier)"),
    ("quoted", "SELECT priced.s, d, n, CAST(qty AS BIGINT) AS volume, CAST(val AS DECIMAL(20,2)) AS turnover, p, CASE WHEN n < ex THEN p * r10 {div} 10 ELSE p END AS raw, CASE WHEN n >= reissue THEN 2 * priced.s + 1 ELSE 2 * priced.s END AS symbol_id FROM priced JOIN plan ON priced.s = plan.s"),
    ("versions", "SELECT symbol_id, d AS date, 'nse-bhavcopy' AS source, d + INTERVAL 1 DAY AS ingested_at, CASE WHEN s % 11 = 4 AND n % 10 = 0 THEN 'BE' ELSE 'EQ' END AS series, raw AS px, volume, turnover FROM quoted WHERE NOT (s % 7 = 3 AND n > 250)"
     " UNION ALL SELECT symbol_id, d, 'nse-bhavcopy', DATE '2005-01-01', CASE WHEN s % 11 = 4 AND n % 10 = 0 THEN 'BE' ELSE 'EQ' END, raw * 101 {div} 100, volume, turnover FROM quoted WHERE (s + n) % 17 = 0 AND NOT (s % 7 = 3 AND n > 250)"
     " UNION ALL SELECT symbol_id, d, 'eod2', d + INTERVAL 1 DAY, 'EQ', p, volume, CAST(NULL AS DECIMAL(20,2)) FROM quoted WHERE s % 7 <> 3"),
    ("bars", "SELECT symbol_id, date, source, CAST(ingested_at AS TIMESTAMP) AS ingested_at, series, CAST(px / 10000.0 AS DECIMAL(14,4)) AS open, CAST(px / 10000.0 AS DECIMAL(14,4)) AS high, CAST(px / 10000.0 AS DECIMAL(14,4)) AS low, CAST(px / 10000.0 AS DECIMAL(14,4)) AS close, volume, turnover, CAST(NULL AS BIGINT) AS delivery_qty FROM versions"),
    ("reissued", "SELECT plan.s, name, min(d) AS first_day FROM plan JOIN quoted ON plan.s = quoted.s AND symbol_id = 2 * plan.s + 1 GROUP BY plan.s, name"),
    ("issues", "SELECT s, name, 2 * s AS symbol_id, '01' AS serial, DATE '1995-01-01' AS known FROM plan UNION ALL SELECT s, name, 2 * s + 1, '02', CAST(first_day + INTERVAL 1 DAY AS DATE) FROM reissued"),
    ("named", f"SELECT symbol_id, s, name, known, concat(CASE WHEN s % 13 = 6 THEN 'INF' ELSE 'INE' END, lpad(CAST(s AS STRING), 6, '0'), serial, {_check_digit(_BODY, 14)}) AS isin FROM issues"),
    ("symbols", "SELECT symbol_id, isin, name AS ticker, CAST(known AS TIMESTAMP) AS ingested_at, DATE '0001-01-01' AS valid_from FROM named UNION ALL SELECT symbol_id, isin, concat(name, '-R'), CAST(d + INTERVAL 1 DAY AS TIMESTAMP), d FROM named JOIN cal ON n = 200 WHERE s % 17 = 0"),
    ("symbol_links", "SELECT 2 * s + 1 AS symbol_id, 2 * s AS entity_id, 'succession' AS reason, first_day AS boundary, 2 * s AS predecessor, TIMESTAMP '2002-06-01 00:00:00' AS ingested_at FROM reissued"
     " UNION ALL SELECT 2 * s + 1, 2 * s + 1, 'retraction', CAST(NULL AS DATE), CAST(NULL AS BIGINT), TIMESTAMP '2004-01-01 00:00:00' FROM reissued WHERE s % 35 = 0"),
    ("index_days", "SELECT CAST(o_orderdate AS DATE) AS d, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS k FROM orders GROUP BY 1"),
    ("index_levels", "SELECT 'NIFTYX' AS index_code, d AS date, 'nse-index' AS source, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS ingested_at, CASE WHEN d < DATE '1998-01-01' THEN 'Nifty  X' ELSE 'NIFTY X 50' END AS index_name, CAST(floor(CAST(sum(total) OVER (ORDER BY d) AS DOUBLE) / CAST(sum(k) OVER (ORDER BY d) AS DOUBLE) * 100 + 0.5) / 100.0 AS DECIMAL(14,4)) AS close FROM index_days WHERE d NOT BETWEEN DATE '1999-03-01' AND DATE '1999-03-12'"),
    ("ingest_log", "SELECT 'nse-bhavcopy' AS source, d AS date, CASE WHEN n % 97 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS fetched_at FROM cal WHERE n % 61 <> 30"),
]


@dataclass
class Tables:
    """The stored tables of one folder, lazily read."""

    cal: DataFrame
    bars: DataFrame
    symbols: DataFrame
    symbol_links: DataFrame
    index_levels: DataFrame
    ingest_log: DataFrame
    sessions: DataFrame
    adjustments: DataFrame


_STORED: dict[tuple[str, str], str] = {}
_INPUTS = ("lineitem", "orders", "supplier")
_KEPT = ("cal", "symbols", "symbol_links", "index_levels", "ingest_log")


def steps(engine_div: str, stored: dict[str, str] | None = None) -> str:
    """The steps as one WITH clause; a step named in `stored` is replaced by reading that relation."""
    return "WITH " + ", ".join(f"{name} AS ({f'SELECT * FROM {stored[name]}' if stored and name in stored else sql.replace('{div}', engine_div)})" for name, sql in STAGING)


def _relation(spark: SparkSession, sf_dir: str, stored: dict[str, str], name: str, lines_by: str = "") -> DataFrame:
    """A step as rows. lines_by: the column by whose values order lines are dealt out before anything else, for steps that group and sort by nothing wider."""
    placed = {"lineitem": f"/*+ REPARTITION({lines_by}) */ "} if lines_by else {}
    inputs = ", ".join(f"{k} AS (SELECT {placed.get(k, '')}* FROM parquet.`{sf_dir}/{k}.parquet`)" for k in _INPUTS)
    return spark.sql(f"{steps('div', stored).replace('WITH ', f'WITH {inputs}, ', 1)} SELECT * FROM {name}")


def stage(spark: SparkSession, sf_dir: str) -> Tables:
    """Derives and stores the tables once a session and folder, bars by source and year, and opens them.

    Rows move twice: order lines by supplier, within which weeks and running sums lie, and versions of bars by symbol, within which their keys lie. Everything else is
    joined to what is small. Content hashes follow from the other columns and are twice as long as these, so that they are made as they are read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = new_path(spark, "market")
        append(_relation(spark, sf_dir, {}, "cal"), f"{path}/cal")
        stored = {"cal": f"parquet.`{path}/cal`"}
        _relation(spark, sf_dir, stored, "quoted", "l_suppkey").write.parquet(f"{path}/quoted")
        stored["quoted"] = f"parquet.`{path}/quoted`"
        by_symbol = {"versions": f"(SELECT /*+ REPARTITION(symbol_id) */ * FROM ({dict(STAGING)['versions'].replace('{div}', 'div')}))"}
        bars = with_validity(_relation(spark, sf_dir, stored | by_symbol, "bars"), list(KEYS["bars"]))
        write_bars(bars, f"{path}/bars", placed=True)
        append(session_days(read_bars(spark, f"{path}/bars")), f"{path}/sessions")
        for name in _KEPT:
            if name not in stored:
                append(_relation(spark, sf_dir, stored, name), f"{path}/{name}")
        opened = _open(spark, path)
        found = detect(opened["bars"], opened["symbols"], opened["symbol_links"], PIN).where("outcome = 'share action'")
        found = found.select("entity_id", "ex_date", F.lit("eod2-ratio-step").alias("source"), F.col("exact").cast("decimal(18,8)").alias("ratio"), F.lit("2002-07-01").cast("timestamp").alias("ingested_at"))
        append(found, f"{path}/adjustments")
        _STORED[key] = path
    opened = _open(spark, _STORED[key])
    return Tables(**opened, adjustments=spark.read.parquet(f"{_STORED[key]}/adjustments"))


def _open(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{path}/{k}") for k in (*_KEPT, "sessions")} | {"bars": read_bars(spark, f"{path}/bars").withColumn("content_hash", bar_hash())}
