"""Schemas of the stored tables. All tables are append-only; ingested_at says when a row came to be believed."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "symbols": "symbol_id bigint, isin string, ticker string, ingested_at timestamp, valid_from date",
    "bars": "symbol_id bigint, date date, source string, ingested_at timestamp, series string, open decimal(14,4), high decimal(14,4), low decimal(14,4), close decimal(14,4), volume bigint, turnover decimal(20,2), delivery_qty bigint, content_hash string, superseded_at timestamp",
    "closings": "source string, symbol_id bigint, date date, ingested_at timestamp, superseded_at timestamp",
    "sessions": "source string, date date, ingested_at timestamp",
    "digests": "source string, date date, rows bigint, lane0 decimal(38,0), lane1 decimal(38,0), lane2 decimal(38,0), lane3 decimal(38,0), ingested_at timestamp",
    "ingest_log": "source string, date date, status string, rows int, note string, fetched_at timestamp",
    "symbol_links": "symbol_id bigint, entity_id bigint, reason string, boundary date, predecessor bigint, evidence string, roster_sha string, seeded_by string, note string, ingested_at timestamp",
    "index_levels": "index_code string, date date, source string, ingested_at timestamp, index_name string, open decimal(14,4), high decimal(14,4), low decimal(14,4), close decimal(14,4), points_change decimal(14,4), pct_change decimal(12,4), volume bigint, turnover decimal(20,2), pe decimal(12,4), pb decimal(12,4), div_yield decimal(12,4), content_hash string",
    "adjustments": "entity_id bigint, ex_date date, source string, ratio decimal(18,8), evidence string, method string, ingested_at timestamp",
    "runs": "run_id string, mode string, strategy string, git_sha string, config_hash string, snapshot_id string, ingest_pin timestamp, period_from date, period_to date, result string, started_at timestamp, finished_at timestamp",
}
KEYS = {
    "symbols": ("symbol_id",),
    "bars": ("source", "symbol_id", "date"),
    "symbol_links": ("symbol_id",),
    "index_levels": ("source", "index_code", "date"),
    "adjustments": ("entity_id", "ex_date", "source"),
}
SOURCES = ("eod2", "nse-bhavcopy")
STATUSES = ("ok", "no-file", "error")
REASONS = ("succession", "manual", "retraction")


def ddl(table: str) -> str:
    return _DDL[table]


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])
