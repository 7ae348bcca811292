"""Where the files of a session are, and which days are worth asking for. Fetching itself is left to the caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_SWITCH, FIRST_EQUITY, FIRST_INDEX, MOST_ERRORS = date(2024, 7, 8), date(1994, 11, 3), date(2012, 2, 1), 5
INDIA = timezone(timedelta(hours=5, minutes=30))


def equity_file(day: date) -> str:
    """The archive's file name: one format before the switch, another from it."""
    if day >= FORMAT_SWITCH:
        return f"BhavCopy_NSE_CM_0_0_0_{day:%Y%m%d}_F_0000.csv.zip"
    return f"{day:%Y}/{day:%b}".upper() + f"/cm{day:%d}{day:%b}{day:%Y}bhav.csv.zip".replace(f"{day:%b}", f"{day:%b}".upper())


def index_file(day: date) -> str:
    return f"ind_close_all_{day:%d%m%Y}.csv"


def looks_like_index_file(body: bytes) -> bool:
    """Some servers answer a missing file with a page; a real one begins with its header."""
    return body.lstrip(b"\xef\xbb\xbf \r\n").startswith(b"Index Name,")


def settles_without_file(day: date, now: datetime) -> bool:
    """A missing file is final 24 hours after the day has ended in India."""
    end = datetime(day.year, day.month, day.day, tzinfo=INDIA) + timedelta(days=1)
    return now >= end + timedelta(hours=24)


def days_to_fetch(spark: SparkSession, log: DataFrame, source: str, start: date, end: date, first: date = FIRST_EQUITY, refetch: bool = False) -> DataFrame:
    """The days from start to end that no settled fetch has covered, in order; all of them if refetch."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(max(start, first)), F.lit(end))).alias("date")) if end >= max(start, first) else spark.createDataFrame([], "date date")
    done = log.where((F.col("source") == source) & F.col("status").isin("ok", "no-file")).select("date").distinct()
    return (days if refetch else days.join(done, "date", "left_anti")).orderBy("date")


@dataclass
class Fetched:
    date: date
    status: str
    rows: int = 0
    note: str = ""


def walk_days(days: list[date], fetch: Callable[[date], bytes | None], store: Callable[[date, bytes], int], now: Callable[[], datetime]) -> list[Fetched]:
    """Fetches and stores day by day. No file settles the day once that is final; five errors in a row end the walk."""
    out: list[Fetched] = []
    errors = 0
    for d in days:
        try:
            body = fetch(d)
            if body is None:
                if settles_without_file(d, now()):
                    out.append(Fetched(d, "no-file"))
                continue
            out.append(Fetched(d, "ok", store(d, body)))
            errors = 0
        except Exception as e:
            errors += 1
            out.append(Fetched(d, "error", 0, str(e)[:500]))
            if errors >= MOST_ERRORS:
                raise RuntimeError(f"{errors} errors in a row, the last on {d}: {e}") from e
    return out
