"""Where stored tables live and how they are laid out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    A local session without it, as in tests, gets a folder of its own; a cluster must name one.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its plan runs once, however often it is used, and a lost executor does not bring it back."""
    path = new_path(df.sparkSession, name)
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bars(df: DataFrame, path: str, mode: str = "append", placed: bool = False) -> None:
    """Bars by source and year, so that a source and a window of dates prune to few files; within a file by date. A year of a source is one task's only while it is
    small: a larger one is dealt out to several. placed: the rows lie in partitions already that are small enough, as in a bulk load; each of them writes its own files."""
    rows = df.withColumn("year", F.year("date"))
    rows = rows if placed else rows.hint("rebalance", "source", "year")
    rows.sortWithinPartitions("source", "year", "date", "symbol_id").write.mode(mode).partitionBy("source", "year").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """The only way rows get into a table: there is no update and no delete. Small tables become one file."""
    df.hint("rebalance").write.mode("append").parquet(path)


def with_validity(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds superseded_at, when the next version of a key came to be believed; null for the last. For a bulk load; inserts keep it up by closings."""
    return rows.withColumn("superseded_at", F.lead("ingested_at").over(Window.partitionBy(*key).orderBy("ingested_at")))


def session_days(bars: DataFrame) -> DataFrame:
    """(source, date, ingested_at): each session and when its first bar came to be believed. Sessions at any pin are a filter on it."""
    return bars.groupBy("source", "date").agg(F.min("ingested_at").alias("ingested_at"))


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file in the store's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
