"""Index names and the codes they stand for."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import plain_name, slug

#: The names each index has gone by. (code, name, first day or None, day it stopped or None)
ALIASES: list[tuple[str, str, date | None, date | None]] = [
    ("NIFTY50", "S&P CNX Nifty", None, None),
    ("NIFTY50", "CNX Nifty", None, None),
    ("NIFTY50", "Nifty 50", None, None),
    ("NIFTYNEXT50", "CNX Nifty Junior", None, None),
    ("NIFTYNEXT50", "Nifty Next 50", None, None),
    ("NIFTY100", "CNX 100", None, None),
    ("NIFTY100", "Nifty 100", None, None),
    ("NIFTY200", "CNX 200", None, None),
    ("NIFTY200", "Nifty 200", None, None),
    ("NIFTY500", "S&P CNX 500", None, None),
    ("NIFTY500", "CNX 500", None, None),
    ("NIFTY500", "Nifty 500", None, None),
    ("NIFTYBANK", "CNX Bank", None, None),
    ("NIFTYBANK", "Nifty Bank", None, None),
    ("NIFTYMIDCAP100", "CNX Midcap", None, None),
    ("NIFTYMIDCAP100", "Nifty Midcap 100", None, None),
]


def alias_frame(spark: SparkSession, aliases=ALIASES) -> DataFrame:
    return spark.createDataFrame(list(aliases), "code string, name string, since date, until date")


def with_code(df: DataFrame, name: str = "index_name", day: str = "date", aliases: DataFrame | None = None) -> DataFrame:
    """Adds index_code: the code whose alias is in force on the day (first day included, last not), else the name's letters and digits."""
    known = alias_frame(df.sparkSession) if aliases is None else aliases
    known = known.select("code", plain_name("name").alias("_plain"), "since", "until")
    on: Column = (plain_name(F.col(name)) == F.col("_plain")) & (F.col("since").isNull() | (F.col(day) >= F.col("since"))) & (F.col("until").isNull() | (F.col(day) < F.col("until")))
    return df.join(known, on, "left").withColumn("index_code", F.coalesce("code", slug(name))).drop("code", "_plain", "since", "until")
