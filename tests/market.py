"""Small stores written by hand."""

from datetime import date, timedelta

from pyspark.sql import functions as F

LINK = "symbol_id bigint, entity_id bigint, reason string, boundary string, predecessor bigint, ingested_at string"


def weekdays(start: str, n: int) -> list[str]:
    out, d = [], date.fromisoformat(start)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d.isoformat())
        d += timedelta(days=1)
    return out


def bars(spark, rows, source="nse-bhavcopy"):
    """rows: (symbol_id, date, close) or with ingested_at and series."""
    full = [(s, d, c, *(more or [f"{d} 20:00:00", "EQ"])) for s, d, c, *more in rows]
    df = spark.createDataFrame(full, "symbol_id bigint, date string, close double, ingested_at string, series string")
    price = F.col("close").cast("decimal(14,4)")
    return df.select(
        "symbol_id", F.col("date").cast("date"), F.lit(source).alias("source"), F.col("ingested_at").cast("timestamp"), "series",
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.lit(100).cast("bigint").alias("volume"),
        F.lit(None).cast("decimal(20,2)").alias("turnover"), F.lit(None).cast("bigint").alias("delivery_qty"),
    )


def symbols(spark, rows):
    """rows: (symbol_id, isin, ticker, ingested_at, valid_from)."""
    df = spark.createDataFrame(rows, "symbol_id bigint, isin string, ticker string, ingested_at string, valid_from string")
    return df.withColumns({"ingested_at": F.col("ingested_at").cast("timestamp"), "valid_from": F.col("valid_from").cast("date")})


def links(spark, rows=()):
    df = spark.createDataFrame(list(rows), LINK)
    return df.withColumns({"boundary": F.col("boundary").cast("date"), "ingested_at": F.col("ingested_at").cast("timestamp")})


def adjustments(spark, rows=()):
    df = spark.createDataFrame(list(rows), "entity_id bigint, ex_date string, ratio double")
    return df.select("entity_id", F.col("ex_date").cast("date"), F.lit("test").alias("source"), F.col("ratio").cast("decimal(18,8)"), F.lit("2000-01-01").cast("timestamp").alias("ingested_at"))
