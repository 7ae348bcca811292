"""Readers of archive files. Headers are asserted, never inferred; anything malformed is an error that names its file and row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import IntegrityError, assert_empty
from .members import batch_files, lines

SERIES = ("EQ", "BE")
#: The columns each layout must have, and the dates it may write.
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "udiff": (("TradDt", "TckrSymb", "SctySrs", "ISIN", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol", "TtlTrfVal"), ("yyyy-MM-dd",)),
    "legacy": (("TIMESTAMP", "SYMBOL", "SERIES", "ISIN", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY", "TOTTRDVAL"), ("dd-MMM-yyyy", "dd-MMM-yy")),
    "preisin": (("TIMESTAMP", "SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY", "TOTTRDVAL"), ("dd-MMM-yyyy", "d-MMM-yyyy")),
}
BAR_COLUMNS = ("date", "ticker", "series", "isin", "open", "high", "low", "close", "volume", "turnover")
INDEX_COLUMNS = ("Index Name", "Index Date", "Open Index Value", "High Index Value", "Low Index Value", "Closing Index Value", "Points Change", "Change(%)", "Volume", "Turnover (Rs. Cr.)", "P/E", "P/B", "Div Yield")
#: The ways an index file may write its date.
INDEX_DATES = ("dd-MM-yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "MM/dd/yyyy")
DAILY_COLUMNS = ("Date", "Open", "High", "Low", "Close", "Volume")


def number(col: Column, kind: str = "double") -> Column:
    """A number without thousands separators; null for an empty text or a dash."""
    text = F.trim(F.regexp_replace(col, ",", ""))
    return F.when(~text.isin("", "-"), text.try_cast(kind))


def day(col: Column, formats: tuple[str, ...]) -> Column:
    text = F.initcap(F.trim(col))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def headers(spark: SparkSession, paths: list[str] | str) -> dict[str, list[str]]:
    """The files of each header line. An archive has a few headers and one small file a day."""
    line = F.substring_index(F.decode(F.substring("content", 1, 8192), "UTF-8"), "\n", 1)
    rows = spark.read.format("binaryFile").load(paths).select(F.regexp_replace(line, "[\\r\ufeff]", "").alias("header"), "path")
    return {r["header"]: sorted(r["paths"]) for r in rows.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()}


def read_csv(spark: SparkSession, paths: list[str] | str) -> list[DataFrame]:
    """One table of text columns for each header among the files, with the file that rows came from. Columns go by their own file's header."""
    out = []
    for header, files in sorted(headers(spark, paths).items()):
        names = [h.strip().strip('"') for h in header.split(",")]
        kind = ", ".join(f"`{n or f'_blank{i}'}` string" for i, n in enumerate(names))
        read = spark.read.option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        read = read.option("mode", "FAILFAST") if all(names) else read.option("enforceSchema", True)
        out.append(read.schema(kind).csv(files).withColumn("file", F.col("_metadata.file_name")))
    return out


def plain_number(text: Column) -> Column:
    """A number as an archive of bars writes it, without separators; null for anything else, NaN and infinities included."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


#: What a line gives, in the order of LAYOUTS with the ISIN fourth.
_NUMBERS = ("open", "high", "low", "close", "volume", "turnover")


def _places(columns: tuple[str, ...]) -> list[str]:
    """The names of date, ticker, series, ISIN and the numbers in a layout; a name of no column where it has none."""
    return [*columns[:3], "ISIN" if "ISIN" in columns else "", *columns[-6:]]


def parsed(rows: DataFrame) -> DataFrame:
    """Bars of lines(), series EQ and BE only, each by the layout of its own file's header, with `wrong`: what is malformed in a line, null if nothing is."""
    have = [F.when(F.size(F.array_except(F.array(*map(F.lit, columns)), "header")) == 0, F.lit(name)) for name, (columns, _) in LAYOUTS.items()]
    rows = rows.withColumn("layout", F.coalesce(*have))  # the newest first: the oldest one's columns are a part of its successor's
    names = F.coalesce(*[F.when(F.col("layout") == name, F.array(*map(F.lit, _places(columns)))) for name, (columns, _) in LAYOUTS.items()])
    rows = rows.withColumn("_c", F.transform(names, lambda n: F.coalesce(F.try_element_at("cells", n), F.lit(""))))
    dates = F.coalesce(*[F.when(F.col("layout") == name, day(F.get("_c", F.lit(0)), formats)) for name, (_, formats) in LAYOUTS.items()])
    rows = rows.withColumns({"date": dates, "ticker": F.get("_c", F.lit(1)), "series": F.get("_c", F.lit(2)), "isin": F.nullif(F.get("_c", F.lit(3)), F.lit(""))})
    said = F.arrays_zip(F.array(*map(F.lit, _NUMBERS)).alias("name"), F.slice("_c", 5, len(_NUMBERS)).alias("text"))
    rows = rows.withColumns({"_v": F.transform(F.slice("_c", 5, len(_NUMBERS)), lambda x: plain_number(x)), "_said": said})
    unread = F.get(F.filter(F.zip_with("_said", "_v", lambda x, v: F.when(v.isNull(), F.concat(x["name"], F.lit(" "), x["text"]))), lambda x: x.isNotNull()), F.lit(0))
    volume = F.get("_v", F.lit(4))
    uncounted = (volume < -float(1 << 63)) | (volume >= float(1 << 63))  # what 64 bits do not hold; fractions are cut off
    with_isin = [name for name, (columns, _) in LAYOUTS.items() if "ISIN" in columns]
    traded = F.coalesce(F.col("series").isin(*SERIES), F.lit(False))
    line = F.coalesce(F.when(F.col("date").isNull(), "date"), unread, F.when(uncounted, F.concat(F.lit("volume "), F.get("_c", F.lit(8)))), F.when(F.col("isin").isNull() & F.col("layout").isin(*with_isin), "no ISIN"))
    unknown = F.when(F.col("layout").isNull(), F.concat(F.lit("unknown header "), F.array_join("header", ",")))
    rows = rows.withColumn("wrong", F.coalesce("error", unknown, F.when(traded, line))).where(F.col("wrong").isNotNull() | traded)
    numbers = [F.get("_v", F.lit(i)).try_cast("bigint" if k == "volume" else "double").alias(k) for i, k in enumerate(_NUMBERS)]
    return rows.select("file", "line", "layout", "date", "ticker", "series", "isin", *numbers, "wrong")


def checked(rows: DataFrame) -> None:
    """Raises, with file and line, on a file that cannot be opened or has an unknown header, on an unreadable date, price, volume or turnover, on a blank ISIN in a layout that has
    it, and on one ISIN (or ticker, where there is none) twice on a day of a file."""
    assert_empty(rows.where("wrong is not null").select("file", "line", "wrong"), "malformed rows")
    identity = F.coalesce("isin", "ticker").alias("identity")
    assert_empty(rows.groupBy("file", "date", identity).agg(F.count(F.lit(1)).alias("k"), F.min("line").alias("line")).where("k > 1"), "one identity twice on a day")


def typed(rows: DataFrame) -> DataFrame:
    prices = {p: F.col(p).cast("decimal(14,4)") for p in ("open", "high", "low", "close")}
    return rows.withColumns(prices | {"turnover": F.col("turnover").cast("decimal(20,2)")}).select("file", *BAR_COLUMNS)


def equity_bars(spark: SparkSession, paths: list[str] | str, check: bool = True) -> DataFrame:
    """Bars of equity archive files, zipped or not, each read by its own header; see checked() for what is an error. Without check, lines that cannot be read are
    left out."""
    rows = parsed(lines(batch_files(spark, paths)))
    if check:
        checked(rows)
    return typed(rows.where("wrong is null"))


def daily_bars(spark: SparkSession, folder: str, symbol_map: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Adjusted daily files of a folder, one per ticker named by its file: the bars of mapped tickers, and the unmapped tickers in order.
    Files may or may not have deliveries. A date or number that cannot be read is an error."""
    if not symbol_map:
        raise IntegrityError("the symbol map is empty")
    rows = None
    for raw in read_csv(spark, folder):
        if missing := set(DAILY_COLUMNS) - set(raw.columns):
            raise IntegrityError(f"missing columns {sorted(missing)}")
        delivery = F.col("DLV_QTY") if "DLV_QTY" in raw.columns else F.lit(None).cast("string")
        some = raw.select(
            F.upper(F.regexp_replace("file", r"(?i)\.csv$", "")).alias("ticker"), day(F.substring("Date", 1, 10), ("yyyy-MM-dd",)).alias("date"),
            *[number(F.col(c)).cast("decimal(14,4)").alias(c.lower()) for c in ("Open", "High", "Low", "Close")], number(F.col("Volume")).cast("bigint").alias("volume"), number(delivery).cast("bigint").alias("delivery_qty"),
        )
        rows = some if rows is None else rows.unionByName(some)
    bad = F.lit(False)
    for c in ("date", "open", "high", "low", "close", "volume"):
        bad = bad | F.col(c).isNull()
    assert_empty(rows.where(bad), "malformed rows")
    known = spark.createDataFrame(list(symbol_map.items()), "ticker string, isin string")
    return rows.join(known, "ticker"), rows.select("ticker").distinct().join(known, "ticker", "left_anti").orderBy("ticker")


def symbol_map(spark: SparkSession, path: str) -> dict[str, str]:
    """The `sym2isin` object of a JSON file. A file without entries is an error."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "struct<sym2isin:map<string,string>>").sym2isin.alias("m")).select(F.explode("m").alias("k", "v")).collect()
    if not rows:
        raise IntegrityError("the symbol map is empty")
    return {r["k"]: r["v"] for r in rows}


def index_lines(rows: DataFrame) -> DataFrame:
    """Index levels of lines(): file, line, session (from the file's name), index_name, date, numbers, and `wrong`. A dash is a null; a close is required. The date may be written in
    four ways; one of them must give the session of the file."""
    kinds = ("open", "high", "low", "close", "points_change", "pct_change", "volume", "turnover", "pe", "pb", "div_yield")
    cells = F.transform(F.array(*map(F.lit, INDEX_COLUMNS)), lambda n: F.coalesce(F.try_element_at("cells", n), F.lit("")))
    session = F.try_to_timestamp(F.regexp_extract("file", "([0-9]{8})[^0-9]*$", 1), F.lit("ddMMyyyy")).cast("date")
    rows = rows.withColumns({"_c": cells, "session": session})
    rows = rows.withColumns({"index_name": F.get("_c", F.lit(0)), "_v": F.transform(F.slice("_c", 3, len(kinds)), lambda x: number(x))})
    told = F.zip_with(F.slice("_c", 3, len(kinds)), "_v", lambda text, v: F.when(v.isNull() & ~text.isin("", "-"), F.concat(F.lit("no number: "), text)))
    unread = F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0))
    asked = F.coalesce(*[F.when(F.try_to_timestamp(F.get("_c", F.lit(1)), F.lit(f)).cast("date") == F.col("session"), F.lit(True)) for f in INDEX_DATES], F.lit(False))
    line = F.coalesce(
        F.when(F.col("session").isNull(), "no session in the file's name"), F.when(F.size("cells") != len(INDEX_COLUMNS), "a cell is missing"),
        F.when(~asked, "a row of another day"), unread, F.when(F.get("_v", F.lit(3)).isNull(), "no close"),
    )
    unknown = F.when(F.col("header") != F.array(*map(F.lit, INDEX_COLUMNS)), F.concat(F.lit("unexpected header "), F.array_join("header", ",")))
    named = F.col("index_name") != ""
    rows = rows.withColumn("wrong", F.coalesce("error", unknown, F.when(named, line))).where(F.col("wrong").isNotNull() | named)
    return rows.select("file", "line", "index_name", F.col("session").alias("date"), *[F.get("_v", F.lit(i)).alias(k) for i, k in enumerate(kinds)], "wrong")


def index_levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels of index_lines(), and the anomalies (date, index_name, copies): names that stand more than once in a session, of which no copy is taken, as nothing
    says which is right. What is malformed raises, with file and line."""
    twice = rows.where("index_name <> ''").groupBy("date", "index_name").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    single = rows.join(twice, ["date", "index_name"], "left_anti")
    assert_empty(single.where("wrong is not null").select("file", "line", "index_name", "wrong"), "malformed index rows")
    return single.drop("wrong", "line"), twice.orderBy("date", "index_name")


def index_rows(spark: SparkSession, path: str, session: str) -> tuple[DataFrame, DataFrame]:
    """Levels of an index file of one session, and the names dropped because they stand in it more than once."""
    rows = index_lines(lines(batch_files(spark, path)).withColumn("file", F.concat("file", F.lit(f"@{date.fromisoformat(session):%d%m%Y}"))))
    levels, twice = index_levels(rows)
    return levels.drop("file"), twice.select("index_name")
