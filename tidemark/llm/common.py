"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..plans.storage import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


class Stage:
    """Tables written to the shared folder and read again, which cuts lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns the written table. An empty table keeps its schema."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # what df shuffled is of no use once it is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that put() returned and that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(column, most: int = 4 << 20):
    """(start, count) of runs of rows of an Arrow string or binary column with about so many bytes, or of one row."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and size + n > most:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column) - start


def widened(schema: StructType, ddl: str) -> StructType:
    """The schema with the fields of a DDL string after it; a field of the same name is replaced."""
    more = StructType.fromDDL(ddl)
    return StructType([f for f in schema.fields if f.name not in more.names] + more.fields)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str = "text") -> Column:
    """A hash of the whole text; rows are told apart by it only among those with the same id."""
    return F.xxhash64(whole_text(col))


def numbered(df: DataFrame, key: str, stage: Stage, name: str = "n", ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Adds a gapless global row number from 0 in the order of the hex string column `key`, then of `ties`.

    No window spans the table: rows fall into ranges of the key's first digits, a range's first number is the
    running sum of the sizes of the ranges before it, and only rows of one range are sorted together. The key must be
    a hash, so ranges are even. There are about 4 * sqrt(rows) ranges. Rows equal in key and ties are numbered in any
    order. df must be a stored table, as it is read three times. Returns the rows and their count.
    """
    total = df.count()
    digits = min(7, max(2, math.ceil(math.log(4 * math.sqrt(max(total, 1)), 16))))
    ranged = df.withColumn("_range", F.conv(F.substring(key, 1, digits), 16, 10).cast("long"))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    first = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_first"))
    first = stage.put(first, "ranges")
    order = Window.partitionBy("_range").orderBy(key, *ties)
    ranged = ranged.withColumn("_in", F.row_number().over(order).cast("long") - 1)
    return ranged.join(first, "_range").withColumn(name, F.col("_first") + F.col("_in")).drop("_range", "_first", "_in"), total
