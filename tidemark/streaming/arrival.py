"""Archive files as a stream: whatever has arrived is appended once, and the run ends.

Files go through the reader and the checks of batch reads, zipped or not and each by its own header. The checkpoint remembers which files were seen; content hashes make a
repeated batch add nothing, so a run that was cut short can be started again. Late and corrected files are later versions, which pinned reads do not see; no
watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aliases import with_code
from ..operators.checks import assert_empty
from ..plans.ingest import insert_bars, insert_index_levels
from ..sources.archives import LAYOUTS, checked, index_levels, index_lines, parsed, typed
from ..sources.members import arriving_files, lines


def _each_batch(spark: SparkSession, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame, int], int]) -> list[int]:
    """Parses and stores all files of a folder that no earlier run has seen. Returns what each batch added."""
    added: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            added.append(store(rows, number))
        finally:
            rows.unpersist()

    query = parse(lines(arriving_files(spark, folder))).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return added


def ingest_arrived(spark: SparkSession, folder: str, header: list[str] | None, layout: str | None, source: str, root: str, checkpoint: str, at: Callable[[int], str], identity: DataFrame | None = None) -> list[int]:
    """Appends the bars of all files of a folder that no earlier run has seen. Returns the rows added by each batch.

    header, layout: if given, the columns that files must have, in any order, and the layout that they must be of. identity (ticker, isin): names the bars of a layout
    that has no ISIN; a ticker without one is an error there.
    """
    if header is not None and layout is not None and not set(LAYOUTS[layout][0]) <= {h.strip() for h in header}:
        raise ValueError(f"the header is not of layout {layout}")

    def store(rows: DataFrame, number: int) -> int:
        checked(rows)
        if layout is not None:
            assert_empty(rows.where(F.col("layout") != layout).select("file", "layout"), f"files of another layout than {layout}")
        if identity is not None:
            names = identity.select("ticker", F.col("isin").alias("_isin"))
            rows = rows.join(names, "ticker", "left").withColumn("isin", F.coalesce("isin", "_isin")).drop("_isin")
        return insert_bars(rows.sparkSession, root, source, typed(rows).drop("file"), at(number))

    return _each_batch(spark, folder, checkpoint, parsed, store)


def ingest_index_arrived(spark: SparkSession, folder: str, source: str, root: str, checkpoint: str, at: Callable[[int], str]) -> list[int]:
    """The same for index files, named by their session; names that stand twice in a session are left out of it."""

    def store(rows: DataFrame, number: int) -> int:
        levels, _ = index_levels(rows)
        return insert_index_levels(rows.sparkSession, root, source, with_code(levels), at(number))

    return _each_batch(spark, folder, checkpoint, index_lines, store)
