"""The lines of archive files, opened on the executors: batches and streams of `binaryFile` rows both come here.

A file is one session's archive: a CSV, or a zip file with one CSV member. Each file is a row of its own, so files are unzipped and split in parallel, and each is
read by its own header, whatever the order of its columns. What cannot be opened becomes a line 0 with an error, so that nothing is left out in silence.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LINES = "file string, line int, header array<string>, cells map<string,string>, error string"
GLOB = "*.{csv,CSV,zip,ZIP}"


def member(body: bytes) -> bytes:
    """The CSV of a session's archive: the one member of a zip file, or the bytes as they are."""
    if not body.startswith(b"PK"):
        return body
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if len(names) != 1:
            raise ValueError(f"one CSV expected, found {names}")
        return z.read(names[0])


def split(body: bytes) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """The header and the numbered lines that are not blank, cells without outer white space."""
    rows = csv.reader(io.StringIO(member(body).decode("utf-8-sig"), newline=""), skipinitialspace=True, strict=True)
    header = [h.strip() for h in next(rows, [])]
    return header, [(rows.line_num, [c.strip() for c in r]) for r in rows if any(c.strip() for c in r)]


def _run(batches):
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
    names = [x.split(" ")[0] for x in LINES.split(", ")]
    for batch in batches:
        for path, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            name = path.rsplit("/", 1)[-1]
            try:
                header, rows = split(body)
                out = [(name, n, header, list({h: c for h, c in zip(header, r, strict=False) if h}.items()), None) for n, r in rows]
                out = out or [(name, 1, header, [], None if header else "no header")]
            except (ValueError, csv.Error, zipfile.BadZipFile) as e:
                out = [(name, 0, [], [], f"{type(e).__name__}: {e}"[:500])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def lines(files: DataFrame) -> DataFrame:
    """(file, line, header, cells, error) of `binaryFile` rows, of a batch or a stream. A file without lines gives one row without cells, so that its header is
    seen; a cell that a line lacks is absent. Spark does not read files without a byte."""
    return files.select("path", "content").mapInArrow(_run, LINES)


def batch_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
