"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into shards of about SHARD rows. A shard's rows are sorted by every dimension once, and these lists are stored. A query
reads a shard's lists in step, from the large end where its component is positive, from the small end where it is negative, scores each
row when any list first shows it, and stops when the score that a row unseen so far could have, the sum over the lists at
their present depth, is below what it must beat. A row that could tie is still looked at, as ties go to the smaller id.

What a query must beat in its own shard is its kth best score so far. That score is its floor in all other shards, most of which are left after the
first look. Queries visit the other shards in blocks of about BLOCK, one task's group for each block and shard; the k best of each shard
meet in one ranking per query.

Scores are exact 64-bit integers. A component beyond 2**63 / 256 in size, or sums that may leave 64 bits, are errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage

SHARD, BLOCK, FIRST_DEPTH = 8192, 8192, 32
HITS = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint, scored bigint"
LISTS = "dim int, shard bigint, n int, ids binary, rows binary, kind string, vectors binary, orders binary"
#: Sums of products below this are exact as doubles, which are faster.
EXACT = 1 << 53


def quantized(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Rows that take part: vec_id, v = floor(256 * x) of each component, and a row number of their own. Rows with a null
    id, a null vector, or a null or non-finite component are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    whole = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * 256.0).cast("bigint"))
    return df.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))


def ready(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The vectors as doubles if every inner product with the queries is exact in them, else as integers."""
    size = sum(a * b for a, b in zip(np.abs(values).max(axis=0).tolist(), np.abs(asked).max(axis=0).tolist(), strict=True))
    if size >= 1 << 63:
        raise OverflowError("scores may leave 64 bits")
    return values.astype(np.float64) if size < EXACT else values


def threshold_search(values: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best rows for one query, best first, ties to the smaller id, and how many rows were scored.

    values: rows by dimensions; order: per dimension, positions by ascending value. own: a row that takes no part, or -1. floor: a
    score that k rows elsewhere reach; rows below it are of no use and may be left out.
    """
    n = len(values)
    dims = np.flatnonzero(query)
    if not len(dims):
        dims = np.arange(len(query))
    down = query[dims] > 0
    part = query[dims]
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own] = True
    found, scores = [], []
    least, depth, to = floor, 0, min(FIRST_DEPTH, n)
    while depth < n:
        last = np.where(down, order[dims, n - max(depth, 1)], order[dims, max(depth, 1) - 1])
        if least is not None and least > (part * values[last, dims]).sum():
            break
        shown = np.zeros(n, bool)
        if down.any():
            shown[order[dims[down], n - to : n - depth].ravel()] = True
        if not down.all():
            shown[order[dims[~down], depth:to].ravel()] = True
        new = np.flatnonzero(shown & ~seen)
        seen[new] = True
        found.append(new)
        scores.append(values[new] @ query)
        depth = to
        so_far = np.concatenate(scores)
        if len(so_far) >= k:
            kth = np.partition(so_far, len(so_far) - k)[len(so_far) - k]
            least = kth if least is None else max(least, kth)
        to = min(n, depth * 2)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at, score = np.concatenate(found), np.concatenate(scores)
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best].astype(np.int64), len(at)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)


def _build(key, rows):
    """The sorted lists of one shard, in the narrowest types that hold them."""
    dim = key[0].as_py()
    values = _matrix(rows.column("v"), dim)
    most = int(np.abs(values).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    order = np.argsort(values, axis=0, kind="stable").T.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32)
    row = [[dim], [key[1].as_py()], [len(values)], [np.asarray(rows.column("vec_id")).tobytes()], [np.asarray(rows.column("row")).tobytes()], [np.dtype(kind).name], [values.astype(kind).tobytes()], [order.tobytes()]]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in LISTS.split(", ")])


def _search(k: int, others: bool):
    """For a shard's lists and some queries (query_row, query_id, query_v, floor): the k best of the shard for each."""

    def run(key, lists, queries):
        out: list[list] = [[] for _ in range(6)]
        if lists.num_rows and queries.num_rows:
            one = lists.to_pylist()[0]
            dim, n = one["dim"], one["n"]
            ids, rows = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["rows"], np.int64)
            values = np.frombuffer(one["vectors"], one["kind"]).reshape(n, dim).astype(np.int64)
            order = np.frombuffer(one["orders"], np.uint16 if n <= 1 << 16 else np.uint32).reshape(dim, n)
            asked = _matrix(queries.column("query_v"), dim)
            values = ready(values, asked)
            place = {} if others else {r: i for i, r in enumerate(rows.tolist())}
            for q, q_row, q_id, floor in zip(asked.astype(values.dtype), *(queries.column(c).to_pylist() for c in ("query_row", "query_id", "floor")), strict=True):
                at, score, scored = threshold_search(values, order, ids, q, place.get(q_row, -1), k, floor)
                for c, x in zip(out, ([q_row] * len(at), [q_id] * len(at), rows[at].tolist(), ids[at].tolist(), score.tolist(), [scored] + [0] * (len(at) - 1)), strict=True):
                    c += x[: len(at)]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def hits(df: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """What each query found in its own shard, and in the others; `scored` counts the rows that were scored to find it."""
    stage = Stage(df.sparkSession, "topk")
    rows = stage.put(quantized(df), "vectors").where("size(v) > 0")
    shards = max(1, -(-rows.count() // SHARD))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint").alias("shard")
    dealt = rows.select(F.size("v").alias("dim"), shard, "row", "vec_id", "v")
    lists = stage.put(dealt.groupBy("dim", "shard").applyInArrow(_build, LISTS), "lists")
    asked = dealt.where(F.col("vec_id") % every == 0).select("dim", "shard", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query_v"))
    at_home = asked.withColumn("floor", F.lit(None).cast("bigint"))
    home = stage.put(lists.groupBy("dim", "shard").cogroup(at_home.groupBy("dim", "shard")).applyInArrow(_search(k, False), HITS), "home")
    floors = home.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = stage.put(asked.join(floors, "query_row", "left"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    block = F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("bigint").alias("block")
    sent = asked.select("dim", F.col("shard").alias("_own"), block, "query_row", "query_id", "query_v", "floor").withColumn("shard", numbers(shards)).where("shard <> _own").drop("_own")
    copies = lists.withColumn("block", numbers(blocks))
    away = copies.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(_search(k, True), HITS)
    return home, away


def top_k(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: its k best other rows as query_id, rank (from 1), vec_id, score.

    A repeated id is a row like any other, also as another query. Rows compare with rows of the same dimension only. An empty
    table, or a query without other rows, gives no rows.
    """
    home, away = hits(df, every, k)
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return home.unionByName(away).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
