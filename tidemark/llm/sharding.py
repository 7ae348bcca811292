"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers from 0 in the order of a content hash. A keyed Feistel network permutes a domain a * b that
is at least the row count n and exceeds it by less than a = ceil(sqrt(n)); a number that lands beyond n walks on through the
network until it is below n. Shard and slot of a row are the remainder and the quotient of its permuted number by the
shard count, so counts are at most one apart, slots have no gaps, and place(number) can be computed without the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, numbered, whole_text

ROUNDS, SEED = 8, 20240501
#: Walks beyond this many have a chance below (1 / a) ** WALKS; smaller domains need fewer in any case.
WALKS = 64


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """A bijection of 0..a*b-1: halves x / b and x % b, each round adding a hash of one half to the other."""
    width = F.lit(b).cast("long")
    low = F.pmod(x.cast("long"), width)
    start = F.struct(((x.cast("long") - low) / width).cast("long").alias("l"), low.alias("r"))

    def turn(s: Column, k: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(s["r"], k), F.lit(a).cast("long"))) % F.lit(a).cast("long")
        right = (s["r"] + F.pmod(F.xxhash64(s["l"], k), F.lit(b).cast("long"))) % F.lit(b).cast("long")
        return F.struct(F.when(k % 2 == 0, left).otherwise(s["l"]).alias("l"), F.when(k % 2 == 1, right).otherwise(s["r"]).alias("r"))

    rounds = F.array(*[F.lit(2 * ((seed << 8) + i) + i % 2).cast("long") for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of number x (0 <= x < n) in the shuffle of n numbers."""
    if n < 2:
        return x.cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    out = _network(x, a, b, seed)
    if walks := min(a * b - n, WALKS):
        steps = F.sequence(F.lit(1), F.lit(walks))
        out = F.aggregate(steps, out, lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, seed)))
        out = F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return out


def shard_rows(df: DataFrame, shards: int, seed: int = SEED, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds shard and slot under the law `rows`. Only ids, sizes and hashes are shuffled, never texts.

    A null text counts as empty; a null or repeated id is a row like any other; rows that are alike in id and text
    get distinct slots; an empty table gives an empty result. Columns beside id and text are not read.
    """
    body = whole_text(text)
    slim = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(body).cast("string"))).alias("_key"),
    )
    stage = Stage(df.sparkSession, "shard")
    rows, n = numbered(stage.put(slim, "slim"), "_key", stage, "_row", ("doc_id", "text_crc32"))
    place = rows.select("doc_id", "size", "text_crc32", permuted(F.col("_row"), n, seed).alias("_place"))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        ((F.col("_place") - F.col("_place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
