"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. With links at d or fewer differing bits, the 64 positions are cut into (d + 1) / 2 blocks, so
two linked fingerprints differ by at most one bit in some block. The anchors of a block are the words of a covering code: a
Hamming code on 2**r - 1 of its positions, every word on the others. Every word is within one bit (the covering radius) of its
home anchor. Each fingerprint is replicated to all anchors within radius plus threshold, that is two bits, of its block; so
of two linked fingerprints one's home anchor has both. Fingerprints are compared per anchor, where one of the two is at home.

One covering code over all 64 positions would need more than V(R + 3) / V(R) copies of each fingerprint (V: volume of a ball;
1,900 for R = 3), against 33 here for d = 3.

An anchor with more than GROUP fingerprints is set aside and dealt again: its fingerprints fall into FAN parts by a hash, and
each pair of parts is a smaller group, until none is too large. Within a group only links between fingerprints not yet known to be connected are kept.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, text_key, whole_text, widened
from .components import components

GROUP, FAN, SMALL = 4096, 16, 32
#: Words of a batch whose shingles are hashed at once.
CHUNK_WORDS = 1_000_000
FOUND = "deferred boolean, a bigint, b bigint, home boolean"


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of so many words (fewer words: of them all), A-Z in lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, max(1, len(w) - words + 1))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: a bit is 1 if over half of them have it. No hashes: 0."""
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), CHUNK_WORDS):
            ones += np.unpackbits(h[k : k + CHUNK_WORDS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `fingerprint` (bigint, the 64 bits) to the columns `keep`. Null and empty texts have fingerprint 0."""
    names = list(keep)
    schema = widened(df.select(*names).schema, "fingerprint bigint")

    def run(batches):
        for batch in batches:
            found = majority([shingle_hashes(x, words) for x in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(found.view(np.int64))], [*names, "fingerprint"])

    return df.select(*names, whole_text(text).alias("_text")).mapInArrow(run, schema)


@lru_cache(maxsize=8)
def code(distance: int) -> tuple[int, int, int, list[int], np.ndarray]:
    """Block count, block width, parity bits r, their position masks, and by syndrome the pairs of positions that lead to the code."""
    blocks = (distance + 2) // 2
    width = 64 // blocks
    r = (width + 1).bit_length() - 1
    n = (1 << r) - 1
    masks = [sum(1 << p - 1 for p in range(1, n + 1) if p >> k & 1) for k in range(r)]
    pairs = np.zeros((n + 1, max(0, n - 1) // 2), np.uint64)
    for s in range(1, n + 1):
        pairs[s] = [1 << a - 1 | 1 << (a ^ s) - 1 for a in range(1, n + 1) if a < a ^ s]
    return blocks, width, r, masks, pairs


def anchors(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors within two bits of each fingerprint in each block: row numbers, anchor keys, and whether it is the home anchor."""
    blocks, width, r, masks, pairs = code(distance)
    free = width - ((1 << r) - 1)
    rows = np.arange(len(fp))
    who, key, home = [], [], []
    for b in range(blocks):
        x = fp >> np.uint64(b * width) & np.uint64((1 << width) - 1)
        s = sum((np.bitwise_count(x & np.uint64(m)) & 1).astype(np.int64) << k for k, m in enumerate(masks))
        own = np.where(s > 0, x ^ np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), x)
        off = s > 0
        near = [own, *(own ^ np.uint64(1 << width - 1 - k) for k in range(free))]
        who += [rows] * len(near) + [np.repeat(rows[off], pairs.shape[1])]
        key += [k | np.uint64(b << width) if width < 60 else k for k in near] + [(x[off, None] ^ pairs[s[off]]).ravel() | np.uint64(b << width)]
        home += [np.full(len(rows), i == 0) for i in range(len(near))] + [np.zeros(int(off.sum()) * pairs.shape[1], bool)]
    return np.concatenate(who), np.concatenate(key).view(np.int64), np.concatenate(home)


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect in one group: each component's fingerprints with its first one."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            hit = (np.bitwise_count(fp[some][:, None] ^ fp[left][None, :]) <= distance).any(axis=0)
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(np.full(len(new), root))
                b.append(new)
                front = np.r_[front, new]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def linked(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within whole groups, sorted by key."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    useful = (size > 1) & np.logical_or.reduceat(home, start)
    a, b = [], []
    for lo, n in zip(start[useful & (size > SMALL)].tolist(), size[useful & (size > SMALL)].tolist(), strict=True):
        x, y = spanning(fp[lo : lo + n], distance)
        a.append(fp[lo + x])
        b.append(fp[lo + y])
    at = np.flatnonzero(np.repeat(useful & (size <= SMALL), size))
    end = np.repeat(start + size, size)
    for lag in range(1, SMALL):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        pick = at[(home[at] | home[at + lag]) & (np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance)]
        a.append(fp[pick])
        b.append(fp[pick + lag])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _compare(distance: int, most: int):
    """For mapInArrow over rows (key, fingerprint, home) sorted by key: edges, and the rows of groups above `most` as deferred."""

    def batch_of(deferred: bool, a, b, home) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), deferred)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(home)], ["deferred", "a", "b", "home"])

    def run(batches):
        key, fp, home = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        large = None
        for batch in batches:
            k, f, h = np.asarray(batch.column("key")), np.asarray(batch.column("fingerprint")).view(np.uint64), np.asarray(batch.column("home").cast(pa.int8())).astype(bool)
            key, fp, home = np.r_[key, k], np.r_[fp, f], np.r_[home, h]
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                yield batch_of(True, key[:n], fp[:n], home[:n])
                key, fp, home = key[n:], fp[n:], home[n:]
                large = large if not len(key) else None
            if not len(key):
                continue
            open_at = int(np.searchsorted(key, key[-1], "left"))
            yield from settle(key[:open_at], fp[:open_at], home[:open_at])
            key, fp, home = key[open_at:], fp[open_at:], home[open_at:]
            if len(key) > most:
                large = key[0]
                yield batch_of(True, key, fp, home)
                key, fp, home = key[:0], fp[:0], home[:0]
        yield from settle(key, fp, home)

    def settle(key, fp, home):
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        over = np.repeat(size > most, size)
        if over.any():
            yield batch_of(True, key[over], fp[over], home[over])
            key, fp, home = key[~over], fp[~over], home[~over]
        if len(key):
            a, b = linked(key, fp, home, distance)
            if len(a):
                yield batch_of(False, a, b, np.zeros(len(a), bool))

    return run


def _scatter(distance: int):
    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fingerprint")).view(np.uint64)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                who, key, home = anchors(part, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who].view(np.int64)), pa.array(home)], ["key", "fingerprint", "home"])

    return run


def links(fps: DataFrame, stage: Stage, distance: int = 3, most: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column `fingerprint`) that connect just what links at `distance` or fewer bits connect."""
    rows = fps.select("fingerprint").mapInArrow(_scatter(distance), "key bigint, fingerprint bigint, home boolean")
    out, level = None, 0
    while True:
        found = stage.put(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(distance, most), FOUND), "found")
        edges = found.where("not deferred").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        again = found.where("deferred").select(F.col("a").alias("key"), F.col("b").alias("fingerprint"), "home")
        if again.isEmpty():
            return out
        level += 1
        part = F.pmod(F.xxhash64("fingerprint", F.lit(level)), F.lit(FAN))
        again = again.withColumn("_i", part).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
        rows = again.select(F.xxhash64("key", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("key"), "fingerprint", "home")


def groups(df: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id (the smallest doc_id that links reach, itself included) of each row.

    Fingerprints link at `distance` or fewer differing bits, the empty texts' fingerprint 0 like any other. Rows with a
    null id take part in links; a component without any id has component_id null. Repeated rows are given as often.
    An anchor holds a share of all fingerprints, so pairs compared grow with the square of their number beyond some 10**10 documents.
    """
    return labelled(df, words, distance).select("doc_id", "fingerprint", "component_id")


def labelled(df: DataFrame, words: int, distance: int) -> DataFrame:
    """groups() with text_key."""
    stage = Stage(df.sparkSession, "simhash")
    rows = df.select("doc_id", text_key().alias("text_key"), F.col("text"))
    fps = stage.put(fingerprints(rows, words, keep=("doc_id", "text_key")), "fingerprints")
    reps = stage.put(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "distinct")
    nodes = stage.put(components(links(reps, stage, distance), stage), "nodes")
    named = nodes.join(reps, nodes["node"] == reps["fingerprint"]).groupBy("root").agg(F.min("_first").alias("component_id"))
    named = stage.put(named, "named")
    joined = stage.put(nodes.join(named, "root").select(F.col("node").alias("fingerprint"), F.col("component_id").alias("_joined"), F.lit(True).alias("_in")), "joined")
    label = reps.join(joined, "fingerprint", "left").select("fingerprint", F.when(F.col("_in"), F.col("_joined")).otherwise(F.col("_first")).alias("component_id"))
    return fps.join(stage.put(label, "labels"), "fingerprint").select("doc_id", "fingerprint", "component_id", "text_key")


def first_of_group(df: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns; see only_first."""
    return only_first(df, labelled(df, words, distance))


def only_first(df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of df without those that `found` (doc_id, text_key, component_id) puts into a component of a smaller id.

    A row goes by its id and text, so another text under the same id stays. Of rows alike in id and component each stays, and so do
    documents without an id.
    """
    gone = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return df.join(gone, (df["doc_id"] == gone["_gone_id"]) & (text_key() == gone["_gone_key"]), "left_anti")
