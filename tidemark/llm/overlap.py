"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash links first, then a set join for what they miss.

At similarity 0.8 about 10 of a fingerprint's 64 bits differ, and no covering code carries that: anchors of so short blocks have nearly all
fingerprints. So SimHash by anchor-point covering (simhash.py) finds the closest pairs, and the others come from this rule: two sets of
similarity 0.8 or more share one of their first shingles in any order common to all sets; of n shingles the first n - ceil(0.8 n) + 1 will
do. The order puts the shingles that a fixed share of the texts has often last, as they would join too many sets. The share affects the
work only, not the result. Each set has a bitmap of about a bit per shingle, which refuses nearly all pairs of unlike sets without their
shingles. Every link is verified on the whole sets.

Groups of many copies are joined without all their pairs: first each set is compared only with its closest fingerprint and with the set
at the head of most lists that it stands in; what that connects is one component. Then all pairs of sets that share a first shingle are compared, but
only those of different components, as others change nothing. There every set carries a sketch of a fixed number of bits, by which the join itself
refuses a pair: in a family of pages that are nearly similar enough, nearly all pairs are refused before they become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, slices, text_key, whole_text
from .components import components
from .simhash import links, majority, only_first, shingle_hashes

WORDS = 5
#: One text in SHARE is in the sample; shingles in at least OFTEN of its texts are common, and the commonest, at most COMMON, are known as such.
SHARE, OFTEN, COMMON = 8, 3, 1_000_000
#: Differing bits of the fingerprints that are looked at first; pairs with one set that are verified in one group.
BITS, FAN = 3, 256
#: Words of 64 bits of the sketch that goes with every row of the last join. It affects the work only.
SKETCH = 16


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(text, words))


def name_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, by which equal sets are found."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) - (1 << 63)


def first_shingles(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not in `common` (ascending) by hash, then the others by hash."""
    n = len(shingles)
    most = n - -(-4 * n // 5) + 1 if n else 0
    if len(common):
        known = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.r_[shingles[~known], shingles[known]]
    return shingles[:most]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The bits that the last binary digits of some shingle name, of the power of two, at least 64, that is not less than their number."""
    n = 1 << max(6, (len(shingles) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[shingles & np.uint64(n - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH words of 64 bits: the bits that ten binary digits of some shingle name."""
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[(shingles >> np.uint64(32)) & np.uint64(64 * SKETCH - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def common_shingles(df: DataFrame, words: int, stage: Stage) -> np.ndarray:
    """Shingles that many of a share of the distinct texts have, ascending; at most COMMON of them reach the driver."""

    def run(batches):
        for batch in batches:
            for x in batch.column("_text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x, words).view(np.int64))], ["shingle"])

    texts = df.select(whole_text().alias("_text")).where(F.pmod(F.xxhash64("_text"), F.lit(SHARE)) == 0).distinct()
    often = texts.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = stage.put(often.select("shingle", F.floor(4 * F.log2("n")).alias("step")), "often")
    total, least = 0, None
    for step, n in sorted(often.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # four steps per doubling: few rows
        total += n
        if total > COMMON:
            break
        least = step
    found = often.where(F.col("step") >= F.lit(least)).select("shingle").toArrow().column("shingle")
    stage.drop(often)
    return np.sort(np.asarray(found.to_numpy(), np.int64).view(np.uint64))


def _listed(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sets(df: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """doc_id, text_key, set (the name of its shingle set), size, fingerprint, bits (its bitmap) and first (shingles) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for lo, n in slices(batch.column("_text")):
                hashes = [shingle_hashes(x, words) for x in batch.column("_text").slice(lo, n).to_pylist()]
                found = [np.unique(h) for h in hashes]
                names, sizes = pa.array([name_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())
                first = _listed([first_shingles(s, shared.value) for s in found])
                bits, sketches = _listed([bitmap(s) for s in found]), _listed([sketch(s) for s in found])
                prints = pa.array(majority(hashes).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("text_key").slice(lo, n), names, sizes, prints, bits, sketches, first], ["doc_id", "text_key", "set", "size", "fingerprint", "bits", "sketch", "first"])

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", whole_text().alias("_text"), text_key().alias("text_key"))
    return rows.select("doc_id", "text_key", "_text").mapInArrow(run, f"doc_id {kind}, text_key bigint, set bigint, size bigint, fingerprint bigint, bits array<bigint>, sketch array<bigint>, first array<bigint>")


def whole_sets(df: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """set and shingles of the distinct texts that `keys` (text_key, _id) names."""

    def run(batches):
        for batch in batches:
            for lo, n in slices(batch.column("_text")):
                found = [shingle_set(x, words) for x in batch.column("_text").slice(lo, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in found], pa.int64()), _listed(found)], ["set", "shingles"])

    rows = df.select("doc_id", whole_text().alias("_text"), text_key().alias("text_key"))
    rows = rows.join(keys, (rows["text_key"] == keys["text_key"]) & rows["doc_id"].eqNullSafe(keys["_id"]), "left_semi")
    return rows.select("_text").mapInArrow(run, "set bigint, shingles array<bigint>").dropDuplicates(["set"])


def enough(overlap) -> Column:
    """Whether so many common shingles make two sets of _a_size and _b_size similar."""
    return 9 * overlap >= 4 * (F.col("_a_size") + F.col("_b_size"))


def folded(bits: str, other: str) -> Column:
    """A bitmap at half its length where the other one is shorter; those of similar sets differ by no more than that."""
    half = F.size(other)
    halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) > half, halves).otherwise(F.col(bits))


def possible(pairs: DataFrame, reps: DataFrame, stage: Stage) -> DataFrame:
    """Those of the distinct stored pairs whose sizes and bitmaps allow the similarity: each bit of one that the other lacks is at least one
    shingle that it lacks."""
    a, b = folded("_a_bits", "_b_bits"), folded("_b_bits", "_a_bits")
    lacks = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    sized = enough(F.least("_a_size", "_b_size"))
    both = F.least(F.col("_a_size") - lacks(a, b), F.col("_b_size") - lacks(b, a))
    return beside(pairs, reps, ["size", "bits"], stage).where(F.when(sized, enough(both))).select("a", "b")


def beside(pairs: DataFrame, whole: DataFrame, columns: list[str], stage: Stage) -> DataFrame:
    """The pairs with columns of both sets, as _a_ and _b_ columns. A set with many partners is sent to several groups of them. The pairs are stored
    first, so that Spark knows their size and need not shuffle what they are joined with if there are few."""
    fans = stage.put(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("_fans")), "fans")
    dealt = stage.put(pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_fans")).alias("_fan")), "dealt")
    left = whole.select(F.col("set").alias("b"), *[F.col(c).alias(f"_b_{c}") for c in columns]).join(dealt, "b")
    right = whole.select(F.col("set").alias("a"), *[F.col(c).alias(f"_a_{c}") for c in columns]).join(fans, "a")
    return left.join(right.withColumn("_fan", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_fans") - 1))), ["a", "_fan"])


def verified(pairs: DataFrame, reps: DataFrame, df: DataFrame, words: int, stage: Stage) -> DataFrame:
    """Those of the distinct stored pairs (a, b) whose whole sets have the similarity."""
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    keys = stage.put(reps.join(ends, "set", "left_semi").select("text_key", "_id"), "keys")
    whole = stage.put(whole_sets(df, keys, words).withColumn("size", F.size("shingles")), "whole")
    out = beside(pairs, whole, ["size", "shingles"], stage).where(enough(F.size(F.array_intersect("_a_shingles", "_b_shingles"))))
    out = stage.put(out.select("a", "b"), "verified")
    stage.drop(keys, whole)
    return out


def close_prints(reps: DataFrame, stage: Stage) -> DataFrame:
    """Pairs (a, b) of sets that connect those whose fingerprints differ in at most BITS bits."""
    heads = stage.put(reps.groupBy("fingerprint").agg(F.min("set").alias("head")), "heads")
    same = reps.join(heads, "fingerprint").select(F.col("head").alias("a"), F.col("set").alias("b"))
    near = links(heads, stage, BITS).distinct()
    for end in ("a", "b"):
        near = near.join(heads.select(F.col("fingerprint").alias(end), F.col("head").alias(f"_{end}")), end)
    return same.union(near.select("_a", "_b"))


def differing(index: DataFrame, by: str) -> DataFrame:
    """The rows of index whose shingle stands beside more than one value of a column."""
    lists = Window.partitionBy("shingle")
    return index.withColumns({"_least": F.min(by).over(lists), "_most": F.max(by).over(lists)}).where("_least < _most").drop("_least", "_most")


def heads(shared: DataFrame, stage: Stage) -> DataFrame:
    """(head, set): the set that is at the head of most of a set's lists and may be similar to it. A list's head is the set of which the greatest part stands in lists
    with others: of a text and its edited copies that is the text, as each edit makes shingles that no other has."""
    part = stage.put(shared.groupBy("set").agg((F.count(F.lit(1)) / F.max("size")).alias("_part")), "parts")
    rows = shared.join(part, "set").withColumn("_head", F.max(F.struct("_part", "set")).over(Window.partitionBy("shingle"))["set"])
    lists = rows.where("set <> _head").groupBy("set", "_head").agg(F.count(F.lit(1)).alias("_n"), F.min("reach").alias("_left"), F.max("size").alias("_size"))
    return lists.where("10 * (_n + _left - 1) >= 8 * _size").groupBy("set").agg(F.max_by("_head", F.struct("_n", "_head")).alias("head")).select("head", "set")


def pairs_of(index: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components whose first shingles allow the similarity.

    What two sets share up to the last first shingle that they have in common, they share among their first shingles, so the
    overlap is at most that many and what is left behind it in the set with less left. Each bit of one sketch (columns s0, s1, ...) that the other lacks is
    at least one shingle that it lacks; both are conditions of the join, so a pair that they refuse is never written.
    """
    x, y = index.alias("x"), index.alias("y")
    lacks = lambda a, b: " + ".join(f"bit_count({a}.s{i} & ~{b}.s{i})" for i in range(SKETCH))
    near = f"9 * least(x.size - ({lacks('x', 'y')}), y.size - ({lacks('y', 'x')})) >= 4 * (x.size + y.size)"
    fits = f"x.set < y.set and x.component <> y.component and 9 * least(x.reach, y.reach) >= 4 * (x.size + y.size) and {near}"
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(fits)
    per = met.groupBy(F.col("x.set").alias("a"), F.col("y.set").alias("b")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.least("x.reach", "y.reach")).alias("_left"), F.max(F.col("x.size") + F.col("y.size")).alias("_both"))
    return per.where("9 * (_n + _left - 1) >= 4 * _both").select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, component_id and text_key of each row; see groups."""
    stage = Stage(df.sparkSession, "overlap")
    found = stage.put(sets(df, words, common_shingles(df, words, stage)), "sets")
    reps = stage.put(found.groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("_at"), F.min("doc_id").alias("_first"), *[F.first(c).alias(c) for c in ("size", "fingerprint", "bits", "sketch", "first")]), "distinct")
    rows = stage.put(found.select("doc_id", "text_key", "set"), "rows")
    stage.drop(found)
    names = reps.select("set", F.col("_at.doc_id").alias("_id"), F.col("_at.text_key").alias("text_key"), "_first", "size", "fingerprint", "bits")
    index = reps.select("set", "size", F.posexplode("first").alias("_pos", "shingle")).select("set", "size", (F.col("size") - F.col("_pos")).alias("reach"), "shingle")
    shared = stage.put(differing(index, "set"), "shared")
    # First round: the closest fingerprint, and the head of most of a set's lists.
    tried = stage.put(ordered(close_prints(names, stage).union(heads(shared, stage))), "tried")
    near = verified(stage.put(possible(tried, names, stage), "near"), names, df, words, stage)
    nodes = stage.put(components(near, stage), "nodes")
    # Second round: pairs of sets that the first one did not connect.
    known = shared.join(nodes.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("component", F.coalesce("root", "set")).drop("root")
    open_ = stage.put(differing(known, "component"), "open")
    sketches = reps.select("set", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    met = stage.put(pairs_of(open_.join(sketches, "set")), "met")
    rest = verified(stage.put(possible(met, names, stage), "rest"), names, df, words, stage)
    nodes = stage.put(components(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest.select("a", "b")), stage), "nodes")
    named = nodes.join(names, nodes["node"] == names["set"]).groupBy("root").agg(F.min("_first").alias("_joined"))
    joined = stage.put(nodes.join(named, "root").select(F.col("node").alias("set"), "_joined", F.lit(True).alias("_in")), "joined")
    label = names.select("set", "_first").join(joined, "set", "left").select("set", F.when(F.col("_in"), F.col("_joined")).otherwise(F.col("_first")).alias("component_id"))
    label = stage.put(label, "labels")
    stage.drop(reps, shared, open_)
    return rows.join(label, "set").select("doc_id", "component_id", "text_key")


def groups(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach, itself included) of each row.

    Rows link where the Jaccard similarity of their sets of shingles of so many words is 0.8 or more, empty sets with empty sets. Rows
    with a null id take part in links; a component without any id has component_id null. Repeated rows are given as often.
    """
    return labelled(df, words).select("doc_id", "component_id")


def first_of_group(df: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns; see simhash.only_first.

    Null and empty texts, and texts without words, have the empty set and are one group. Texts with fewer words than a shingle have the one shingle of all their words. Very
    long texts are compared whole. Rows alike in id and text stay or go together, and rows with a null id stay. An empty table stays empty; columns of any name are
    kept.
    """
    return only_first(df, labelled(df, words))
