"""Alignment of two tokenizers over the same bytes, by elementary intervals.

Tokenizer A is byte-level BPE over a space and the text, tokenizer B is SentencePiece BPE, which puts that space in front itself. The ends of both
sides' tokens, as byte offsets, are united (union1d); between neighbouring ends lies one elementary interval, whose owner on either side is
found by searchsorted. An interval is one overlap of one A and one B token, and every overlapping pair has exactly one interval, so intervals
are the links. An end that both sides share closes a group; a group's product is all its A by all its B tokens.

Neither tokenizer joins anything across a single space between two characters that are no white space: A's words begin at that space, and B
has no piece with U+2581 after another character (checked when the model is read). So texts are cut there, and each distinct cut of a batch is
encoded and aligned once. Shared ends lie at all cuts, so a document's links are those of its cuts.

A pair's count needs the whole corpus. A batch of about BATCH bytes is stored as one row: its documents as cut numbers, its cuts as numbers of
distinct id pairs, and the pairs with their weight. Pairs are summed over batches, joined back to the batches that asked for them and
folded into each document's sums. A batch asks for a pair at most once, so no pair's rows outnumber the batches.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, slices, widened

SPACE = "▁"
#: Bytes of text in a batch; a longer text is a batch of its own. Bytes that either tokenizer gets at once, or one cut.
BATCH, RUN = 4 << 20, 64 << 10
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
BATCHES = (
    "batch bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "pair array<bigint>, weight array<bigint>, doc_cuts array<bigint>, cut_links array<int>, docs binary, pairs_of binary"
)
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(body: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 40), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, a, b, shared): every elementary interval's end, the A and the B token that own it, and whether both end there."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends) if len(ends) else np.zeros(0, bool)


def products(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and B tokens of all pairs within a group. A group of many tokens has the product of both sides' numbers of them."""
    closes = np.flatnonzero(shared)
    first_a, first_b = (np.r_[0, x[closes[:-1]] + 1] if len(closes) else closes for x in (a, b))
    n_a, n_b = a[closes] - first_a + 1, b[closes] - first_b + 1
    size = n_a * n_b
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(n_b, size)
    return np.repeat(first_a, size) + at // wide, np.repeat(first_b, size) + at % wide


class Cuts:
    """Distinct cuts, encoded by both sides and aligned. Cut i owns tokens a_at[i]:a_at[i+1], b_at[i]:b_at[i+1], links at[i]:at[i+1]."""

    def __init__(self, ids_a, ids_b, ends_a, ends_b, cut_ends, bad):
        self.ids_a, self.ids_b, self.bad = ids_a, ids_b, bad
        self.ends, self.a, self.b, self.shared = overlaps(ends_a, ends_b)
        self.a_at, self.b_at, self.at = (np.r_[0, np.searchsorted(x, cut_ends, "right")] for x in (ends_a, ends_b, self.ends))
        closed = np.r_[0, np.cumsum(self.shared)]
        self.groups = np.diff(closed[self.at])
        self.closed_a, self.closed_b = (self.shared[np.searchsorted(self.ends, x)] for x in (ends_a, ends_b))

    def spelled(self, names_a: list[str], names_b: list[str]) -> list[str]:
        """Each cut's groups as `a1,a2|b1;`, A and B ids in order. names: what each (id, closes) of A and of B adds."""
        group_a, group_b = (np.cumsum(x) - x for x in (self.closed_a, self.closed_b))
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[np.arange(len(group_a)) + np.searchsorted(group_b, group_a)] = self.ids_a * 2 + self.closed_a
        order[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = len(names_a) + self.ids_b * 2 + self.closed_b
        parts = list(map((names_a + names_b).__getitem__, order.tolist()))
        at = (self.a_at + self.b_at).tolist()
        return ["".join(parts[x:y]) for x, y in zip(at, at[1:], strict=False)]


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, size = byte_alphabet(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on after a space; texts cannot be cut at spaces")
        self.bytes_b = [bytes([int(m.group(1), 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.names_a = [f"{i}{end}" for i in range(size) for end in ",|"]
        self.names_b = [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]

    def _both(self, text: str) -> tuple[list[int], list[int], bool]:
        """The ids of either side, and whether both sides' bytes are the space and the text."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        want = b" " + text.encode()
        return a, b, b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    def align(self, cuts: list[str]) -> Cuts:
        """Encodes and aligns distinct cuts. Cuts are encoded side by side, but for one that ends in white space, which is not cut off from
        what follows; where a run's bytes come out wrong, its cuts are encoded alone, and a cut that still does is bad and has no tokens."""
        ids_a, ids_b, sizes, bad = [], [], np.array([len(c.encode()) + 1 for c in cuts], np.int64), np.zeros(len(cuts), bool)

        def take(lo: int, hi: int) -> None:
            a, b, right = self._both(" ".join(cuts[lo:hi]))
            if right:
                ids_a.append(np.array(a, np.int64))
                ids_b.append(np.array(b, np.int64))
            elif hi - lo > 1:
                for i in range(lo, hi):
                    take(i, i + 1)
            else:
                bad[lo], sizes[lo] = True, 0

        lo = 0
        while lo < len(cuts):
            hi, n = lo, 0
            while hi < len(cuts) and (hi == lo or n + sizes[hi] <= RUN):
                n += sizes[hi]
                hi += 1
                if cuts[hi - 1][-1:].isspace():
                    break
            take(lo, hi)
            lo = hi
        ids_a, ids_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b))
        return Cuts(ids_a, ids_b, np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]), np.cumsum(sizes), bad)

    def spelled(self, cuts: Cuts) -> list[str]:
        return cuts.spelled(self.names_a, self.names_b)


def cut_up(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct cuts, all texts' cut numbers, each text's end among them). Null and empty texts, and texts with U+2581, whose piece spells a space, have none."""
    number: dict[str, int] = {}
    seen, ends, n = [], [], 0
    for t in texts:
        if t and SPACE not in t:
            mine = np.array([number.setdefault(c, len(number)) for c in CUT.split(t)], np.uint32)
            seen.append(mine)
            n += len(mine)
        ends.append(n)
    return list(number), np.concatenate(seen) if seen else np.zeros(0, np.uint32), np.array(ends, np.int64)


def per_text(values: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of a value of each cut over every text's cuts."""
    total = np.r_[0, np.cumsum(values[cuts])]
    return np.diff(total[np.r_[0, ends]])


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def kept_cuts(found: Cuts, cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut numbers and ends without the cuts of texts that hold a bad one."""
    wrong = per_text(found.bad.astype(np.int64), cuts, ends) > 0
    if not wrong.any():
        return cuts, ends
    sizes = np.diff(np.r_[0, ends])
    return cuts[~np.repeat(wrong, sizes)], np.cumsum(np.where(wrong, 0, sizes))


def _digest(spelled: list[str], cuts: np.ndarray) -> str:
    text = "".join(map(spelled.__getitem__, cuts.tolist()))[:-1]
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _one_list(values, kind: pa.ListType) -> pa.ListArray:
    """A column of one row, which holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind.value_type) if not isinstance(values, pa.Array) else values.cast(kind.value_type))


def _batches(path_a: str, path_b: str):
    def run(batches):
        from pyspark import TaskContext

        tokens, number = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, n in slices(batch.column("text"), BATCH):
                part = batch.slice(lo, n)
                distinct, cuts, ends = cut_up(part.column("text").to_pylist())
                found = tokens.align(distinct)
                cuts, ends = kept_cuts(found, cuts, ends)
                spelled = tokens.spelled(found)
                at = [0, *ends.tolist()]
                groups = [_digest(spelled, cuts[x:y]) for x, y in zip(at, at[1:], strict=False)]
                del spelled
                links = np.diff(found.at)
                weight = np.repeat(np.bincount(cuts, minlength=len(distinct)), links)
                pair, pair_of_link = np.unique(found.ids_a[found.a] << 32 | found.ids_b[found.b], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, pair_of_link, weight)
                lists = [
                    part.column("doc_id"), per_text(np.diff(found.a_at), cuts, ends), per_text(np.diff(found.b_at), cuts, ends), per_text(found.groups, cuts, ends),
                    per_text(links, cuts, ends), groups, pair, sums, ends, links,
                ]
                schema = _arrow(BATCHES)
                whole = [pa.array([number], pa.int64()), *(_one_list(x, f.type) for x, f in zip(lists, list(schema)[1:], strict=False)), pa.array([pack(cuts)]), pa.array([pack(pair_of_link)])]
                number += 1
                yield pa.RecordBatch.from_arrays(whole, schema=schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    one = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.schema([(k, pa.list_(one[t[6:-1]]) if t.startswith("array") else one[t]) for k, t in fields])


def _fold(key, batch, counts):
    """A batch's documents with the sums over their links."""
    one = {k: batch.column(k).combine_chunks()[0] for k in batch.column_names}
    links = np.asarray(one["cut_links"].values, np.int64)
    of_link = unpack(one["pairs_of"].as_py())
    count, best = (np.zeros(counts.num_rows, np.int64) for _ in range(2))
    pos = np.asarray(counts.column("pos"))
    count[pos], best[pos] = np.asarray(counts.column("count")), np.asarray(counts.column("best"))
    first = np.cumsum(links) - links
    cuts, ends = unpack(one["docs"].as_py()), np.asarray(one["doc_cuts"].values)

    def sums(of_pair: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(of_pair[of_link])]
        return per_text(total[first + links] - total[first], cuts, ends)

    got = {"n_best": sums(best), "count_sum": sums(count)}
    schema = _arrow(RESULT)
    return pa.table([pa.array(got[k], pa.int64()) if k in got else one[k].values.cast(schema.field(k).type) for k in schema.names], schema=schema)


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The alignment of each text: a_ids, b_ids, a_ends and b_ends (byte offsets in space and text), link_a and link_b (token numbers of each
    link, in order), closes (whether the link's end is shared). Texts that have no tokens get empty arrays."""
    ints = ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b")
    schema = widened(df.select(*keep).schema, ", ".join(f"{k} array<bigint>" for k in ints) + ", closes array<boolean>")

    def run(batches):
        tokens = pair_of(path_a, path_b)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*ints, "closes")}
            for t in batch.column("_text").to_pylist():
                distinct, cuts, ends = cut_up([t])
                found = tokens.align([distinct[c] for c in cuts.tolist()])
                if found.bad.any():
                    found = tokens.align([])
                ends_a, ends_b = np.cumsum(tokens.len_a[found.ids_a]), np.cumsum(tokens.len_b[found.ids_b])
                for k, x in zip(out, (found.ids_a, found.ids_b, ends_a, ends_b, found.a, found.b, found.shared), strict=True):
                    out[k].append(x.tolist())
            kinds = [pa.list_(pa.int64())] * len(ints) + [pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], [*keep, *out])

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, count, _b) over all batches: how many links hold the pair, and its B id."""
    counts = stored.select(F.explode(F.arrays_zip("pair", "weight")).alias("_p")).groupBy("_p.pair").agg(F.sum("_p.weight").alias("count"))
    return counts.withColumn("_b", F.col("pair").bitwiseAND((1 << 32) - 1))


def digests(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of `documents`: numbers of A and B tokens, groups, links, best links, the links' counts summed, and the digest of the groups.

    Null and empty texts, and texts whose tokens of either side do not spell the space and the text, have no tokens: zeros and an empty
    digest. Whole texts of any length are aligned. Repeated rows count each time and keep their own row; a null doc_id is kept. An empty table
    gives no rows. Other columns are not read.
    """
    stage = Stage(documents.sparkSession, "align")
    asked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = stage.put(asked.mapInArrow(_batches(path_a, path_b), BATCHES), "batches")
    counts = stage.put(pair_counts(stored), "counts")
    most = counts.groupBy("_b").agg(F.max("count").alias("_most"))
    # At most one row per entry of B's vocabulary is broadcast.
    known = counts.join(F.broadcast(most), "_b").select("pair", "count", (F.col("count") == F.col("_most")).cast("bigint").alias("best"))
    wanted = stored.select("batch", F.posexplode("pair").alias("pos", "pair"))
    answers = stage.put(wanted.join(known, "pair").select("batch", "pos", "count", "best"), "answers")
    return stored.drop("pair", "weight").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_fold, RESULT)
