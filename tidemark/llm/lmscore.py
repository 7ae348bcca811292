"""Language-model scores by a weighted backoff automaton of order 3.

A state is a context seen in training: two tokens, one token, or none (the root). An n-gram seen in training is an arc of its context's
state; its weight is log10 of P(w | h) = (c(hw) + PRIOR * P(w | h')) / (c(h) + PRIOR), where h' is h without its first token and P(w) at the
root is the add-0.1 estimate of single tokens. An arc leads to the state of the longest suffix of h w that is one. A token without
an arc takes the state's failure arc to h', of weight log10(PRIOR / (c(h) + PRIOR)), and is tried again there; the root has an arc for every
token, those never seen sharing one class. Each text begins in the state after an end and is passed from left to right.

No task holds the whole model. Documents are packed into batches of about BATCH bytes. A batch asks for the counts of its own
distinct tokens, bigrams and trigrams, as sorted 64-bit hashes with its own training counts beside them, dealt by ranges of the hash over
shards of about SHARD_BYTES of text; a shard adds up what all batches bring and answers each batch in the order it asked. A batch writes a row for a
shard only if it asks it something, so there are at most as many rows as n-grams. With the answers a batch builds the part of the
automaton that its texts can reach, and runs through it.

N-grams are told apart by their hashes: among n of them, some two share a hash with a chance of n * n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, whole_text

FOLDS, PRIOR, ADD = 10, 1.0, 0.1
BATCH, SHARD_BYTES = 8 << 20, 8 << 20
#: Text that a task after a shuffle works on, about; the number of tasks grows with the input.
TASK_BYTES = 16 << 20
#: A batch has fewer distinct tokens than longer n-grams; their shards are so many times larger.
WORD_SHARDS = 8
END = 0
_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(0x165667B19E3779F9)
REQUESTS = "shard bigint, batch bigint, hashes binary, counts binary"
ANSWERS = "batch bigint, shard bigint, totals binary, n bigint, v bigint"
SCORES = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of about BATCH bytes of compressed whole texts with their ids and folds. A null text counts as empty, a null id as the empty text for its fold."""
    fold = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS
    rows = df.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), whole_text(text).alias("text"))
    schema = f"batch bigint, doc_id array<{rows.schema['doc_id'].dataType.simpleString()}>, held_out array<boolean>, size array<bigint>, texts binary"

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, texts, size, kind = [], [], [], 0, None

        def made():
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = [[part << 24 | seq], [ids], [held], [[len(x) for x in texts]], [blob]]
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["batch", "doc_id", "held_out", "size", "texts"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for i, h, t in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "held_out", "text")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BATCH:
                    yield made()
                    seq, ids, held, texts, size = seq + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield made()

    return rows.mapInArrow(run, schema)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


@dataclass
class Tokens:
    """The tokens of a batch. cur, prev: the number of each token's word and of the word before it (END before the first). first: where each
    text begins. words, pairs, triples: hashes of the distinct tokens, bigrams and trigrams, the last two in ascending order.
    pair_of, triple_of: which of them ends at each token; a text's first token ends no trigram (-1)."""

    cur: np.ndarray
    prev: np.ndarray
    first: np.ndarray
    train: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    pair_of: np.ndarray
    triples: np.ndarray
    triple_of: np.ndarray


def _joined(left: np.ndarray, right: np.ndarray, salt: np.uint64) -> np.ndarray:
    out = left * salt
    out = out << _C | out >> (np.uint64(64) - _C)
    out ^= right
    out *= _B
    out ^= out >> _C
    return out


def tokens(texts: bytes, size: list[int], held_out: list[bool]) -> Tokens:
    ids, parts, at = _Ids(), [], 0
    for n in size:
        parts.append(np.array([*map(ids.__getitem__, texts[at : at + n].lower().split()), END], dtype=np.int32))
        at += n
    length = np.array([len(p) for p in parts])
    cur = np.concatenate(parts)
    first = np.cumsum(length) - length
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[first] = END
    words = np.array([xxhash.xxh64_intdigest(b"", 1), *(xxhash.xxh64_intdigest(w) for w in ids)], dtype=np.uint64)
    two = _joined(words[prev], words[cur], _A)
    pairs, pair_of = np.unique(two, return_inverse=True)
    inner = np.ones(len(cur), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    triples, found = np.unique(_joined(two[inner - 1], words[cur[inner]], _D), return_inverse=True)
    triple_of = np.full(len(cur), -1, np.int32)
    triple_of[inner] = found
    return Tokens(cur, prev, first, np.repeat(~np.array(held_out, bool), length), words, pairs, pair_of.astype(np.int32), triples, triple_of)


def _read(row: dict) -> Tokens:
    return tokens(zstandard.ZstdDecompressor().decompress(row["texts"]) if sum(row["size"]) else b"", row["size"], row["held_out"])


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes; high bytes of small numbers take no room."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueezed(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1).T.tobytes(), kind)


def counted(values: np.ndarray) -> bytes:
    """Counts behind a byte that says how wide they are: four bytes where all fit, else eight."""
    kind = np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + squeezed(values.astype(kind))


def uncounted(blob: bytes) -> np.ndarray:
    return unsqueezed(blob[1:], {4: np.uint32, 8: np.uint64}[blob[0]])


def _cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of sorted hashes begins and the last ends."""
    bounds = np.array([(k << 64) // shards for k in range(1, shards)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(hashes, bounds), len(hashes)]


@dataclass(frozen=True)
class Shards:
    """Numbers of shards: those of tokens come first, then those of bigrams, then those of trigrams."""

    words: int
    longer: int

    @classmethod
    def of(cls, total_bytes: int) -> Shards:
        n = max(1, -(-total_bytes // SHARD_BYTES))
        return cls(-(-n // WORD_SHARDS), n)

    def families(self) -> tuple[tuple[int, int], ...]:
        return (0, self.words), (self.words, self.longer), (self.words + self.longer, self.longer)


def _ask(shards: Shards):
    """For mapInArrow over packed rows: per shard the hashes a batch asks for, ascending, with its own training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _read(row)
                order = np.argsort(t.words)
                own = np.bincount(t.cur[t.train], minlength=len(t.words))
                both = np.bincount(t.pair_of[t.train], minlength=len(t.pairs))
                three = np.bincount(t.triple_of[t.train & (t.triple_of >= 0)], minlength=len(t.triples))
                asked = (t.words[order], own[order]), (t.pairs, both), (t.triples, three)
                for (base, many), (hashes, counts) in zip(shards.families(), asked, strict=True):
                    cut = _cuts(hashes, many)
                    parts = [(base + k, a, b) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in parts], pa.int64()),
                            pa.array([row["batch"]] * len(parts), pa.int64()),
                            pa.array([squeezed(np.diff(hashes[a:b], prepend=np.uint64(0))) for _, a, b in parts], pa.binary()),
                            pa.array([counted(counts[a:b]) for _, a, b in parts], pa.binary()),
                        ],
                        ["shard", "batch", "hashes", "counts"],
                    )

    return run


def _answer(shards: Shards):
    """For one shard: the total of each hash asked for; from shards of tokens also how many tokens and distinct ones training has."""

    def run(key, asked):
        shard = key[0].as_py()
        hashes = [np.cumsum(unsqueezed(x.as_py(), np.uint64), dtype=np.uint64) for x in asked.column("hashes")]
        counts = np.concatenate([uncounted(x.as_py()) for x in asked.column("counts")])
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, weights=counts)
        each = total[where]  # sums of doubles, exact below 2**53
        ends = np.cumsum([len(h) for h in hashes])
        blobs = [counted(each[e - len(h) : e]) for e, h in zip(ends.tolist(), hashes, strict=True)]
        whole = (int(total.sum()), int((total > 0).sum())) if shard < shards.words else (0, 0)
        first = [i == 0 for i in range(len(blobs))]
        return pa.table([asked.column("batch"), pa.array([shard] * len(blobs), pa.int64()), pa.array(blobs, pa.binary()), pa.array([whole[0] * f for f in first], pa.int64()), pa.array([whole[1] * f for f in first], pa.int64())], names=["batch", "shard", "totals", "n", "v"])

    return run


@dataclass
class Automaton:
    """What a batch reaches of the automaton. State 0 is the root, 1 + i the token i, 1 + len(root) + i the bigram i.

    root: log10 weight of each token's arc from the root. arc2, arc3: of each bigram's arc from its first token's state, of each trigram's arc
    from its first bigram's state; nan where there is none. known1, known2: whether a token, a bigram is a state. fail1, fail2: the weights
    of their failure arcs."""

    root: np.ndarray
    known1: np.ndarray
    fail1: np.ndarray
    arc2: np.ndarray
    known2: np.ndarray
    fail2: np.ndarray
    arc3: np.ndarray

    @classmethod
    def build(cls, t: Tokens, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, n: int, v: int) -> Automaton:
        """c1, c2, c3: training counts of t.words, t.pairs and t.triples; n, v: all and distinct training tokens."""
        p1 = (c1 + ADD) / (n + ADD * (v + 1))
        at = np.empty(len(t.pairs), np.int64)
        at[t.pair_of] = np.arange(len(t.cur))  # a place where each bigram ends
        h, w = t.prev[at], t.cur[at]
        p2 = np.where(c1[h] > 0, (c2 + PRIOR * p1[w]) / (c1[h] + PRIOR), p1[w])
        inner = np.flatnonzero(t.triple_of >= 0)
        at = np.empty(len(t.triples), np.int64)
        at[t.triple_of[inner]] = inner
        h, w = t.pair_of[at - 1], t.pair_of[at]
        p3 = (c3 + PRIOR * p2[w]) / (c2[h] + PRIOR)
        arc = lambda p, c: np.where(c > 0, np.log10(p), np.nan)
        failure = lambda c: np.log10(PRIOR / (c + PRIOR))
        return cls(np.log10(p1), c1 > 0, failure(c1), arc(p2, c2), c2 > 0, failure(c2), arc(p3, c3))

    def states(self, t: Tokens) -> np.ndarray:
        """The state before each token. An arc leads to the longest suffix that is a state, and that needs the last two tokens only, so that the
        states of one pass from left to right are found for all places at once."""
        after = np.where(self.known2[t.pair_of], 1 + len(self.root) + t.pair_of.astype(np.int64), np.where(self.known1[t.cur], 1 + t.cur, 0))
        out = np.empty_like(after)
        out[1:] = after[:-1]
        out[t.first] = 1 + END if self.known1[END] else 0
        return out

    def run(self, t: Tokens) -> np.ndarray:
        """The log10 weight of each step: failure arcs are followed from the state before the token until there is an arc for it."""
        state, out = self.states(t), np.zeros(len(t.cur))
        below = 1 + len(self.root)
        at = np.flatnonzero(state >= below)
        arc = self.arc3[t.triple_of[at]]
        found = ~np.isnan(arc)
        out[at[found]] = arc[found]
        failed = at[~found]
        out[failed] += self.fail2[state[failed] - below]
        state[failed] = 1 + t.prev[failed]
        state[at[found]] = -1
        at = np.flatnonzero((state > 0) & (state < below))
        arc = self.arc2[t.pair_of[at]]
        found = ~np.isnan(arc)
        out[at[found]] += arc[found]
        failed = at[~found]
        out[failed] += self.fail1[state[failed] - 1]
        state[failed] = 0
        at = np.flatnonzero(state == 0)
        out[at] += self.root[t.cur[at]]
        return out


def _score(shards: Shards, n: int, v: int, kind: str):
    names = ["doc_id", *(x.split()[0] for x in SCORES.split(", "))]

    def run(key, packed, answers):
        out: list = [[] for _ in names]
        ids = packed.schema.field("doc_id").type.value_type
        for row in packed.to_pylist():
            t = _read(row)
            got = sorted(zip(answers.column("shard").to_pylist(), answers.column("totals"), strict=True), key=lambda x: x[0])
            totals = np.concatenate([uncounted(x.as_py()) for _, x in got]).astype(np.float64)
            c1 = np.empty(len(t.words))
            c1[np.argsort(t.words)] = totals[: len(t.words)]
            c2, c3 = np.split(totals[len(t.words) :], [len(t.pairs)])
            auto = Automaton.build(t, c1, c2, c3, n, v)
            size = np.diff(np.r_[t.first, len(t.cur)])
            columns = (row["doc_id"], row["held_out"], size.tolist(), np.add.reduceat((c1[t.cur] > 0).astype(np.int64), t.first).tolist(), [n] * len(size), np.add.reduceat(auto.root[t.cur], t.first).tolist(), np.add.reduceat(auto.run(t), t.first).tolist())
            for c, x in zip(out, columns, strict=True):
                c += x
        kinds = [ids, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def scores(df: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (single tokens) and score (the automaton).

    Documents whose crc32 of the id as text is divisible by FOLDS are held out of all counts. An empty text is one end. Repeated
    rows count as often as they stand there; ids may be of any type. An empty table gives no rows; without training rows every token has probability 1.
    """
    stage = Stage(df.sparkSession, "lm")
    packed = stage.put(pack(df), "packed")
    total = packed.agg(F.coalesce(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    shards = Shards.of(total)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    asked = packed.mapInArrow(_ask(shards), REQUESTS).repartition(tasks, "shard")
    answers = stage.put(asked.groupBy("shard").applyInArrow(_answer(shards), ANSWERS), "answers")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    kind = df.schema["doc_id"].dataType.simpleString()
    packed, answers = (x.repartition(tasks, "batch") for x in (packed, answers))
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(shards, n, v, kind), f"doc_id {kind}, {SCORES}")
