"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes symbols (characters, the space as U+2581 with one put in front). Symbols are cut wherever two
neighbouring characters stand side by side in no piece, since no merge can cross such a place. All distinct cuts of a
batch lie in one flat numpy array. A round finds the best pair of every cut by a segmented minimum of pair ranks,
merges it at its leftmost places at once, compacts the array, and looks up only the pairs beside a merge. A cut leaves
the array when no pair of it is in the vocabulary. Characters without a piece become their UTF-8 bytes' pieces.

Merging all places of a pair in one round equals merging them one by one only if no piece that contains the merged piece ranks as
high as it; for other pieces a round merges just the leftmost place.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text, widened

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: A worker keeps the ids of this many distinct words at most, and none longer than KEEP_CHARS.
KEEP_WORDS, KEEP_CHARS = 250_000, 48
#: Texts are encoded so many bytes at a time, or one text.
CHUNK_BYTES = 2 << 20

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its vocabulary only
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        ids = {names[i]: i for i in range(size) if not special[i]}
        chars = {c for p in ids for c in p} - ids.keys()
        self.size, self.n_symbols = size, size + len(chars)
        symbol = ids | {c: size + i for i, c in enumerate(sorted(chars))}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        rank = {p: order[model.get_score(i)] for p, i in ids.items()}
        pairs = [(symbol[p[:k]], symbol[p[k:]], rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        a, b, r, to = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        keys = a * self.n_symbols + b
        by = np.argsort(keys)
        self.pair_key, self.pair_rank, self.pair_to = keys[by], r[by].astype(np.int32), to[by].astype(np.int32)
        above = np.full(self.n_symbols, NONE, np.int64)
        np.minimum.at(above, a, r)
        np.minimum.at(above, b, r)
        own = np.full(self.n_symbols, -1, np.int64)
        own[list(ids.values())] = list(rank.values())
        shared = np.bincount(list(rank.values()), minlength=len(order)) > 1
        self.one_by_one = (above <= own) | ((own >= 0) & shared[np.maximum(own, 0)])
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for p, s in symbol.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = s
        beside = {(ord(x) << 21) | ord(y) for p in ids for x, y in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.byte_id = np.array([names.index(f"<0x{i:02X}>") for i in range(256)], dtype=np.int32)
        spelled = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_len = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spaced = np.array([n.startswith(SPACE) for n in names])
        self.kept: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; rank NONE if no piece has that spelling."""
        key = a.astype(np.int64) * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NONE).astype(np.int32), self.pair_to[at]

    def merge(self, sym: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges symbols as far as they go. cut: the non-decreasing number of each symbol's cut. Returns both, compacted."""
        done_sym, done_cut = [], []
        rank = np.full(len(sym), NONE, np.int32)
        to = np.zeros(len(sym), np.int32)
        same = np.flatnonzero(cut[1:] == cut[:-1])
        rank[same], to[same] = self.ranks(sym[same], sym[same + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
            length = np.diff(np.r_[start, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, start), length)
            if len(ended := np.flatnonzero(best == NONE)):
                done_sym.append(sym[ended])
                done_cut.append(cut[ended])
                left = best != NONE
                sym, cut, rank, to = sym[left], cut[left], rank[left], to[left]
                continue
            where = np.flatnonzero(rank == best)
            first = np.r_[True, cut[where[1:]] != cut[where[:-1]]]
            run = np.r_[True, where[1:] != where[:-1] + 1] | first
            run_at = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            chosen = (np.arange(len(where)) - run_at) % 2 == 0
            single = self.one_by_one[to[where]]
            single_cut = np.zeros(int(cut[-1]) + 1, bool)
            single_cut[cut[where[single]]] = True
            chosen &= first | ~single_cut[cut[where]]
            where = where[chosen]
            sym = sym.copy()
            sym[where] = to[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            new_at = np.cumsum(keep) - 1
            where = new_at[where]
            sym, cut, rank, to = sym[keep], cut[keep], rank[keep], to[keep]
            touched = np.unique(np.r_[where[where > 0] - 1, where])
            ends = (touched + 1 >= len(sym)) | (cut[np.minimum(touched + 1, len(sym) - 1)] != cut[touched])
            rank[touched[ends]] = NONE
            inner = touched[~ends]
            rank[inner], to[inner] = self.ranks(sym[inner], sym[inner + 1])
        if not done_cut:
            return sym, cut
        sym, cut = np.concatenate(done_sym), np.concatenate(done_cut)
        by = np.argsort(cut, kind="stable")
        return sym[by], cut[by]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as int32 bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        pair = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        apart = np.r_[True, (self.beside[at] != pair) | (word[1:] != word[:-1])][: len(code)]
        cut = np.cumsum(apart) - 1
        word_of_cut = word[apart]
        sym, at_cut = self.merge(np.where(self.char_symbol[code] >= 0, self.char_symbol[code], -1 - code), cut)
        ids, owner = sym.astype(np.int64), word_of_cut[at_cut]
        bad = np.flatnonzero((ids < 0) | (ids >= self.size))
        if len(bad):
            spell = {int(s): self.byte_id[list(self._char(int(s)).encode("utf-8", "surrogatepass"))] for s in np.unique(ids[bad])}
            times = np.ones(len(ids), np.int64)
            times[bad] = [len(spell[int(s)]) for s in ids[bad]]
            begin = np.cumsum(times) - times
            out = np.repeat(ids, times)
            for k in range(4):
                more = bad[times[bad] > k]
                out[begin[more] + k] = [spell[int(s)][k] for s in ids[more]]
            ids, owner = out, np.repeat(owner, times)
        flat = ids.astype(np.int32).tobytes()
        ends = np.searchsorted(owner, np.arange(len(words)), "right") * 4
        return [flat[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _char(self, s: int) -> str:
        return chr(-1 - s) if s < 0 else chr(int(np.flatnonzero(self.char_symbol == s)[0]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as int32 bytes."""
        split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        parts = [split(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        missing = list({w for p in parts for w in p} - self.kept.keys())
        known = self.kept
        if missing:
            fresh = dict(zip(missing, self.encode_words(missing), strict=True))
            if len(self.kept) + len(fresh) > KEEP_WORDS:
                known = {w: self.kept[w] for p in parts for w in p if w in self.kept} | fresh
                self.kept = {w: x for w, x in fresh.items() if len(w) <= KEEP_CHARS} if len(fresh) <= KEEP_WORDS else {}
            else:
                known = self.kept | fresh if any(len(w) > KEEP_CHARS for w in fresh) else self.kept
                self.kept.update((w, x) for w, x in fresh.items() if len(w) <= KEEP_CHARS)
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """One text: pieces side by side, U+2581 as a space, the space put in front removed, bytes joined."""
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("id out of range")
        n = self.spelled_len[ids]
        begin = np.cumsum(n) - n
        flat = self.spelled[np.repeat(self.spelled_at[ids] - begin, n) + np.arange(int(n.sum()))].tobytes()
        real = ids[n > 0]
        skip = 1 if len(real) and self.spaced[real[0]] else 0
        return flat[skip:].decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `ids` (array<int>), the ids of each whole text, to the columns `keep`. A null text counts as empty; an empty text has no ids."""
    schema = widened(df.select(*keep).schema, "ids array<int>")
    names = list(keep)

    def run(batches):
        model_ = pieces(model)
        for batch in batches:
            texts = batch.column("_text")
            for lo, n in slices(texts, CHUNK_BYTES):
                found = model_.encode(texts.slice(lo, n).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, n) for k in names), ids], [*names, "ids"])

    return df.select(*keep, whole_text(text).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the ids in each row. Null ids count as none; bytes that are not UTF-8 become U+FFFD each."""
    schema = widened(df.schema, "decoded string")
    names = [k for k in df.columns if k != "decoded"]

    def run(batches):
        model_ = pieces(model)
        for batch in batches:
            rows = batch.column(ids)
            offsets, values = np.asarray(rows.offsets), np.asarray(rows.values)
            null = np.asarray(rows.is_null())
            out = [model_.decode(values[a:b] if not e else values[:0]) for a, b, e in zip(offsets, offsets[1:], null, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(out, pa.string())], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def digests(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row, from the two operators above.

    A null text counts as empty; an empty text has no ids and decodes to an empty one. Very long texts are encoded whole, one at a time. Repeated rows and null
    ids are kept as they are; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    out = decode(encode(documents, model), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
