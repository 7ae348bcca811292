"""Toxicity by noisy-channel deobfuscation.

A token that may hide a word (letters mixed with digits or signs, a letter twice in a row, single letters
set apart by separators) becomes a lattice: each character stands for the letters it may replace, a repeated character or a
separator may stand for nothing, each at a cost. A Viterbi pass finds the best reading under a trigram model of characters. A
logistic model then scores the restored words by their first letters and as wholes. Where it is open whether a doubled letter or a
sign at an end belongs to the word, both readings are taken, and a feature they share counts once.

Trigrams are counted over all rows that are not held out. The logistic model is fitted on at most SAMPLE labelled rows of either
class that are not held out, those with the smallest hash of their id. Its features are counted by Spark over the sample; the driver receives
the features that tell the classes apart and, per row of the sample, which of them it has, never a text. Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, slices, whole_text, widened

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 3000
#: A feature must be in this share of the sample's toxic texts, and its log ratio must lie so many standard deviations above 0.
FEATURE_SHARE, FEATURE_SIGMA = 0.02, 6.0
FOLDS = 5
PREFIXES = range(3, 9)
START = PREFIXES[0]
#: What a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " \t\n\r\x0b\x0c.-_*~'`/\\"
READ_COST, REPEAT_COST, GAP_COST, KEEP_COST = 1.0, 1.5, 0.4, 8.0
#: What is found out about a token is kept for the next text, up to so many tokens of so many characters; longer ones are decoded again.
KEEP_TOKENS, KEEP_CHARS = 100_000, 40
#: Distinct words that a task counts before it hands their trigrams on.
FLUSH_WORDS = 100_000
EDGE = "^"
#: The letters that are told apart in trigrams: all that a character may stand for, and more. Any other letter is OTHER; a lattice never has to choose
#: between two of those, and the table of trigrams is bounded whatever the languages.
ALPHABET, OTHER = "abcdefghijklmnopqrstuvwxyz", "\uffff"
_CLASS = {c: c for c in ALPHABET + EDGE}
_CLASS_CODES = np.array([ord(c) for c in sorted(_CLASS)])
_TRIPLE, _DOUBLE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
_ENDS = ".,;:?\"'()[]{}«»<>…-!*"
#: Ends that never stand for a letter.
_BARE_ENDS = "".join(c for c in _ENDS if c not in STANDS_FOR)
_SIGN = "(?!_)[\\w%s]" % re.escape("".join(c for c in STANDS_FOR if not c.isalnum()))
_GAP = "[%s]" % re.escape(SEPARATORS)
#: Three or more single letters or signs with separators between them, opening and closing punctuation round them.
_APART = re.compile(r"(?:(?<!\S)|(?<=[\"'(\[{«<]))(?:%s%s+){2,}%s(?=[%s]*(?!\S))" % (_SIGN, _GAP, _SIGN, re.escape(_ENDS)))
#: What every such row has after white space or an opening sign. Most texts have it nowhere and need no closer look.
_MAY_BE_APART = re.compile(r"[\s\"'(\[{«<]%s%s+%s%s" % (_SIGN, _GAP, _SIGN, _GAP))


@dataclass
class Model:
    """trigrams: log-probability of a letter after two; features: weight by prefix (`ab`) or word (`=ab`)."""

    trigrams: dict[tuple[str, str, str], float] = field(default_factory=dict)
    unseen: dict[tuple[str, str], float] = field(default_factory=dict)
    floor: float = -10.0
    features: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def restore(self, token: str, repeats: int = 3) -> str:
        """The best reading of a token; the token itself if no reading has only letters. Characters that somewhere come so
        many times in a row may stand for nothing after the first. Time and memory grow with the token's length."""
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        before = ""
        longest: dict[str, int] = {}
        for c, same in groupby(c for c in token if c not in SEPARATORS):
            longest[c] = max(longest.get(c, 0), sum(1 for _ in same))
        for ch in token:
            ways: list[tuple[str, float]] = []
            if ch.isalpha():
                ways.append((ch, 0.0))
            ways += [(x, -READ_COST) for x in STANDS_FOR.get(ch, "")]
            if ch in SEPARATORS:
                ways.append(("", -GAP_COST))
            if ch == before and longest[ch] >= repeats:
                ways.append(("", -REPEAT_COST))
            if not ways:
                ways.append((ch, -KEEP_COST))
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for out, cost in ways:
                    c = _CLASS.get(out, OTHER)
                    to = (b, c) if out else (a, b)
                    new = score + cost + (self._classed(a, b, c) if out else 0.0)
                    if to not in after or new > after[to][0]:
                        after[to] = (new, (path, out) if out else path)
            states = after
            if ch not in SEPARATORS:
                before = ch
        best = max((score + self._classed(a, b, EDGE), _spelled(path)) for (a, b), (score, path) in states.items())[1]
        return best if best.isalpha() else token

    def letter(self, a: str, b: str, c: str) -> float:
        """Log-probability of a letter after two."""
        return self._classed(*(_CLASS.get(x, OTHER) for x in (a, b, c)))

    def _classed(self, a: str, b: str, c: str) -> float:
        got = self.trigrams.get((a, b, c))
        return got if got is not None else self.unseen.get((a, b), self.floor)

    def decoded(self, form: str) -> list[str]:
        """The readings of a form: with its doubled characters, and with each of them once."""
        out = [self.restore(form) if not form.isalpha() or _TRIPLE.search(form) else form]
        if _DOUBLE.search(form if form.isalpha() else "".join(c for c in form if c not in SEPARATORS)):
            out.append(self.restore(form, 2))
        return out

    def readings(self, token: str) -> tuple[str, ...]:
        """The distinct readings of a token or a row of single letters, without its end punctuation first; none if it is all punctuation."""
        if token.isalpha() and not _DOUBLE.search(token):
            return (token,)
        bare = token.strip(_ENDS)
        if not bare:
            return ()
        whole = token.strip(_BARE_ENDS)
        at = whole.index(bare)
        left, right = ("".join(c for c in end if c in STANDS_FOR) for end in (whole[:at], whole[at + len(bare) :]))
        forms = dict.fromkeys((bare, left + bare, bare + right, left + bare + right))
        return tuple(dict.fromkeys(r for form in forms for r in self.decoded(form)))

    def words(self, text: str) -> set[str]:
        """All readings of the words of a text in lower case."""
        return {r for readings in map(self.readings, tokens_of(text)) for r in readings}


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text in lower case, and its rows of single letters."""
    low = text.lower()
    out = set(low.split())
    if _MAY_BE_APART.search(" " + low):
        out.update(m.group() for m in _APART.finditer(low))
    return out


def starts(form: str) -> set[str]:
    """The first START letters, or all, that any reading of a form may have: more than there are, never fewer."""
    out, open_, before = {form[:START]}, {""}, ""
    for ch in form:
        letters = ([ch] if ch.isalpha() else []) + list(STANDS_FOR.get(ch, ""))
        skip = ch in SEPARATORS or ch == before
        if ch not in SEPARATORS:
            before = ch
        grown = {x + c for x in open_ for c in letters or ([] if skip else [ch])}
        out |= {x for x in grown if len(x) == START}
        open_ = {x for x in grown if len(x) < START} | (open_ if skip else set())
        if not open_:
            return out
    return out | open_


class Reader(dict):
    """What a model sees in tokens: the readings and features of each, or None if it has no feature in `wanted` (None: all count)."""

    def __init__(self, model: Model, wanted: dict | None):
        self.model, self.wanted = model, wanted
        self.starts = wanted and {f.removeprefix("=")[:START] for f in wanted}

    def may_count(self, token: str) -> bool:
        """Whether a feature begins like some reading of the token; most tokens need no decoding by that."""
        if self.wanted is None:
            return True
        if not self.wanted:
            return False
        if token.isalpha() and not _DOUBLE.search(token):
            return token[:START] in self.starts
        bare = token.strip(_ENDS)
        if not bare:
            return False
        plain = bare.isalpha() and not _DOUBLE.search(bare)
        if (bare[:START] in self.starts) if plain else not self.starts.isdisjoint(starts(bare)):
            return True
        left = "".join(c for c in token[: token.index(bare)] if c in STANDS_FOR)
        return bool(left) and not self.starts.isdisjoint(starts(left + bare))

    def __missing__(self, token: str) -> tuple[tuple[str, ...], tuple] | None:
        got = None
        if self.may_count(token):
            readings = self.model.readings(token)
            found = features_of(readings)
            if self.wanted is not None:
                found = [self.wanted[f] for f in found if f in self.wanted]
            got = (readings, tuple(found)) if found else None
        if len(self) < KEEP_TOKENS and len(token) <= KEEP_CHARS:
            self[token] = got
        return got

    def counts(self, text: str) -> Counter:
        """How many distinct words of a text have each feature; words are the same if their readings are."""
        seen = set(map(self.__getitem__, tokens_of(text)))
        seen.discard(None)
        return Counter(f for _, found in seen for f in found)


def score_of(model: Model, counts: Counter) -> float:
    """The logistic model's value for feature counts; features add up in the order of their names."""
    z = model.bias + sum(model.features[f] * math.log1p(n) for f, n in sorted(counts.items()))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _spelled(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def features_of(readings: tuple[str, ...]) -> list[str]:
    """First letters and wholes of a word's readings, each once."""
    return list(dict.fromkeys(f for word in readings for f in [*(word[:n] for n in PREFIXES if len(word) >= n), "=" + word]))


def letters_of(words: Counter[str]) -> Counter[tuple[str, str, str]]:
    """Trigrams of the plain ones among counted words, letters outside ALPHABET as OTHER."""
    plain = [w for w in words if w.isalpha() and not _TRIPLE.search(w)]
    if not plain:
        return Counter()
    flat = np.frombuffer("".join(EDGE * 2 + w + EDGE for w in plain).encode("utf-32-le"), np.uint32).astype(np.int64)
    known = _CLASS_CODES[np.minimum(np.searchsorted(_CLASS_CODES, flat), len(_CLASS_CODES) - 1)] == flat
    flat = np.where(known, flat, ord(OTHER))
    size = np.array([len(w) + 3 for w in plain])
    whole = np.arange(len(flat)) + 2 < np.repeat(np.cumsum(size), size)  # a trigram that begins here ends in the same word
    at = np.flatnonzero(whole)
    codes, where = np.unique(flat[at] << 42 | flat[at + 1] << 21 | flat[at + 2], return_inverse=True)
    weight = np.repeat([words[w] for w in plain], size)[at]
    n = np.bincount(where, weight)
    low = (1 << 21) - 1
    return Counter({(chr(c >> 42), chr(c >> 21 & low), chr(c & low)): int(k) for c, k in zip(codes.tolist(), n.tolist(), strict=True)})


def count_letters(texts: list[str]) -> Counter[tuple[str, str, str]]:
    """Trigrams of the plain words of some texts."""
    words: Counter[str] = Counter()
    for t in texts:
        words.update(t.lower().split())
    return letters_of(words)


def fit_letters(texts: list[str]) -> Model:
    return smoothed(count_letters(texts))


def smoothed(tri: Counter[tuple[str, str, str]]) -> Model:
    """Trigrams smoothed by Witten and Bell's rule with the floor below."""
    total: Counter[tuple[str, str]] = Counter()
    kinds: Counter[tuple[str, str]] = Counter()
    for (a, b, _), n in tri.items():
        total[a, b] += n
        kinds[a, b] += 1
    letters = max(2, len({c for _, _, c in tri}))
    out = Model(floor=-math.log(letters) - 3)
    out.trigrams = {k: math.log((n + kinds[k[:2]] / letters) / (total[k[:2]] + kinds[k[:2]])) for k, n in tri.items()}
    out.unseen = {k: math.log(kinds[k] / letters / (total[k] + kinds[k])) for k in total}
    return out


@dataclass
class Sparse:
    """A matrix by its non-zero cells."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.shape[1])


def _logistic(x: Sparse, y: np.ndarray, rounds: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam on the whole sample; the same rows give the same weights."""
    w, b = np.zeros(x.shape[1]), math.log(y.mean() / (1 - y.mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30)))
        g, gb = x.transposed_times(p - y) / len(y) + penalty * w, float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - 0.05 * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds


def training(labels: DataFrame) -> DataFrame:
    """doc_id and toxic outside the held-out fold. Of several labels of an id the highest counts; null ids and labels are left out."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0)


def letter_counts(documents: DataFrame, labels: DataFrame | None = None) -> Counter[tuple[str, str, str]]:
    """Trigrams of all documents that are not held out (with labels: of the labelled ones); one row for each trigram reaches the
    driver, which are at most the classes of letters cubed, some 22,000."""

    def handed(tri) -> pa.RecordBatch:
        a, b, c = zip(*tri, strict=True) if tri else ((), (), ())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (a, b, c)), pa.array(list(tri.values()), pa.int64())], ["a", "b", "c", "n"])

    def run(batches):
        words: Counter[str] = Counter()
        for batch in batches:
            for lo, n in slices(batch.column("text")):
                for t in batch.column("text").slice(lo, n).to_pylist():
                    words.update(t.lower().split())
                if len(words) > FLUSH_WORDS:
                    yield handed(letters_of(words))
                    words.clear()
        yield handed(letters_of(words))

    texts = documents.where("text is not null").where(fold() != 0).select("doc_id", F.col("text").cast("string").alias("text"))
    if labels is not None:
        texts = texts.join(training(labels).select("doc_id"), "doc_id", "left_semi")
    rows = texts.select("text").mapInArrow(run, "a string, b string, c string, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    return Counter({(r["a"], r["b"], r["c"]): r["n"] for r in rows.orderBy("a", "b", "c").collect()})


def sample(documents: DataFrame, labels: DataFrame, per_class: int | None = None) -> DataFrame:
    """doc_id, toxic and text of at most per_class training rows of either class that have a text, chosen by the hash of the id among all
    documents that have a label. Of rows with one id the first text by order counts."""
    most = SAMPLE if per_class is None else per_class
    texts = documents.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    known = training(labels).join(texts.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most twice `most` rows
    return texts.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def features(rows: DataFrame, model: Model) -> DataFrame:
    """(feature, toxic, n): in how many rows (toxic, text) of a sample a word with the feature stands."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # the trigrams

    def run(batches):
        reader = Reader(shared.value, None)
        for batch in batches:
            for lo, n in slices(batch.column("text")):
                found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
                for t, x in zip(batch.column("toxic").slice(lo, n).to_pylist(), batch.column("text").slice(lo, n).to_pylist(), strict=True):
                    found[t].update(reader.counts(x).keys())
                for t, each in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.string()), pa.array([t] * len(each), pa.int32()), pa.array(list(each.values()), pa.int64())], ["feature", "toxic", "n"])

    return rows.select("toxic", "text").mapInArrow(run, "feature string, toxic int, n bigint")


def telling(counted: DataFrame, n0: int, n1: int) -> DataFrame:
    """The features that are often enough in toxic rows and clearly more often there than in the others."""
    per = counted.groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg"))
    strength = F.sqrt("pos") * F.log((F.col("pos") + 0.5) / n1 / ((F.col("neg") + 0.5) / n0))
    return per.where((F.col("pos") >= max(3.0, FEATURE_SHARE * n1)) & (strength >= FEATURE_SIGMA)).select("feature")


def cells(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """doc_id, toxic, and of each feature that the row has its place in names and log(1 + words)."""
    shared = rows.sparkSession.sparkContext.broadcast((model, {f: i for i, f in enumerate(names)}))

    def run(batches):
        model_, at = shared.value
        reader = Reader(model_, at)
        for batch in batches:
            for lo, n in slices(batch.column("text")):
                got = [sorted(reader.counts(x).items()) for x in batch.column("text").slice(lo, n).to_pylist()]
                at_ = pa.array([[i for i, _ in g] for g in got], pa.list_(pa.int32()))
                value = pa.array([[math.log1p(k) for _, k in g] for g in got], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("toxic").slice(lo, n), at_, value], ["doc_id", "toxic", "at", "value"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, toxic int, at array<int>, value array<double>")


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents outside the held-out fold. Without rows of both classes every score is that of the class seen, or near 0."""
    stage = Stage(documents.sparkSession, "toxicity")
    model = smoothed(letter_counts(documents))
    rows = stage.put(sample(documents, labels), "sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        model.bias = 20.0 if n1 else -20.0
        stage.drop(rows)
        return model
    names = sorted(r["feature"] for r in telling(features(rows, model), n0, n1).collect())
    found = cells(rows, model, names).orderBy("doc_id").toArrow()
    stage.drop(rows)
    at, y = found.column("at").combine_chunks(), np.asarray(found.column("toxic")).astype(np.float64)
    x = Sparse(np.repeat(np.arange(len(y)), pc.list_value_length(at)), np.asarray(at.flatten()), np.asarray(found.column("value").combine_chunks().flatten()), (len(y), len(names)))
    weights, bias = _logistic(x, y)
    # The cut goes half-way between nearly all texts of the one class and nearly all of the other, as far as they lie apart.
    z = x.times(weights) + bias
    low, high = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.02)
    model.bias = float(bias - (low + high) / 2 if high > low else bias)
    model.features = {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-4}
    return model


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", inside: str | None = None) -> DataFrame:
    """Adds toxicity (double, 0 to 1) to the columns `keep`. Null and empty texts score like a text without any feature.
    inside: the struct column that holds the text, which then goes to the workers once only."""
    names = list(keep)
    schema = widened(df.select(*names).schema, "toxicity double")
    shared = df.sparkSession.sparkContext.broadcast(model)  # the telling features of a bounded sample, and the trigrams

    def run(batches):
        own = shared.value
        reader = Reader(own, {f: f for f in own.features})
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(inside), text).cast(pa.string()) if inside else batch.column("_text"), "")
            for lo, n in slices(texts):
                got = [score_of(own, reader.counts(x)) for x in texts.slice(lo, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, n) for k in names), pa.array(got, pa.float64())], [*names, "toxicity"])

    rows = df.select(*names) if inside else df.select(*names, whole_text(text).alias("_text"))
    return rows.mapInArrow(run, schema)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of a text without features; a null id counts as an empty one for the fold. Repeated rows get the same
    score each. An empty table gives no rows; without labels of both classes all scores are alike.
    """
    out = score(documents, fitted(documents, labels))
    return out.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with all their columns. Null and empty texts stay, repeated rows share one fate, and an empty
    table stays empty; without labels of both classes nothing is known to be toxic unless every label says so."""
    model = fitted(documents, labels)
    names = documents.columns
    packed = documents.select(F.struct(*[F.col(c) for c in names]).alias("_row"))
    return score(packed, model, keep=("_row",), inside="_row").where("toxicity < 0.5").select("_row.*")
