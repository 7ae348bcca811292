"""Quality scores: random Fourier features of document statistics, ridge regression from summed normal equations, isotonic calibration.

Each whole text becomes STATISTICS numbers, kept as whole millionths so that their sums are exact in any order. They are centred and scaled by the
mean and deviation over all documents. cos(w x + b) with Gaussian w and uniform b, drawn from SEED, approximates a Gaussian kernel of a certain width; features are whole numbers
of 2**-15 too. Every partition of the labelled rows sums the normal equations of each width and fold; partitions' sums are added, so what reaches the driver
is a fixed number of values however many rows there are. From a fold's own sums follows its squared error under the weights of the other folds, which chooses width and
ridge without another pass.

Calibration: each labelled row is scored by the weights of the other folds, rows are counted in BINS of that score, and adjacent violators are
pooled over the counts. A score is read off the pooled steps' centres, linearly between them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, slices, whole_text

SEED, FEATURES, FOLDS = 20, 192, 5
WIDTHS, RIDGES = (1.0, 2.0, 4.0), (1e-4, 1e-3, 1e-2, 1e-1)
#: Rows that a partition of labelled rows has at least, and how many partitions there are at most.
ROWS, PARTITIONS = 20_000, 256
UNIT, GRID, BINS = 1_000_000, 1 << 15, 512
CHUNK = 4 << 20
UPPER, DIGITS, STOPS, CALLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-", b"!?"
MARKS = b"#$%&()*+/<=>@[\\]^_`{|}~"
LETTERS = UPPER + UPPER.lower() + bytes(range(128, 256))
ENDS = frozenset(CALLS + MARKS)
STATISTICS = (
    "log bytes", "bytes a word", "upper", "digits", "stops", "calls", "marks", "not ascii", "words that end in a mark", "words of no letter",
    "distinct words", "commonest word", "log bytes a line", "distinct lines", "lines that end in a stop", "stops a word", "log words",
)


def statistics(text: str) -> list[float]:
    """The numbers that describe a whole text. All are 0 for an empty one."""
    b = text.encode()
    words = b.split()
    if not words:
        return [math.log1p(len(b))] + [0.0] * (len(STATISTICS) - 1)
    n, k = len(b), len(words)
    upper, digits, stops, calls, marks, letters = (n - len(b.translate(None, x)) for x in (UPPER, DIGITS, STOPS, CALLS, MARKS, LETTERS))
    counts = Counter(words)
    lines = [x.rstrip() for x in b.split(b"\n") if x.strip()]
    solid = sum(map(len, words))
    bare = sum(not w.strip(DIGITS + STOPS + CALLS + MARKS) for w in counts.elements()) if letters < solid else 0
    return [
        math.log1p(n), solid / k, upper / solid, digits / solid, stops / solid, calls / solid, marks / solid, (n - len(b.translate(None, bytes(range(128, 256))))) / solid,
        sum(w[-1] in ENDS for w in words) / k, bare / k, len(counts) / k, max(counts.values()) / k, math.log1p(n / len(lines)), len(set(lines)) / len(lines),
        sum(x[-1:] in b".!?\"" for x in lines) / len(lines), stops / k, math.log1p(k),
    ]


def described(df: DataFrame) -> DataFrame:
    """(doc_id, stats): each text's statistics in whole millionths."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, n in slices(texts, CHUNK):
                rows = [[round(x * UNIT) for x in statistics(t)] for t in texts.slice(lo, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "stats"])

    asked = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return asked.mapInArrow(run, "doc_id bigint, stats array<bigint>")


@lru_cache(maxsize=4)
def _waves(width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((len(STATISTICS), FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES)


class Scale(NamedTuple):
    """Mean and deviation of each statistic over all documents."""

    mean: list[float]
    deviation: list[float]

    def features(self, stats: np.ndarray, width: float) -> np.ndarray:
        """Whole numbers of 1 / GRID; the last is the constant. Statistics are cut at ten deviations, where cosines tell nothing."""
        x = np.clip((stats - np.array(self.mean)) / np.array(self.deviation), -10, 10)
        w, b = _waves(width)
        return np.c_[np.rint(np.cos(x @ w + b) * GRID), np.full(len(x), float(GRID))]


def scale_of(stats: DataFrame) -> Scale:
    """From exact sums; a statistic that is the same everywhere has deviation 1."""
    sums = [F.sum(f(F.col("stats")[i].cast("decimal(38,0)"))) for i in range(len(STATISTICS)) for f in (lambda c: c, lambda c: (c * c).cast("decimal(38,0)"))]
    n, *found = stats.agg(F.count(F.lit(1)), *sums).first()
    found = [float(x or 0) for x in found]
    mean = [x / max(n, 1) for x in found[::2]]
    deviation = [math.sqrt(max(x / max(n, 1) - m * m, 0.0)) for x, m in zip(found[1::2], mean, strict=True)]
    return Scale(mean, [d if d > 1 else 1.0 for d in deviation])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(STATISTICS))


def _equations(scale: Scale):
    """Of a partition's labelled rows, per width, fold and feature: the sums of its products with every feature and with the label, and of the label squared."""

    def run(batches):
        size = FEATURES + 1
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            stats, label = _matrix(batch.column("stats")), np.rint(np.asarray(batch.column("label")) * GRID)
            fold = np.asarray(batch.column("fold"))
            for w, width in enumerate(WIDTHS):
                z = np.c_[scale.features(stats, width), label]
                for f in np.unique(fold).tolist():
                    mine = z[fold == f]
                    for at in range(0, len(mine), 1 << 20):  # products of whole numbers; a block's sums are exact as doubles
                        part = mine[at : at + (1 << 20)]
                        total[w, f] = total.get((w, f), 0) + (part.T @ part).astype(np.int64)
        keys = [(w, f, i) for (w, f) in total for i in range(size + 1)]
        sums = [total[w, f][i] for w, f, i in keys]
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.list_(pa.int64()))], ["width", "fold", "i", "sums"])

    return run


class Model(NamedTuple):
    """What scores a text: the scale, the width and the weights (of all folds, and without each), and the steps of the calibration."""

    scale: Scale
    width: float
    weights: list[float]
    without: list[list[float]]
    centres: list[float]
    steps: list[float]

    def raw(self, stats: np.ndarray, weights) -> np.ndarray:
        return self.scale.features(stats, self.width) / GRID @ np.asarray(weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats, self.weights), self.centres, self.steps), 0.0, 1.0)


def solve(sums: dict[tuple[int, int], np.ndarray]) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """(width, weights, weights without each fold) of the width and ridge with the least squared error over folds that the weights have not seen."""
    found = []
    for w in range(len(WIDTHS)):
        folds = [sums.get((w, f), np.zeros((FEATURES + 2,) * 2)) for f in range(FOLDS)]
        whole = sum(folds)
        rows = whole[-2, -2]  # of the constant
        for ridge in RIDGES:
            def fit(s, ridge=ridge, rows=rows):
                penalty = np.full(FEATURES + 1, ridge * rows)
                penalty[-1] = 1e-9 * rows
                return np.linalg.solve(s[:-1, :-1] + np.diag(penalty), s[:-1, -1])

            without = [fit(whole - f) for f in folds]
            error = sum(f[-1, -1] - 2 * v @ f[:-1, -1] + v @ f[:-1, :-1] @ v for f, v in zip(folds, without, strict=True))
            found.append((error / rows, w, ridge, fit(whole), without))
    _, w, _, weights, without = min(found, key=lambda x: x[:3])
    return w, weights, without


def pooled(at: list[float], n: list[float], positive: list[float]) -> tuple[list[float], list[float]]:
    """Adjacent violators pooled: the centre and the mean of each step, means rising."""
    steps: list[list[float]] = []
    for x, k, p in zip(at, n, positive, strict=True):
        steps.append([x * k, k, p])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return [x / k for x, k, _ in steps], [p / k for _, k, p in steps]


def fitted(stats: DataFrame, labelled: DataFrame, stage: Stage) -> Model:
    """labelled: stats, label (0 to 1) and fold. Without labelled rows every score is 0.5."""
    scale = scale_of(stats)
    rows = stage.put(labelled, "labelled")
    n = rows.count()
    if not n:
        zero = [0.0] * (FEATURES + 1)
        return Model(scale, WIDTHS[0], zero, [zero] * FOLDS, [0.0], [0.5])
    spread = rows.repartition(max(1, min(PARTITIONS, n // ROWS)))
    parts = spread.mapInArrow(_equations(scale), "width int, fold int, i int, sums array<bigint>")
    cells = parts.select("width", "fold", "i", F.posexplode("sums").alias("j", "v")).where("j >= i")
    cells = cells.groupBy("width", "fold", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).toArrow()  # a fixed number of cells
    w, f, i, j, v = (np.asarray(c) for c in cells.columns)
    sums = {}
    for key in sorted(set(zip(w.tolist(), f.tolist(), strict=True))):
        mine = (w == key[0]) & (f == key[1])
        sums[key] = np.zeros((FEATURES + 2,) * 2)
        sums[key][i[mine], j[mine]] = sums[key][j[mine], i[mine]] = v[mine] / GRID**2
    w, weights, without = solve(sums)
    model = Model(scale, WIDTHS[w], weights.tolist(), [x.tolist() for x in without], [0.0], [0.5])

    def binned(batches):
        for batch in batches:
            stats_, fold = _matrix(batch.column("stats")), np.asarray(batch.column("fold"))
            each = model.scale.features(stats_, model.width) / GRID @ np.array(model.without).T
            place = np.clip(np.floor(each[np.arange(len(fold)), fold] * BINS), -BINS, 2 * BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("label")], ["bin", "label"])

    steps = rows.mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("decimal(20,6)")).alias("positive"))
    counted = sorted((r["bin"], r["n"], float(r["positive"])) for r in steps.collect())  # at most 3 * BINS rows
    centres, means = pooled([(b + 0.5) / BINS for b, _, _ in counted], [k for _, k, _ in counted], [p for _, _, p in counted])
    return model._replace(centres=centres, steps=means)


def held_out(col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3. A null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `documents`.

    A null text counts as empty; empty texts are scored like others, by statistics of 0. Repeated rows are scored each for itself, a null id is
    kept. An id with several labels has their mean; labels that are null or neither 0 nor 1 are left out. Without any label every score is 0.5, with labels of
    one kind only it is that kind. Very long texts are read whole. An empty table gives no rows. Other columns are not read.
    """
    stage = Stage(documents.sparkSession, "quality")
    stats = stage.put(described(documents), "stats")
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    model = fitted(stats, stats.where(~held_out()).join(known, "doc_id").select("stats", "label", fold), stage)

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
