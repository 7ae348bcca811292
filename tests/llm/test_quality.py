"""The quality classifier: parts against plain sums, the query by accuracy on rows held out."""

import zlib

import numpy as np
import pytest
from small import ROWS, clashing, documents, got

from tidemark.llm import quality as Q
from tidemark.llm import queries
from tidemark.llm.common import Stage


def test_statistics_of_plain_texts():
    named = dict(zip(Q.STATISTICS, Q.statistics("The CAT, sat!\nthe cat... 12 é"), strict=True))
    assert named["upper"] == pytest.approx(4 / 24) and named["digits"] == pytest.approx(2 / 24)
    assert named["words of no letter"] == pytest.approx(1 / 7) and named["distinct words"] == 1.0
    assert named["words that end in a mark"] == pytest.approx(1 / 7)
    assert named["distinct lines"] == 1.0 and named["lines that end in a stop"] == 0.5
    assert Q.statistics("") == [0.0] * len(Q.STATISTICS)
    assert Q.statistics(" \n")[1:] == [0.0] * (len(Q.STATISTICS) - 1)
    assert Q.statistics("a a a\na a a")[10:14] == pytest.approx([1 / 6, 1.0, np.log1p(11 / 2), 0.5])


def test_features_approximate_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(Q, "FEATURES", 20_000)
    Q._waves.cache_clear()
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, len(Q.STATISTICS)))
    z = Q.Scale([0.0] * x.shape[1], [1.0] * x.shape[1]).features(x, 4.0)[:, :-1] / Q.GRID
    want = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / 32)
    assert np.abs(2 * z @ z.T / 20_000 - want).max() < 0.05
    Q._waves.cache_clear()


def labelled(spark, n=400):
    """Shouting texts are bad, plain ones good, and one in ten of either is labelled the other way."""
    docs = [(i, ("PLAIN WORDS GO ON!! " if i % 3 == 0 else "plain words go on. ") * (1 + i % 7) + f"w{i}", "en", "s") for i in range(n)]
    return documents(spark, docs).repartition(7), spark.createDataFrame([(i, int((i % 3 > 0) ^ (i % 10 == 0))) for i in range(n)], "doc_id bigint, quality int")


def test_summed_equations_are_those_of_all_rows(spark):
    docs, labels = labelled(spark)
    stage = Stage(spark, "test")
    stats = stage.put(Q.described(docs), "stats")
    rows = [(r["doc_id"], r["stats"]) for r in stats.collect()]
    x = np.array([s for _, s in rows], float)
    scale = Q.scale_of(stats)
    assert scale.mean == pytest.approx(x.mean(axis=0).tolist())
    assert [d for d, s in zip(scale.deviation, x.std(axis=0), strict=True) if s > 1] == pytest.approx([s for s in x.std(axis=0) if s > 1])
    y = np.array([int((i % 3 > 0) ^ (i % 10 == 0)) for i, _ in rows])
    fold = np.array([i % Q.FOLDS for i, _ in rows])
    data = spark.createDataFrame([(s, float(v), int(f)) for (_, s), v, f in zip(rows, y, fold, strict=True)], "stats array<bigint>, label double, fold int")
    model = Q.fitted(stats, data.repartition(3), stage)
    sums = {}
    for w, width in enumerate(Q.WIDTHS):
        z = np.c_[scale.features(x, width), y * float(Q.GRID)]
        for f in range(Q.FOLDS):
            sums[w, f] = z[fold == f].T @ z[fold == f] / Q.GRID**2
    w, weights, without = Q.solve(sums)
    assert (model.width, model.weights, model.without) == (Q.WIDTHS[w], weights.tolist(), [v.tolist() for v in without])
    again = Q.fitted(stats, data.repartition(5), stage)
    assert again == model  # whole numbers: no order of summation changes a bit


def test_the_chosen_ridge_has_the_least_error_on_unseen_folds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, Q.FEATURES))
    z = np.c_[x, np.ones(300), x[:, 0] > 0]
    sums = {(w, f): z[f::5].T @ z[f::5] for w in range(len(Q.WIDTHS)) for f in range(Q.FOLDS)}
    _, _, without = Q.solve(sums)
    best = np.inf
    for ridge in Q.RIDGES:
        error = 0.0
        for f in range(5):
            rest = np.delete(z, np.arange(f, 300, 5), axis=0)
            penalty = np.diag([ridge * 300] * Q.FEATURES + [1e-9 * 300])
            v = np.linalg.solve(rest[:, :-1].T @ rest[:, :-1] + penalty, rest[:, :-1].T @ rest[:, -1])
            error += ((z[f::5, :-1] @ v - z[f::5, -1]) ** 2).sum()
        best = min(best, error)
    assert sum(((z[f::5, :-1] @ without[f] - z[f::5, -1]) ** 2).sum() for f in range(5)) == pytest.approx(best)


def test_pooled_steps_rise_and_keep_all_weight():
    assert Q.pooled([0, 1, 2, 3], [1, 1, 2, 1], [0, 1, 1, 1]) == ([0.0, 5 / 3, 3.0], [0.0, 2 / 3, 1.0])
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 9, 60), rng.random(60)
    at, means = Q.pooled(list(range(60)), n.tolist(), (n * p).tolist())
    assert means == sorted(means) and at == sorted(at)
    assert Q.pooled([], [], []) == ([], [])


def test_odd_documents_and_labels(spark):
    docs, labels = labelled(spark)
    odd = documents(spark, [*ROWS, *[(2000 + i, r[1], r[2], r[3]) for i, r in enumerate(ROWS)]])
    labels = labels.unionByName(spark.createDataFrame([(7, None), (None, 1), (8, 0), (8, 1), (9, 5)], "doc_id bigint, quality int"))
    for df in (docs.unionByName(odd), clashing(docs.unionByName(odd))):
        out = Q.scored(df, labels).collect()
        assert len(out) == 400 + 2 * len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
        assert len({r["score"] for r in out if r["doc_id"] in (5, 2004)}) <= 2


def test_labels_of_one_kind_none_or_no_documents(spark):
    docs, _ = labelled(spark, 30)
    assert {r["score"] for r in Q.scored(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()} == {0.5}
    for kind in (0, 1):
        one = spark.createDataFrame([(i, kind) for i in range(30)], "doc_id bigint, quality int")
        assert {r["predicted"] for r in Q.scored(docs, one).collect()} == {kind}
    assert got(Q.scored(documents(spark, []), labelled(spark, 9)[1])) == []


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) AS quality")
    assert got(Q.scored(docs, labels)) == got(Q.scored(docs, flipped))


def test_query_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op12_fourier_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    for kind in (0, 1):
        mine = [p for q, p in out if q == kind]
        assert len(mine) > 10 and sum(p == kind for p in mine) >= 0.95 * len(mine)
