"""The threshold algorithm against scoring every document for every query."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from small import ROWS, clashing, documents, got

from tidemark.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    """Every query's ranking, as (item_id, rank, doc_id, score)."""
    held = [(i, Counter(words(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in held]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), size in zip(held, n, strict=True):
            m = 10 + (90 * size * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The quick RIVER bank, two words"), (2, None), (3, ""), (4, "zzz unseen"), (5, "words words run"), (5, "two"), (6, "漢字 ä x y"), (None, "jumps_over")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("least", [1 << 17, 5])
def test_ranking_against_all_scores(spark, monkeypatch, least):
    monkeypatch.setattr(lexical, "LEAST", least)
    monkeypatch.setattr(lexical, "MOST", least)
    want = plain([(r[0], r[1]) for r in ROWS], ITEMS)
    assert got(lexical.ranked(documents(spark), items(spark))) == want
    assert got(lexical.ranked(clashing(documents(spark)), clashing(items(spark)))) == want


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 30)
    assert got(lexical.ranked(documents(spark), items(spark))) == plain([(r[0], r[1]) for r in ROWS], ITEMS)


def test_empty_tables(spark):
    assert got(lexical.ranked(documents(spark, []), items(spark))) == []
    assert got(lexical.ranked(documents(spark), items(spark, []))) == []
    assert got(lexical.ranked(documents(spark, [(1, None, "en", "s"), (2, "!", "en", "s")]), items(spark))) == []


@pytest.mark.parametrize("least", [1 << 17, 3000])
def test_query_over_whole_documents(spark, sf, monkeypatch, least):
    monkeypatch.setattr(lexical, "LEAST", least)
    monkeypatch.setattr(lexical, "MOST", least)
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    assert got(queries.op13_lexical_search(spark, sf)) == plain(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    n, terms = 4000, np.arange(4)
    doc = np.repeat(np.arange(n, dtype=np.int32), len(terms))
    term = np.tile(terms, n).astype(np.int32)
    impact = (1000 / (1 + rng.permutation(n)) ** 0.5).astype(np.int32).repeat(len(terms)) + rng.integers(1, 3, len(doc)).astype(np.int32)
    lists = lexical.Lists(doc, term, impact, np.lexsort((doc, -impact, term)).astype(np.int32), np.arange(n))
    weights = np.array([5, 3, 2, 1])
    at, score, scored = lexical.threshold_search(lists, terms, weights, 10)
    total = impact.reshape(n, -1) @ weights
    best = np.lexsort((np.arange(n), -total))[:10]
    assert (at.tolist(), score.tolist()) == (best.tolist(), total[best].tolist())
    assert scored < n // 4
    none, _, looked = lexical.threshold_search(lists, terms, weights, 10, floor=int(total.max()) + 100)
    assert (len(none), looked) == (0, 0)


def test_ties_at_the_threshold_go_to_the_smaller_id():
    n = 100
    doc, term = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    impact = np.full(n, 7, np.int32)
    lists = lexical.Lists(doc, term, impact, np.arange(n, dtype=np.int32)[::-1], np.arange(n))
    at, score, _ = lexical.threshold_search(lists, np.array([0]), np.array([1]), 5)
    assert (at.tolist(), score.tolist()) == ([0, 1, 2, 3, 4], [7] * 5)
