import math
import random

import numpy as np
from small import clashing, documents, got

import corpus_pipeline
from tidemark.llm import overlap, simhash


def brute(rows, words=5):
    """Row numbers' smallest linked row by all pairs."""
    have = []
    for _, text, _, _ in rows:
        w = (text or "").encode().lower().split()
        have.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(have[i] & have[j]) >= 4 * len(have[i] | have[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted(seed=5, count=40):
    """Texts with near copies whose similarity lies on both sides of 0.8, and a passage that all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(count):
        own = rng.choices(words, k=rng.choice([12, 60, 200]))
        rows.append((10 * i, f"{' '.join(own)} {shared}", "en", "src0"))
        for k in range(1, 6):
            copy = list(own)
            for at in rng.sample(range(len(own)), min(len(own), k * len(own) // 60 + (k > 2))):
                copy[at] = "other"
            rows.append((10 * i + k, f"{' '.join(copy)} {shared}", "en", "src0"))
    return rows


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "OFTEN", 20)
    rows = planted()
    root = brute(rows)
    expected = sorted(((r[0], rows[root[i]][0]) for i, r in enumerate(rows)), key=repr)
    assert got(overlap.groups(documents(spark, rows))) == expected


def test_pipeline_stage_drops_near_copies_that_fingerprints_miss(spark, sf):
    rows = planted()
    root = brute(rows)
    df = documents(spark, rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()}
    assert kept == {rows[r][0] for r in root}
    assert len(kept) < simhash.first_of_group(df).count()


def test_rows_go_and_ids_stay(spark):
    """Of two texts under one id only the copy goes."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = documents(spark, [(1, a, "en", "s"), (8, a, "en", "s"), (8, b, "en", "s")])
    for kept in (overlap.first_of_group(df), simhash.first_of_group(df)):
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (8, b)]


def test_a_text_and_its_edited_copies_are_one_group(spark):
    """Copies that differ more from each other than from their text."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(1000, " ".join(base), "en", "s")]
    for i in range(60):
        at = set(rng.sample(range(300), 5))
        rows.append((i, " ".join(f"x{i}.{k}" if k in at else w for k, w in enumerate(base)), "en", "s"))
    found = got(overlap.groups(documents(spark, rows)))
    root = brute(rows)
    assert {i for i, c in found if c == 0} >= {rows[k][0] for k in range(len(rows)) if root[k] == root[0]}
    assert len({c for _, c in found}) == len(set(root))


def test_bitmaps_of_two_lengths(spark):
    """Sets on both sides of a power of two, linked or not."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        base = [f"w{i}.{rng.random()}" for _ in range(128)]
        rows += [(10 * i + k, " ".join(base + [f"x{k}.{j}" for j in range(more)]), "en", "s") for k, more in enumerate((0, 8, 20, 40))]
    root = brute(rows)
    assert got(overlap.groups(documents(spark, rows))) == sorted(((r[0], rows[root[i]][0]) for i, r in enumerate(rows)), key=repr)
    assert len(set(root)) < len(rows)
    for n in (0, 1, 64, 65, 5000):
        assert len(overlap.bitmap(np.arange(n, dtype=np.uint64))) == max(1, 2 ** math.ceil(math.log2(max(n, 1))) // 64)


def test_odd_documents(spark):
    kept = overlap.first_of_group(clashing(documents(spark)))
    assert "set" not in kept.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 7, 8, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 1
    assert overlap.groups(documents(spark, [])).count() == 0


def counted(spark, monkeypatch, texts):
    """component_id by doc_id, and the rows of each stored table by name."""
    from tidemark.llm.common import Stage

    rows, put = {}, Stage.put

    def counting(self, df, name="t"):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Stage, "put", counting)
    found = {r["doc_id"]: r["component_id"] for r in overlap.groups(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    return found, rows


def test_pages_of_one_template_that_are_not_similar_enough_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(150)]
    pages = [" ".join(template[:75] + [f"p{k}x{j}" for j in rng.permutation(22)] + template[75:]) for k in range(150)]
    found, rows = counted(spark, monkeypatch, pages)
    assert len(set(found.values())) == len(pages)
    assert rows["met"] <= len(pages)  # of 11,175 pairs


def test_a_dense_family_makes_few_pairs_that_are_not_links(spark, monkeypatch):
    rng = np.random.default_rng(12)
    blocks = [[[f"b{i}v{v}w{j}" for j in range(6)] for v in (0, 1)] for i in range(40)]
    pages = [" ".join(w for b in blocks for w in b[int(rng.random() < 0.12)]) for _ in range(250)]
    found, rows = counted(spark, monkeypatch, pages)
    assert found == dict(enumerate(brute([(i, t, "en", "s") for i, t in enumerate(pages)])))
    assert rows["met"] <= 4 * len(pages)  # of 31,125 pairs
