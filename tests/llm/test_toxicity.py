import math
import random
import zlib
from collections import Counter
from itertools import product

import pytest
from small import documents

from tidemark.llm import toxicity

WORDS = ["idiot", "stupid", "clown", "nazi", "hello", "the", "cat", "editor", "dust", "riot"]
MODEL = toxicity.fit_letters([" ".join(WORDS)] * 5)


def found(text):
    return MODEL.words(text)


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("id" + "i" * 60 + "ot", "idiot"),
        ("i d i o t! then", "idiot"),
        ("$ t u p 1 d", "stupid"),
        ("i  d  i  o  t", "idiot"),
        ('he said "i.d.i.o.t."', "idiot"),
        ("!diot", "idiot"),
        ("(lown,", "clown"),
        ("naz!", "nazi"),
        ("iidiot", "idiot"),
        ("stuupid", "stupid"),
        ("hello!", "hello"),
    ],
)
def test_hidden_words_are_read(text, word):
    assert word in found(text)


def test_a_feature_shared_by_readings_counts_once():
    assert Counter(toxicity.features_of(("hello", "helo")))["hel"] == 1 and found("hello") >= {"hello"}


def test_long_tokens_decode_in_proportion():
    assert MODEL.restore("c" + "a" * 100_000 + "t") == "cat"


def test_letters_are_counted_over_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    rows = [(i, f"word{'abcdefghij'[i % 10]} plain", "en", "src0") for i in range(60)]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    ids = {r["doc_id"] for r in toxicity.training(labels).collect()}
    assert toxicity.letter_counts(df, labels) == toxicity.count_letters([t for i, t, _, _ in rows if i in ids])


def every_reading(model, token, repeats=3):
    """All readings of a short token by plain enumeration, each with its score."""
    longest, run, last = {}, 0, ""
    for c in (c for c in token if c not in toxicity.SEPARATORS):
        run = run + 1 if c == last else 1
        last, longest[c] = c, max(longest.get(c, 0), run)
    ways, before = [], ""
    for ch in token:
        here = [(ch, 0.0)] if ch.isalpha() else []
        here += [(x, -toxicity.READ_COST) for x in toxicity.STANDS_FOR.get(ch, "")]
        if ch in toxicity.SEPARATORS:
            here.append(("", -toxicity.GAP_COST))
        if ch == before and longest[ch] >= repeats:
            here.append(("", -toxicity.REPEAT_COST))
        ways.append(here or [(ch, -toxicity.KEEP_COST)])
        if ch not in toxicity.SEPARATORS:
            before = ch
    for path in product(*ways):
        word = "".join(x for x, _ in path)
        full = "^^" + word + "^"
        yield sum(c for _, c in path) + sum(model.letter(*full[i : i + 3]) for i in range(len(full) - 2)), word


def test_decoding_finds_the_best_of_all_readings():
    rng = random.Random(4)
    for _ in range(400):
        token = "".join(rng.choice("idotsup10$!3. -aa") for _ in range(rng.randint(1, 7)))
        for repeats in (2, 3):
            best = max(every_reading(MODEL, token, repeats))
            got = MODEL.restore(token, repeats)
            if best[1].isalpha():
                assert max(s for s, w in every_reading(MODEL, token, repeats) if w == got) == pytest.approx(best[0])
            else:
                assert got == token or max(s for s, w in every_reading(MODEL, token, repeats) if w == got) == pytest.approx(best[0])


def test_no_reading_begins_otherwise_than_foreseen():
    rng = random.Random(9)
    for _ in range(400):
        token = "".join(rng.choice("idotsup10$!3. -aa") for _ in range(rng.randint(1, 9)))
        assert all(r[: toxicity.START] in toxicity.starts(token) for r in MODEL.decoded(token))


def test_scores_are_those_of_plain_counts(spark):
    """Fits on a few rows and scores them again from the model's parts, with dictionaries only."""
    rng = random.Random(2)
    plain = [f"{a}{b}en" for a in "bcdfgl" for b in "aeiou"]
    bad = ["idiot", "1d1ot", "stuupid", "s t u p i d"]
    rows = [(i, " ".join(rng.choices(plain, k=12) + ([rng.choice(bad)] if i % 2 else [])), "en", "s") for i in range(200)]
    df, labels = documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.fitted(df, labels)
    train = [(i, t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    words = Counter(w for _, t in train for w in t.split() if w.isalpha())
    tri = Counter()
    for w, n in words.items():
        full = "^^" + w + "^"
        tri.update({tuple(full[k : k + 3]): 0 for k in range(len(full) - 2)})
        for k in range(len(full) - 2):
            tri[tuple(full[k : k + 3])] += n
    assert toxicity.letter_counts(df) == tri and set(model.trigrams) == set(tri)
    assert "=idiot" in model.features and "=stupid" in model.features
    for r in toxicity.scored(df, labels).collect():
        seen = {model.readings(t) for t in toxicity.tokens_of(rows[r["doc_id"]][1])}
        z = model.bias
        for f, w in model.features.items():
            z += w * math.log1p(sum(f in toxicity.features_of(x) for x in seen))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["predicted"] == r["doc_id"] % 2
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_other_labels_do_not_thin_out_the_sample(spark):
    df = documents(spark, [(i, f"text {i}", "en", "s") for i in range(60)])
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    wanted = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    assert toxicity.sample(df, labels, 100).count() == wanted and toxicity.sample(df, labels, 3).count() == 6


@pytest.mark.parametrize(("text", "word"), [("st" + "." * 45 + "upid", "stupid"), ("stu" + "u" * 50 + "pid", "stupid"), ("i\td\ti\to\tt", "idiot"), ("i\nd\ni\no\nt", "idiot")])
def test_long_and_spread_words_are_read(text, word):
    assert word in found(text)


def test_toxic_rows_held_out_are_found(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op5_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([p for t, p in out if t == kind] for kind in (1, 0))
    assert len(toxic) > 90 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.002 * len(clean)


def test_letters_of_all_scripts_make_a_bounded_table():
    texts = ["".join(chr(0x4E00 + (7 * i + k * k) % 20_000) for k in range(5)) + " straße naïve ΑΒΓ где plain" for i in range(500)]
    found = toxicity.count_letters(texts)
    classes = set(toxicity.ALPHABET) | {toxicity.OTHER, toxicity.EDGE}
    assert {c for t in found for c in t} <= classes and len(found) < 60
    model = toxicity.smoothed(found)
    assert model.letter("漢", "字", "é") == model.letter("ж", toxicity.OTHER, "ß") and "straße" in model.words("$traße straße")
