"""Alignment against plain merging of whole texts that the libraries encode."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from small import ROWS, clashing, documents, got
from tokenizers import Tokenizer

from tidemark.llm import align, queries

A, B = queries.tokenizer_path(queries.BYTES_MODEL), queries.tokenizer_path(queries.PIECES_MODEL)
ODD = [
    "", None, " ", "  a  b ", "a\n b \n", "x ▁ y", "▁", "<|endoftext|> <s> </s> <0x41>", "🙂🙂 漢字 ä\x00b", "end ", " start", "a b", " x  y z",
    "'s 're it's  don't\n\n\n foo", "end \n", "\ta\t b", "a\x1c b\x85 c\xa0 d", "aaaaaaaaaaaaaaaaaaaaaa aaaaaaa", "1234567 !!!??? $$$ the&&& ***",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(sides, text):
    """(A ids, B ids, links as token numbers, groups) of a whole text, token by token."""
    a, b = sides
    if not text:
        return [], [], [], []
    alphabet = align.byte_alphabet()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    spelled = [[bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]]]
    names = [b.id_to_piece(i) for i in ids[1]]
    spelled.append([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], names, strict=True)])
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return [], [], [], []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
    links, i, j = [], 0, 0
    while i < len(ids[0]):
        links.append((i, j))
        x, y = ends[0][i], ends[1][j]
        i, j = i + (x <= y), j + (y <= x)
    shared = sorted(set(ends[0]) & set(ends[1]))
    upto = [[bisect.bisect_right(ends[k], x) for x in [0, *shared]] for k in (0, 1)]
    groups = [[ids[k][upto[k][g] : upto[k][g + 1]] for k in (0, 1)] for g in range(len(shared))]
    return ids[0], ids[1], links, groups


def digest(groups):
    text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def expected(sides, rows):
    """op11's rows by counting over all texts."""
    found = [(i, *plain(sides, t)) for i, t in rows]
    count = Counter((a[x], b[y]) for _, a, b, links, _ in found for x, y in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, a, b, links, groups in found:
        counts = [(count[a[x], b[y]], most[b[y]]) for x, y in links]
        out.append((i, len(a), len(b), len(groups), len(links), sum(c == m for c, m in counts), sum(c for c, _ in counts), digest(groups)))
    return sorted(out, key=repr)


def result(df):
    return got(df.select(*[x.split(" ")[0] for x in align.RESULT.split(", ")]))


def test_digests_against_plain_alignment(spark, sides):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 1000 else r[1][:4000]) for r in ROWS] + list(enumerate(ODD, 100))
    df = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    want = expected(sides, rows)
    assert result(align.digests(df, A, B)) == want
    assert result(align.digests(clashing(df), A, B)) == want


def test_long_text_and_empty_table(spark, sides):
    rows = [(r[0], r[1]) for r in ROWS if r[0] == 7]
    assert result(align.digests(documents(spark, [r for r in ROWS if r[0] == 7]), A, B)) == expected(sides, rows)
    assert result(align.digests(documents(spark, []), A, B)) == []


def test_query_over_whole_documents(spark, sf, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op11_token_alignment(spark, sf)) == expected(sides, rows)


def test_aligned_gives_tokens_spans_and_links(spark, sides):
    rows = list(enumerate(ODD))
    for r in align.aligned(clashing(documents(spark, [(i, t, None, None) for i, t in rows])), A, B, keep=("doc_id", "label")).collect():
        a, b, links, groups = plain(sides, ODD[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"], list(zip(r["link_a"], r["link_b"], strict=True)), r["label"]) == (a, b, links, "kept")
        assert sum(r["closes"]) == len(groups)
        assert (r["a_ends"][-1:] or [0]) == (r["b_ends"][-1:] or [0]) == [len((" " + ODD[r["doc_id"]]).encode()) if a else 0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z9.'\n\t▁ä漢🙂 \x1c")), max_size=40))
def test_cuts_change_nothing(text):
    sides_ = _sides()
    tokens = align.pair_of(A, B)
    distinct, cuts, ends = align.cut_up([text, "other words here", text])
    found = tokens.align(distinct)
    cuts, ends = align.kept_cuts(found, cuts, ends)
    spelled = tokens.spelled(found)
    one = "".join(spelled[c] for c in cuts[: ends[0]].tolist())[:-1]
    assert (hashlib.sha256(one.encode()).hexdigest() if one else "") == digest(plain(sides_, text)[3])


_KEPT = []


def _sides():
    if not _KEPT:
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        _KEPT.append((a, sentencepiece.SentencePieceProcessor(model_file=B)))
    return _KEPT[0]


def test_a_run_with_a_wrong_cut_is_encoded_cut_by_cut():
    tokens = align.Pair(A, B)
    tokens.bytes_b = list(tokens.bytes_b)
    tokens.bytes_b[tokens.b.encode("wrong")[0]] = b"?"
    found = tokens.align(["right", "wrong", "then"])
    assert found.bad.tolist() == [False, True, False]
    assert np.diff(found.at).tolist()[1] == 0 and np.diff(found.at).min() == 0


def test_group_products():
    ends, a, b, shared = align.overlaps(np.array([2, 3, 6, 8]), np.array([1, 3, 8]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (3, 2, True)]
    assert [tuple(map(int, x)) for x in zip(*align.products(a, b, shared), strict=True)] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2)]
    assert [len(x) for x in align.products(*(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))] == [0, 0]


def test_numbers_packed_and_back():
    for x in ([], [0], [1, 1 << 31, 7, (1 << 32) - 1]):
        assert align.unpack(align.pack(np.array(x, np.int64))).tolist() == x
