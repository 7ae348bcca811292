import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import ROWS, clashing, documents, got

from tidemark.llm import mixing, topk, toxicity, urlfilter, warc
from tidemark.llm.common import Stage


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(230)]
    rows += [(50, rows[50][1]), (7, rows[7][1]), (300, [0.0] * 6), (350, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [1.0] * 6), (550, [])]
    ok = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(ok) if b != a)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("row", "v", "shard", "rank")})
    assert got(topk.top_k(df)) == sorted(want, key=repr)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 300")).count() == 0


def test_threshold_stops_early_with_the_right_answer():
    rng = np.random.default_rng(1)
    values = np.floor(256 * rng.normal(size=(3000, 4)))
    order = np.argsort(values, axis=0, kind="stable").T.copy()
    for q in values[:20]:
        at, score, scored = topk.threshold_search(values, order, np.arange(3000), q, -1, 5)
        assert scored < 3000
        want = sorted(range(3000), key=lambda i: (-(values[i] @ q), i))[:5]
        assert at.tolist() == want and score.tolist() == [values[i] @ q for i in want]


def test_floors_leave_out_only_what_is_below_them():
    rng = np.random.default_rng(2)
    values = np.floor(256 * rng.normal(size=(500, 3)))
    order = np.argsort(values, axis=0, kind="stable").T.copy()
    for q in values[:20]:
        want = sorted(((values[i] @ q, -i) for i in range(500)), reverse=True)[:5]
        for floor in (want[2][0], want[4][0], want[0][0] + 1):
            at, score, _ = topk.threshold_search(values, order, np.arange(500), q, -1, 5, floor)
            assert [(s, -i) for s, i in zip(score, at) if s >= floor] == [x for x in want if x[0] >= floor]


def test_large_components_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "BLOCK", 1)
    rows = [(i, [float(i % 7), 1e7 if i % 3 else -3e6, float(i)]) for i in range(101)]
    v = {i: [math.floor(256 * x) for x in xs] for i, xs in rows}
    want = []
    for i in range(0, 101, 50):
        best = sorted((-sum(a * b for a, b in zip(v[i], v[j])), j) for j in v if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(topk.top_k(df)) == sorted(want, key=repr)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id bigint, embedding array<double>")).collect()


def shared(budget, nodes):
    """Water filling by plain rounds: (cap, weight) by name."""
    out, open_, left = {}, dict(nodes), budget
    while True:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap * total <= left * w]
        if not full:
            return out | {k: w * left // total for k, (_, w) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]
        left = budget - sum(out.values())
        if not open_:
            return out


@pytest.mark.parametrize("budget", [0, 7, 30, 100, 170, 400])
def test_shortages_go_to_siblings(spark, budget):
    nodes = {"a": (10, 5), "b": (100, 3), "c": (60, 1), "d": (0, 2)}
    df = spark.createDataFrame([("r", k, cap, w, budget) for k, (cap, w) in nodes.items()], "parent string, name string, cap bigint, w bigint, budget bigint")
    assert {r["name"]: r["share"] for r in mixing._share_out(df, ["parent"], "name").collect()} == shared(budget, nodes)


def test_shortages_climb_past_weights_of_zero(spark):
    """A leaf of weight 0 gives its parent no capacity, so the sibling domain gets what is left."""
    rows = [(i, "w " * 100, "en", "src0") for i in range(10)] + [(20, "w " * 10, "en", "src3")] + [(30 + i, "w " * 100, "en", "src1") for i in range(10)]
    mix = mixing.Mix(sources={"src0": 0}, share_thousandths=490)
    taken = mixing.mixture(documents(spark, rows), mix)
    per = {r["source"]: r["sum(tokens)"] for r in taken.groupBy("source").sum("tokens").collect()}
    assert per == {"src3": 10, "src1": 900}  # budget 984: 10 to the open leaf of crawl, 974 to reference in whole documents


def test_mixture_of_odd_documents(spark):
    rows = [*ROWS, *((100 + i, "some words of a plain text " * (i % 4 + 1), "en", f"src{i % 5}") for i in range(60))]
    df = clashing(documents(spark, rows))
    mix = mixing.Mix(domains={"crawl": 5}, share_thousandths=400, max_epochs=1)
    kept = mixing.keep(df, mix)
    taken = mixing.mixture(df, mix)
    assert kept.columns == df.columns and kept.count() == taken.count()
    assert taken.agg(F.sum("tokens")).first()[0] <= df.agg(F.sum(F.size(F.expr("regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")))).first()[0] * 0.4
    twice = mixing.mixture(df, mixing.Mix(share_thousandths=2000, max_epochs=2)).groupBy("epoch").count()
    bare = 3  # documents whose leaf has no token at all have no share
    assert got(twice) == [(0, len(rows) - bare), (1, len(rows) - bare)]
    assert mixing.mixture(documents(spark, []), mix).count() == 0 and mixing.keep(documents(spark, []), mix).count() == 0


def test_toxicity_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scored(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) >= 50 and np.mean(right) >= 0.9
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    assert got(toxicity.scored(docs, labels)) == got(toxicity.scored(other, labels))


def test_restored_words():
    model = toxicity.fit_letters(["you are a stupid idiot and this is a hateful thing said by idiots " * 5])
    assert [model.restore(x) for x in ("1d10t", "st.u.p.i.d", "stuuupid", "i d i o t")] == ["idiot", "stupid", "stupid", "idiot"]
    assert model.words("A plain text, 1234!") >= {"a", "plain", "text"}


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    df = clashing(documents(spark))
    rows = toxicity.scored(df, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = toxicity.clean(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == len(ROWS)
    assert toxicity.scored(documents(spark, []), labels).count() == 0


def test_lists_hold_for_their_dates(spark):
    entries = [("h:a.example.org", "block", "2024-01-10"), ("h:a.example.org", "clear", "2024-02-01"), ("d:example.org", "block", "2024-03-01"), ("p:a.example.org/en", "allow", "2024-01-15"), ("h:b.net", "block", "2024-01-01"), ("h:b.net", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("h:c.net", None, "2024-01-01"), ("h:c.net", "block", None), ("p:[2001:db8::1]/a", "allow", "2024-01-01"), ("h:[2001:db8::1]", "block", "2024-01-01"), ("d:0.0.1", "block", "2024-01-01")]
    day = lambda x: F.col(x).cast("date").alias(x)
    listed = spark.createDataFrame(entries, "pattern string, action string, listed_on string").select("pattern", "action", day("listed_on"))
    cases = [
        (1, "http://A.example.org./x", "2024-01-09", "none"), (2, "http://a.example.org/x", "2024-01-10", "block"), (3, "https://u@a.example.org:8/en/x?q#f", "2024-01-20", "allow"),
        (4, "http://a.example.org/english", "2024-01-20", "block"), (5, "http://a.example.org/", "2024-02-01", "none"), (6, "http://z.y.example.org", "2024-03-02", "block"),
        (7, "http://b.net", "2024-01-01", "block"), (8, "http://c.net", "2024-05-01", "none"), (9, "no url", "2024-05-01", "unparsed"), (10, None, None, "unparsed"), (11, "http://b.net", None, "undated"), (7, "http://b.net", "2024-01-01", "block"), (None, "http://b.net", "2024-01-01", "block"),
        (12, "http://[2001:db8::1]:80/a/b", "2024-01-05", "allow"), (13, "http://[2001:db8::2]/", "2024-01-05", "none"), (14, "http://10.0.0.1/x", "2024-01-05", "none"), (15, "http://[broken/x", "2024-01-05", "unparsed"), (16, "http://b.net?x=/en", "2024-01-05", "block"),
    ]
    seen = spark.createDataFrame([c[:3] for c in cases], "page_id bigint, url string, fetched_at string").select("page_id", "url", day("fetched_at"), F.lit("x").alias("pattern"), F.lit("y").alias("_k"))
    found = urlfilter.evaluate(seen, listed)
    assert got(found.select("page_id", "verdict")) == sorted([(c[0], c[3]) for c in cases], key=repr)
    assert urlfilter.evaluate(seen.limit(0), listed).count() == 0
    assert {r[0] for r in urlfilter.evaluate(seen, listed.limit(0)).select("verdict").distinct().collect()} == {"none", "unparsed", "undated"}


def test_audit_finds_just_what_was_damaged(spark):
    n = 700
    digest = lambda i: f"{i:064x}"
    place = lambda i: (i // 100, i % 100 * 10)
    archive = spark.createDataFrame([(i, *place(i), 10, i, digest(i)) for i in range(n)], "ordinal bigint, file bigint, offset bigint, length bigint, page_id bigint, digest string")
    held = {i: (*place(i), 10, digest(i)) for i in range(n)}
    held |= {5: (*place(5), 10, "bad"), 17: (*place(17), 4, "cut"), 600: (*place(600), 12, "grown"), 301: (3, 777, 10, digest(301)), 302: (*place(303), 10, digest(302)), n + 3: (7, 0, 9, "more")}
    del held[99]
    kind = "ordinal bigint, found_file bigint, found_offset bigint, found_length bigint, found_digest string"
    replica = spark.createDataFrame([(i, *x) for i, x in held.items()], kind)
    found = warc.audit(archive, replica, Stage(spark, "audit"))
    assert got(found.select("ordinal", "damage")) == sorted([(5, "altered"), (17, "shorter"), (99, "missing"), (600, "longer"), (301, "moved"), (302, "moved"), (n + 3, "extra")], key=repr)
    same = archive.select("ordinal", *[F.col(c).alias(f"found_{c}") for c in ("file", "offset", "length", "digest")])
    assert warc.audit(archive, same, Stage(spark, "audit")).count() == 0
    assert warc.audit(archive.limit(0), replica.limit(0), Stage(spark, "audit")).count() == 0
    # A record put in between moves all that follow it in its file, and nothing in the others.
    pushed = same.withColumn("found_offset", F.col("found_offset") + F.when(F.expr("found_file = 2 and found_offset >= 500"), 7).otherwise(0))
    moved = warc.audit(archive, pushed, Stage(spark, "audit"))
    assert got(moved.select("ordinal", "damage")) == [(i, "moved") for i in range(250, 300)]


def test_records_are_wellformed(spark):
    df = spark.createDataFrame([(1, "http://a/\r\nX: y", "<p>\u00e4</p>")], "page_id bigint, url string, html string")
    head, _, block = df.select(warc.record()).first()[0].partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert fields["WARC-Target-URI"] == "http://a/%0D%0AX: y" and fields["WARC-Date"] == "2024-01-01T00:00:00Z" and fields["Content-Type"] == "application/http;msgtype=response"
    body = block.encode()[: int(fields["Content-Length"])]
    assert block.encode()[len(body) :] == b"\r\n\r\n" and body.startswith(b"HTTP/1.1 200 OK\r\n") and body.endswith("\r\n\r\n<p>\u00e4</p>".encode())


def test_pages_with_nulls_and_repeats(spark):
    rows = [(17, "http://a", "<p>x</p>"), (17, "http://a", "<p>x</p>"), (59, None, "y" * 100_000), (101, "http://b", None), (None, None, None), (1, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(date(2024, 1, 1)) for c in ("key", "ordinal", "digest", "file")})
    assert got(warc.page_audit(pages).select("page_id", "damage")) == [(101, "missing"), (17, "altered"), (17, "altered"), (59, "shorter")]
    assert warc.page_audit(pages.limit(0)).count() == 0
