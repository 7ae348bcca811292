"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

A first pass over whole texts counts their terms and keeps each document's occurrences of the terms that are asked for, as one row: the forward
index. From it come the corpus counts: documents with terms, all terms, documents per term. A term's impact in a document depends on these
only. Documents are dealt into shards by a hash of their row; a shard's postings grow with the square root of all postings, between LEAST and MOST.
A shard is built once: its forward index sorted by document and term, and one list per term sorted by impact, and stored.

A query reads its terms' lists of a shard in step, DEPTH places of every list at first and twice as many in each further round. A document that a list shows
for the first time is looked up in the forward index under all the query's terms, which gives its whole score. The threshold is the sum of the lists' impacts at
their present depth; the search stops when it is strictly below the kth score, as a document with an equal score and a smaller id may still come.

The sum of the heads of a query's lists bounds what a shard can give. A query is searched first in the shard with the greatest bound; its kth score there is
the floor elsewhere, and only shards whose bound reaches the floor are searched.

Terms asked for go to all workers, in blocks of at most BLOCK bytes; a longer query set takes a pass over the texts per block.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, slices, whole_text

#: A term is a run of letters and digits of ASCII and of any characters beyond it; in UTF-8 those are the bytes from 0x80.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, MOST, BLOCK, DEPTH, CHUNK = 1 << 17, 1 << 22, 32 << 20, 8, 4 << 20
FORWARD = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
LISTS = "shard bigint, docs array<bigint>, rows array<bigint>, posting_doc binary, posting_term binary, posting_impact binary, by_impact binary, head_term array<int>, head array<bigint>"
HITS = "item bigint, doc_id bigint, row bigint, score bigint, scored bigint"


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().lower())  # bytes: A-Z only


def _forward(known: dict[bytes, int]):
    """Each text's number of terms, and how often it holds each term that is asked for."""

    def run(batches):
        get = known.get
        for batch in batches:
            texts = batch.column("text")
            for lo, n in slices(texts, CHUNK):
                sizes, terms, counts, ends = [], [], [], [0]
                for t in texts.slice(lo, n).to_pylist():
                    words = terms_of(t)
                    sizes.append(len(words))
                    held = Counter(map(get, words))
                    held.pop(None, None)
                    terms += held.keys()
                    counts += held.values()
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


class Lists:
    """A shard: postings sorted by document and term (the forward index), and their order by term and falling impact (the lists)."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, order: np.ndarray, place: np.ndarray):
        self.doc, self.impact, self.order, self.place, self.n = doc, impact, order, place, len(place)
        self.wide = int(term.max(initial=0)) + 1
        self.key = doc.astype(np.int64) * self.wide + term
        self.sorted_terms = term[order]

    def span(self, term: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.sorted_terms, [term, term + 1]).tolist())

    def look_up(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The impacts of terms in documents, one row each, 0 where a document does not hold a term."""
        key = docs.astype(np.int64)[:, None] * self.wide + terms
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (terms < self.wide), self.impact[at], 0).astype(np.int64)


def threshold_search(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best documents for one query, best first, ties to the smaller id, and how many were scored.

    floor: a score that k documents elsewhere reach; documents below it are of no use and may be left out. Scores of 0 are left out.
    """
    spans = [lists.span(t) for t in terms.tolist()]
    have = [i for i, (lo, hi) in enumerate(spans) if hi > lo]
    seen = np.zeros(lists.n, bool)
    found, scores, least, depth, to, known = [], [], floor, 0, DEPTH, 0
    while have:
        if least > 0:  # a list at its end has nothing more to give
            here = sum(int(weights[i]) * int(lists.impact[lists.order[spans[i][0] + max(depth - 1, 0)]]) for i in have)
            if here < least:
                break
        shown = np.unique(np.concatenate([lists.doc[lists.order[spans[i][0] + depth : min(spans[i][0] + to, spans[i][1])]] for i in have]))
        new = shown[~seen[shown]]
        seen[new] = True
        found.append(new)
        scores.append(lists.look_up(new, terms) @ weights)
        known += len(new)
        so_far = np.concatenate(scores)
        if len(so_far) >= k:
            least = max(least, int(np.partition(so_far, len(so_far) - k)[len(so_far) - k]))
        depth, to = to, to * 2
        have = [i for i in have if spans[i][0] + depth < spans[i][1]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at, score = np.concatenate(found), np.concatenate(scores)
    best = np.lexsort((lists.place[at], -score))[:k]
    best = best[score[best] > 0]
    return at[best], score[best], known


def places(ids: list[int | None], rows: np.ndarray) -> np.ndarray:
    """The rank of each document by id, nulls last, then by row."""
    null = np.array([x is None for x in ids], bool)
    order = np.lexsort((rows, np.array([x or 0 for x in ids], np.int64), null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _build(key, rows):
    """One shard's postings by document and term, and their order by term and falling impact."""
    held = rows.column("terms").combine_chunks()
    size = np.diff(np.asarray(held.offsets))
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    term = np.asarray(held.flatten(), np.int32)
    value = np.asarray(rows.column("impacts").combine_chunks().flatten(), np.int64)
    by = np.lexsort((term, doc))
    doc, term, value = doc[by], term[by], value[by].astype(np.int32)
    order = np.lexsort((doc, -value, term)).astype(np.int32)
    listed = term[order]
    heads = order[np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])]
    one = [[key[0].as_py()], [rows.column("doc_id").to_pylist()], [rows.column("row").to_pylist()], [doc.tobytes()], [term.tobytes()], [value.tobytes()], [order.tobytes()], [term[heads]], [value[heads]]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], names=[x.split(" ")[0] for x in LISTS.split(", ")])


def _search(k: int):
    """For a shard's lists and some queries (item, asked, weights, floor): the k best of the shard for each."""

    def run(key, lists, queries):
        out: list[list] = [[] for _ in range(5)]
        if lists.num_rows and queries.num_rows:
            one = lists.to_pylist()[0]
            doc, term, value, order = (np.frombuffer(one[c], np.int32) for c in ("posting_doc", "posting_term", "posting_impact", "by_impact"))
            rows = np.array(one["rows"], np.int64)
            shard = Lists(doc, term, value, order, places(one["docs"], rows))
            for q in queries.to_pylist():
                at, score, scored = threshold_search(shard, np.array(q["asked"], np.int64), np.array(q["weights"], np.int64), k, q["floor"] or 0)
                ids = [one["docs"][i] for i in at.tolist()]
                for c, x in zip(out, ([q["item"]] * len(at), ids, rows[at].tolist(), score.tolist(), [scored] + [0] * len(at)), strict=True):
                    c += x[: len(at)]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=[x.split(" ")[0] for x in HITS.split(", ")])

    return run


def asked_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term) of each query: its distinct terms. item numbers the rows, so that rows with equal ids stay apart."""
    found = F.regexp_extract_all("_text", F.lit(TERM_CLASS), F.lit(0))
    lowered = F.translate(whole_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_id).alias("item_id"), lowered.alias("_text"), F.monotonically_increasing_id().alias("item"))
    return rows.select("item", "item_id", F.explode(F.array_distinct(found)).alias("term"))


def _one_block(spark: SparkSession, docs: DataFrame, asked: DataFrame, names: list[str], k: int, stage: Stage) -> DataFrame:
    """The k best documents of each query of one block: item, doc_id, row, score, scored. names: the block's terms."""
    known = {x.encode(): i for i, x in enumerate(names)}
    forward = docs.select("doc_id", "text").mapInArrow(_forward(known), FORWARD).withColumn("row", F.monotonically_increasing_id())
    forward = stage.put(forward, "forward")
    totals = forward.agg(F.count_if(F.col("n") > 0).alias("_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    held = forward.select(F.explode("terms").alias("term_id")).groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    held = stage.put(held.crossJoin(F.broadcast(totals)), "df")  # one row
    weight = F.floor(1000 * F.log((2.0 * F.col("_docs") + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    numbered = spark.createDataFrame(list(enumerate(names)), "term_id int, term string")
    wanted = asked.join(numbered, "term").join(held.select("term_id", weight.alias("w")), "term_id").where("w <> 0")
    queries = stage.put(wanted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("_t")).select("item", F.col("_t.term_id").alias("asked"), F.col("_t.w").alias("weights")), "queries")
    one = held.select("_docs", "_all").limit(1)
    worth = F.expr("transform(counts, c -> (1000000000 * bigint(c)) div (1000 * bigint(c) + 8 * (10 + (90 * n * _docs) div _all)))")
    rows = forward.where("size(terms) > 0").crossJoin(F.broadcast(one)).select("doc_id", "row", "terms", worth.alias("impacts"))  # one row
    postings = held.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shards = max(1, -(-postings // min(MOST, max(LEAST, 32 * math.isqrt(postings)))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint"))
    lists = stage.put(dealt.groupBy("shard").applyInArrow(_build, LISTS), "lists")
    heads = lists.select("shard", F.explode(F.arrays_zip("head_term", "head")).alias("_h")).select("shard", F.col("_h.head_term").alias("term_id"), "_h.head")
    each = queries.select("item", F.explode(F.arrays_zip("asked", "weights")).alias("_q")).select("item", F.col("_q.asked").alias("term_id"), F.col("_q.weights").alias("w"))
    bounds = stage.put(each.join(heads, "term_id").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("head")).alias("bound")), "bounds")
    first = bounds.groupBy("item").agg(F.max_by("shard", F.struct("bound", "shard")).alias("home"))
    asked_at = queries.join(bounds, "item").join(first, "item")
    home = asked_at.where("shard = home").withColumn("floor", F.lit(None).cast("bigint"))
    at_home = stage.put(lists.drop("head_term", "head").groupBy("shard").cogroup(home.groupBy("shard")).applyInArrow(_search(k), HITS), "home")
    floors = at_home.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    away = asked_at.where("shard <> home").join(floors, "item", "left").where("floor is null or bound >= floor")
    lists = lists.drop("head_term", "head")
    return at_home.unionByName(lists.groupBy("shard").cogroup(away.groupBy("shard")).applyInArrow(_search(k), HITS))


def hits(documents: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(asked, found): the queries' terms, and what each query found in the shards that it was searched in; `scored` counts the documents scored."""
    spark, stage = documents.sparkSession, Stage(documents.sparkSession, "lexical")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    asked = stage.put(asked_terms(items, item_id, text), "asked")
    sizes = asked.groupBy("item").agg(F.sum(F.octet_length("term")).alias("_b"))
    blocks = max(1, -(-(sizes.agg(F.coalesce(F.sum("_b"), F.lit(0))).first()[0]) // BLOCK))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        names = sorted(r["term"] for r in mine.select("term").distinct().collect())  # at most about BLOCK bytes
        part = _one_block(spark, docs, mine, names, k, stage)
        found = part if found is None else found.unionByName(part)
    return asked, found


def ranked(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each query row's k best documents with a score above 0, equal scores by ascending doc_id.

    A null or empty text has no terms; a query without a term that a document holds gives no rows, and so do empty tables. Repeated document rows are
    ranked each for itself; a null doc_id comes after all others of its score. Repeated query rows are answered each for itself. Long
    texts are counted whole. Other columns are not read.
    """
    asked, found = hits(documents, items, k)
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    top = found.withColumn("rank", best).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%s') AS terms
  FROM documents),
q AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%s')) AS terms
  FROM benchmark),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS all_terms FROM t),
asked AS (SELECT item, item_id, unnest(terms) AS term FROM q),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM t) GROUP BY r, doc_id, term),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
m AS (SELECT r, 10 + (90 * len(terms) * docs) // all_terms AS m FROM t, totals WHERE len(terms) > 0),
s AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
""" % (TERM_CLASS, TERM_CLASS)
