import sentencepiece
from small import clashing, documents
from test_overlap import brute

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import PIECES_MODEL, tokenizer_path


def test_stages_one_by_one(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    bad = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in clean.orderBy("doc_id").collect()]
    single = corpus_pipeline.drop_near_duplicates(spark, clean, sf)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {rows[i][0] for i in brute(rows)}
    mixed = corpus_pipeline.mix_sources(spark, single, sf)
    assert mixed.columns == docs.columns and 0.7 * single.count() <= mixed.count() <= single.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES_MODEL))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(text) and all(r["ids"] == lib.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_on_odd_documents(spark, sf):
    for docs in (clashing(documents(spark)), documents(spark, [])):
        names = docs.columns
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, sf)
            docs.collect()
            assert name == "sentencepiece" or docs.columns == names
