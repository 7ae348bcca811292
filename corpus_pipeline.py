"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to target
weights, and what is left becomes SentencePiece ids. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, overlap, pieces, toxicity
from tidemark.llm.common import Stage, table
from tidemark.llm.queries import PIECES_MODEL, tokenizer_path

#: 90 % of the tokens that reach the stage, each document at most once.
MIX = mixing.Mix(domains={"crawl": 5, "reference": 3, "community": 2}, langs={"en": 3}, share_thousandths=900, max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model learns from labelled documents outside the held-out fold. Null and empty texts score like a text without any
    feature; repeated rows share one fate, and without labels of both classes all do."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by similarity 0.8 or more of their five-word shingles. Null and empty texts are one group; rows alike in
    id and text stay or go together, and rows without an id stay."""
    return overlap.first_of_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within their source's budget, each once; see mixing.keep for nulls, repeated rows and empty tables."""
    return mixing.keep(docs, MIX)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document. A null text has no ids; repeated rows and null ids are kept."""
    out = pieces.encode(docs, tokenizer_path(PIECES_MODEL), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Fitted scores, near-duplicate components and BPE merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return docs
