"""One query per operator, over its whole intended table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, lexical, lmscore, mixing, mpegts, pieces, quality, sharding, simhash, topk, toxicity, urlfilter, warc
from .common import table

#: The vocabulary file of op9; see the tokenizers' own README.
PIECES_MODEL = "piece_bpe_32k.model"
#: The byte-level side of op11.
BYTES_MODEL = "byte_bpe_50k.json"
SHARDS = 8
#: The mix of op4: 70 % of all tokens, crawl : reference : community as 5 : 3 : 2, at most two epochs.
MIX = mixing.Mix(domains={"crawl": 5, "reference": 3, "community": 2}, langs={"en": 4, "de": 2, "fr": 2, "es": 2}, sources={"src0": 2}, share_thousandths=700, max_epochs=2)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op2_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.evaluate(urlfilter.captures(pages), urlfilter.sample_list(pages))
    return found.withColumns({k: F.col(k).cast("string") for k in ("fetched_at", "listed_on")})


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(table(spark, sf_dir, "documents"))


def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), MIX)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(table(spark, sf_dir, "documents"))


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES_MODEL))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_audit(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTES_MODEL), tokenizer_path(PIECES_MODEL))


def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_temporal_url_filter": op2_temporal_url_filter,
        "op3_backoff_automaton": op3_backoff_automaton,
        "op4_hierarchical_mix": op4_hierarchical_mix,
        "op5_toxicity": op5_toxicity,
        "op6_mpegts": op6_mpegts,
        "op7_threshold_topk": op7_threshold_topk,
        "op8_feistel_shards": op8_feistel_shards,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_merkle_audit": op10_merkle_audit,
        "op11_token_alignment": op11_token_alignment,
        "op12_fourier_quality": op12_fourier_quality,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_temporal_url_filter": urlfilter.SQL,
        "op4_hierarchical_mix": mixing.sql(MIX),
        "op7_threshold_topk": topk.SQL,
        "op10_merkle_audit": warc.AUDIT_SQL,
        "op13_lexical_search": lexical.SQL,
    }
