"""Mixing sources to target weights: hierarchical budgeting over domain, language and source.

A token budget flows down the tree in proportion to the weights. No node gets more than its capacity, that is its
tokens times the epochs allowed; what is below a weight of 0 counts for nothing. What a node cannot take goes to its siblings by their
weights, and only what all siblings together cannot take is left to their parent's siblings. A leaf's share is whole epochs and then a prefix of
the next epoch, in which the leaf's documents stand in the order of a seeded hash.

All shares are exact integers. Sums of tokens times weights must stay below 2**63.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Stage, whole_text

LEAF = ["domain", "lang", "source"]
HASH_BITS = 60


@dataclass(frozen=True)
class Mix:
    """Integer weights by name on each level (others: 1), the budget as a share of all tokens in thousandths, the epochs allowed."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share_thousandths: int = 700
    max_epochs: int = 1
    seed: int = 7


def domain_of(source: Column) -> Column:
    """Documents name no domain; the number that ends a source's name gives it one of three."""
    number = F.pmod(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0)), F.lit(3))
    return F.when(number == 0, "crawl").when(number == 1, "reference").otherwise("community")


def _weight(col: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, w).otherwise(out)
    return out.cast("long")


def _order(seed: int, epoch: Column, id_col: str = "doc_id") -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Splits each parent's `budget` among its rows by `w`, none above `cap`; gives `share`. Rows fill up in the order of cap / w."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("_ratio"), F.col(child))
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumn("w", F.greatest("w", F.lit(1)))
    nodes = nodes.withColumn("_ratio", F.col("cap").cast("double") / F.col("w"))
    nodes = nodes.withColumn("_later", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    nodes = nodes.withColumn("_full", F.col("cap") * F.col("_later") + F.col("_before") * F.col("w") <= F.col("budget") * F.col("w"))
    nodes = nodes.withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by))
    nodes = nodes.withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(by))
    part = F.expr("(w * (budget - _taken)) div _open")
    return nodes.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_ratio", "_later", "_before", "_full", "_taken", "_open", "budget")


def slim(df: DataFrame, stage: Stage) -> DataFrame:
    """Leaf and token count of every document, stored. Null names count as empty ones, null texts have no tokens."""
    rows = df.select(
        F.col("doc_id"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("tokens"),
    )
    return stage.put(rows, "slim")


def plan(rows: DataFrame, mix: Mix, stage: Stage) -> DataFrame:
    """Per leaf: tokens, share, full_epochs, rest (tokens of the last epoch's prefix) and cut (the last hash in that prefix)."""
    leaves = stage.put(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    total, docs = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    # Capacities from the leaves up, then budgets from the root down.
    open_ = lambda df: df.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    caps = open_(leaves.withColumn("cap", F.col("tokens") * mix.max_epochs).withColumn("w", _weight("source", mix.sources)))
    by_lang = open_(caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", mix.langs)))
    by_domain = stage.put(open_(by_lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", mix.domains))), "domains")
    capacity = by_domain.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
    level = by_domain.withColumn("budget", F.lit(min(total * mix.share_thousandths // 1000, capacity)).cast("long")).withColumn("_root", F.lit(0))
    level = _share_out(level, ["_root"], "domain").select("domain", F.col("share").alias("budget"))
    middle = _share_out(by_lang.join(level, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    final = caps.join(middle, ["domain", "lang"])
    final = _share_out(final, ["domain", "lang"], "source")
    final = final.withColumn("full_epochs", F.expr("if(tokens > 0, share div tokens, 0)")).withColumn("rest", F.expr("if(tokens > 0, share % tokens, 0)"))
    final = stage.put(final.select(*LEAF, "tokens", "docs", "share", "full_epochs", "rest"), "shares")

    # The prefix of one epoch, without sorting a leaf as a whole: sums of hash ranges, and only the range that holds the cut is sorted.
    bits = min(20, max(8, math.ceil(math.log2(math.sqrt(max(docs, 1))))))
    size = 1 << HASH_BITS - bits
    placed = rows.join(final.where("rest > 0").select(*LEAF, "full_epochs", "rest"), LEAF).withColumn("_h", _order(mix.seed, F.col("full_epochs")))
    placed = placed.withColumn("_range", F.shiftright("_h", HASH_BITS - bits)).select(*LEAF, "rest", "_range", "_h", "tokens")
    ranges = placed.groupBy(*LEAF, "rest", "_range").agg(F.sum("tokens").alias("_sum"))
    ranges = ranges.withColumn("_to", F.sum("_sum").over(Window.partitionBy(*LEAF).orderBy("_range")))
    edge = stage.put(ranges.where("_to > rest and _to - _sum <= rest").select(*LEAF, "_range", (F.col("_to") - F.col("_sum")).alias("_from")), "edges")
    inside = placed.join(edge, [*LEAF, "_range"])
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("_h").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("_upto", F.col("_from") + upto).where("_upto <= rest").groupBy(*LEAF).agg(F.max("_h").alias("_last"))
    cuts = edge.join(last, LEAF, "left").select(*LEAF, F.coalesce("_last", F.col("_range") * size - 1).alias("cut"))
    return stage.put(final.join(cuts, LEAF, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))), "plan")


def times(plan_cut: str, seed: int) -> Column:
    """How often a document of a leaf is taken: once an epoch, and once more if it stands in the prefix of the last."""
    return (F.col("full_epochs") + F.when(_order(seed, F.col("full_epochs")) <= F.col(plan_cut), 1).otherwise(0)).cast("int")


def mixture(df: DataFrame, mix: Mix) -> DataFrame:
    """One row for each document and epoch in which it is taken: doc_id, domain, lang, source, tokens, epoch (from 0).

    Rows with equal ids in a leaf are taken together. Null ids share one place in the order. A text without tokens is
    taken if its place is before the cut; a leaf without any token has no share. An empty table gives an empty mixture; other columns are not read.
    """
    stage = Stage(df.sparkSession, "mix")
    rows = slim(df, stage)
    taken = rows.join(plan(rows, mix, stage).select(*LEAF, "full_epochs", "cut"), LEAF).withColumn("_times", times("cut", mix.seed)).where("_times > 0")
    return taken.select("doc_id", *LEAF, "tokens", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"))


def keep(df: DataFrame, mix: Mix) -> DataFrame:
    """The documents of the mixture with all their columns, each once: a mix for a stage that may not repeat rows.

    Null and empty texts have no tokens; one is kept if its place lies before its leaf's cut, at no cost. Very long texts count whole. Repeated rows and null ids are rows like others;
    an empty table stays empty, and columns of any name are kept.
    """
    stage = Stage(df.sparkSession, "mix")
    found = plan(slim(df, stage), mix, stage).select(*[F.col(k).alias(f"_{k}") for k in LEAF], "full_epochs", F.col("cut").alias("_cut"))
    keys = {"_domain": domain_of(F.col("source")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_source": F.coalesce(F.col("source").cast("string"), F.lit(""))}
    rows = df.select("doc_id", *[v.alias(k) for k, v in keys.items()], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    return rows.join(found, list(keys)).where(times("_cut", mix.seed) > 0).select("_row.*")


def _share_sql(parent: str, child: str) -> str:
    """The same split in SQL, over a relation `t` with cap, w and budget."""
    order = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN"
    return f"""
      SELECT *, CASE WHEN full_ THEN cap ELSE w * (budget - taken) // open_ END AS share FROM (
        SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS taken,
          sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS open_ FROM (
          SELECT *, cap * sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING)
            + (sum(cap) OVER ({order} UNBOUNDED PRECEDING AND CURRENT ROW) - cap) * w <= budget * w AS full_ FROM t))"""


def _case(col: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"


def sql(mix: Mix) -> str:
    """mixture() over `documents` in DuckDB's SQL, for leaves of at least one token."""
    place = f"('0x' || substr(md5('{mix.seed}:' || full_epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"
    return f"""
WITH s AS (
  SELECT doc_id, CASE coalesce(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '')::BIGINT, 0) % 3 WHEN 0 THEN 'crawl' WHEN 1 THEN 'reference' ELSE 'community' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, {_case("source", mix.sources)} AS w, CASE WHEN {_case("source", mix.sources)} > 0 THEN sum(tokens) * {mix.max_epochs} ELSE 0 END AS cap FROM s GROUP BY domain, lang, source),
bylang AS (SELECT domain, lang, {_case("lang", mix.langs)} AS w, CASE WHEN {_case("lang", mix.langs)} > 0 THEN sum(cap) ELSE 0 END AS cap FROM leaf GROUP BY domain, lang),
bydomain AS (SELECT domain, {_case("domain", mix.domains)} AS w, CASE WHEN {_case("domain", mix.domains)} > 0 THEN sum(cap) ELSE 0 END AS cap FROM bylang GROUP BY domain),
total AS (SELECT least((SELECT sum(tokens) FROM leaf) * {mix.share_thousandths} // 1000, sum(cap)) AS budget FROM bydomain),
one AS (WITH t AS (SELECT domain, cap, greatest(w, 1) AS w, 0 AS root, budget FROM bydomain, total)
  {_share_sql("root", "domain")}),
two AS (WITH t AS (SELECT domain, lang, b.cap, greatest(b.w, 1) AS w, one.share AS budget FROM bylang b JOIN one USING (domain))
  {_share_sql("domain", "lang")}),
three AS (WITH t AS (SELECT domain, lang, source, leaf.tokens, leaf.cap, greatest(leaf.w, 1) AS w, two.share AS budget FROM leaf JOIN two USING (domain, lang))
  {_share_sql("domain, lang", "source")}),
p AS (SELECT s.*, share // three.tokens AS full_epochs, share % three.tokens AS rest FROM s JOIN three USING (domain, lang, source)),
h AS (SELECT *, {place} AS h FROM p),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS inside FROM h),
n AS (SELECT *, (full_epochs + CASE WHEN rest > 0 AND inside THEN 1 ELSE 0 END)::INT AS times FROM c)
SELECT doc_id, domain, lang, source, tokens, unnest(range(times))::INT AS epoch FROM n WHERE times > 0
"""
