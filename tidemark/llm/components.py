"""Connected components of a graph whose edges no single machine need hold.

Large-star and small-star steps by turns: each node's neighbours above it are hung on its smallest neighbour, then its neighbours
below it likewise, until the edges are a star round the smallest node of each component. Steps are minimums with
partial sums and joins against one row per node, whose other side may be split where a node has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); root is the smallest node of its component.

    Self-loops and repeated edges add nothing; edges with a null end are left out. No edges: no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stage.put(now, "edges")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    before = None
    while (state := now.agg(mark.alias("m")).first()[0]) != before and state[0]:
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "at"), "large")
        hung = stage.put(now.join(least, now["v"] == least["at"]).select("u", F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        stage.drop(now)
        stage.drop(least)
        least = stage.put(hung.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at"), "small")
        rest = hung.join(least, hung["u"] == least["at"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stage.put(rest.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        stage.drop(hung)
        stage.drop(least)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
