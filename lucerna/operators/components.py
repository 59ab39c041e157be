"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.runtime import cut


def key_edges(rows: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Edges (a, b) that tie every node of a shared key to the smallest node of that key.

    A key of n nodes gives n-1 edges, never n² pairs. The smallest node is found by a
    partial aggregation, so a key that holds a third of all rows is combined before the shuffle.
    """
    pairs = rows.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("k")).distinct()
    low = pairs.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(low, "k").where("a <> b").select("a", "b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge, component being its smallest node.

    Large-star and small-star steps run by turns until no edge changes. Each step is a
    min aggregation (combined before the shuffle) joined back to the edges, so a hub never
    gathers its neighbours in one task; AQE splits the hub's join partition.
    Nulls and self-loops are ignored; an empty input gives an empty result. Rounds grow with the logarithm of
    the longest path; a result that has not settled after ``max_rounds`` is an error, never returned.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        sig = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sig == seen or sig[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        seen = sig
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
    raise RuntimeError(f"no fixed point after {max_rounds} rounds: raise max_rounds")
