"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that an edge joins to another; the component is its
    smallest node.  Loops, nulls, repeated and reversed edges do not matter.

    A step replaces each neighbourhood by a star around its smallest member, so the number of
    edges never grows and no neighbourhood is gathered: only minima are aggregated.  Steps are
    written to the shared folder; the number of steps follows the logarithm of the diameter.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    pairs = written(pairs, "edges")
    before = _state(pairs)
    while before[0]:
        following = written(_small_star(_large_star(pairs)), "edges")
        after = _state(following)
        drop_written(pairs)
        pairs = following
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are joined to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
