"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def _star(pairs: DataFrame, keep) -> DataFrame:
    """pairs (u, v): v is linked to the least of u and its neighbours. keep: which v."""
    least = pairs.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = pairs.join(least, F.col("u") == F.col("c"))
    return linked.where(keep(F.col("u"), F.col("v"))).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node that its links reach) of every node of links (a, b: long), isolated ones left out.

    Each round's edges are a written table; a node with very many links is combined before the shuffle and
    its join is split by adaptive execution. Links of a node with itself and nulls are ignored."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = written(links.where("a <> b").select(a.alias("u"), b.alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda u, v: v > u).where("u > v").distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: too few rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
