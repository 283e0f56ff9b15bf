"""Connected components of a graph kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any type with an order; in any direction, repeated or not. Returns node, label for each node
    with a link to another; label is the smallest node of its component.

    Large and small stars take turns: each node hangs its larger neighbours, then itself and its smaller ones, on
    the smallest node it knows, until nothing changes. Each turn is two aggregations and two joins over the edges;
    a node with very many links is only ever aggregated or joined, never gathered."""
    up, down = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.filter("a <> b").select(up.alias("a"), down.alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("w"))
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b > m").select("b", "m")).distinct()
        following = stored(small, "small-star")
        discard(large)
        discard(edges)
        edges, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(tops.select("node", "node"))
