"""Connected components of a link table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.storage import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: the smallest node reachable.

    Each round points every larger neighbour of a node at the node's smallest
    neighbour, then the smaller ones; links shrink to stars in a logarithmic
    number of rounds.  A node's neighbours are only ever aggregated (partial
    minimum before the shuffle) and joined, never gathered, so a hub is split
    like any other hot key.  Self links and nulls are ignored.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u")
        small = _stars(large, None)
        edges = cut(small)
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    if state[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(pairs: DataFrame, keep: str | None) -> DataFrame:
    """Point neighbours ``v`` of each ``u`` (only those ``keep`` says) at the
    smallest of them and ``u``; without ``keep``, ``u`` itself too."""
    # a table of its own, so that Spark is free to split a hub in the join
    least = cut(pairs.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m")))
    joined = pairs.join(least, F.col("u") == F.col("m_u")).withColumn("m", F.least("u", "m"))
    out = (joined.where(keep) if keep else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep is None:
        out = out.unionByName(least.select(F.col("m_u").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(sum(hash(u, v)), 0L)"),
                           F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)")).first())
