"""Connected components of an edge table, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import join_hot, table


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones, until
    no edge changes. Smallest neighbours are partial minima; what is sent back to the edges of a node
    with a thousandth of all edges or more goes by broadcast (there are fewer than 2000 such nodes), so
    no node's neighbours are gathered in one task. Loops, repeated and reversed edges and edges with a
    null end don't matter.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    state = _state(now)
    while state[0]:
        hot = max(1000, state[0] // 1000)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.where("b > a"), least.select("a", "m"), ["a"], least.where(F.col("n") >= hot).select("a"), 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        down = join_hot(large, least.select("a", "m"), ["a"], least.where(F.col("n") >= hot).select("a"), 2 * state[0])
        small = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = table(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return nodes.join(now.withColumnsRenamed({"a": "node", "b": "root"}).hint("shuffle_hash"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
