"""Merkle tree of a table: one tree for each group, and one over the groups' roots.

Every two neighbouring nodes become the hash of their digests, the last one alone if they are odd in
number, until one is left. Positions are cut into aligned blocks of 1024 nodes, and the ten levels of a
block are ten windows of one partitioning: at level k the rows whose place is a multiple of 2**k are
nodes, lag and lead columns of the fixed offset 2**k, masked by the node's slot and the length of its
run, hold its sibling, and the rows of first children hash parents. So a round costs one shuffle for
any number of rows, the next has a thousandth of them, and no group is ever in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.llm.positions import numbered
from tabvox.llm.textbytes import table

LEVELS = 10
BLOCK = 1 << LEVELS


def leaf(*columns: Column) -> Column:
    """Hex sha256 of the columns' values, each as its UTF-8 byte count, a colon and itself, or - if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def _round(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, total, digest, ...) with sibs, the siblings met on ten levels ("" for none), and top, the block's root at its first row.

    A group has a level as long as it has more than one node.
    """
    own = W.partitionBy("g", "block").orderBy("pos")
    df = nodes.withColumn("block", F.shiftright("pos", LEVELS)).withColumn("node0", F.col("digest"))
    for k in range(LEVELS):
        step = 1 << k
        open_, is_node = F.col("total") > step, F.col("pos") % step == 0
        slot = F.shiftright("pos", k).bitwiseAND(1)
        run = F.col("total") - F.shiftleft(F.shiftright("pos", k + 1), k + 1)  # leaves from the first child on
        node = f"node{k}"
        df = df.withColumns({"before": F.lag(node, step).over(own), "after": F.lead(node, step).over(own)})
        sib = F.when(slot == 1, F.col("before")).when(run > step, F.col("after")).otherwise(F.lit(""))
        df = df.withColumn(f"sib{k}", F.when(open_ & is_node, sib)).drop("before", "after")
        parent = F.when(F.col("pos") % (2 * step) == 0, F.sha2(F.concat(node, f"sib{k}"), 256))
        df = df.withColumn(f"node{k + 1}", F.when(open_, parent).otherwise(F.col(node)))
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    # the last row at or before a leaf that is a node of level k is the leaf's own ancestor
    sibs = F.array_compact(F.array(*[F.last(f"sib{k}", ignorenulls=True).over(so_far) for k in range(LEVELS)]))
    return df.withColumn("sibs", sibs).withColumn("top", F.col(f"node{LEVELS}")).select(*nodes.columns, "block", "sibs", "top")


def _tree(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Written rounds from the leaves up, and the roots (g, digest)."""
    rounds = []
    while True:
        rounds.append(table(_round(nodes), f"{name}-{len(rounds)}"))
        nodes = rounds[-1].where(F.col("pos") % BLOCK == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("top").alias("digest"))
        if not rounds[-1].where(F.col("total") > BLOCK).limit(1).count():
            return rounds, nodes.select("g", "digest")


def _down(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest round's rows with the columns of roots (g, path, ...): path is the siblings from the leaf on."""

    def join(upper: DataFrame, lower: DataFrame) -> DataFrame:
        above = upper.select(F.col("g").alias("g_"), F.col("pos").alias("block_"), F.col("path").alias("path_"), *extra)
        out = lower.join(above.hint("shuffle_hash"), F.col("g").eqNullSafe(F.col("g_")) & (F.col("block") == F.col("block_")))
        return out.withColumn("path", F.concat("sibs", "path_")).drop("g_", "block_", "path_", "sibs", "top")

    extra = [c for c in roots.columns if c not in ("g", "path")]
    return reduce(join, reversed(rounds), roots.withColumn("pos", F.lit(0).cast("long")))


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", claim: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every row of docs.

    The leaves of a group ascend by key, nulls first; equal keys go by leaf, and rows that are equal
    throughout are leaves of their own, any of which may come first. A null group is a group and comes
    before all others; groups' roots go in bytewise order. path: the siblings from the leaf to the root,
    "" where there is none. claim: an expression of docs, the leaf that is to be verified (default, and
    where it is null: the leaf itself); folded_root hashes it with path, and verified says whether the
    root comes out. Null values and empty and long texts are hashed as leaf() says; other columns of
    docs, whatever their names, take no part. An empty table gives no rows.
    """
    own = leaf(*[F.col(f"`{c}`") for c in columns])
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    other = F.lit(None).cast("string") if claim is None else claim
    leaves = docs.select(g.alias("g"), F.col(f"`{key}`").alias("key"), own.alias("digest"), other.alias("claim"))
    rounds, roots = _tree(numbered(leaves, "g", ["key", "digest"], "merkle-leaves"), "merkle")

    # the roots of the groups are the leaves of the last tree
    upper = numbered(roots.select(F.lit("all").alias("g"), F.col("g").alias("name"), "digest"), "g", ["name"], "merkle-roots")
    top, root = _tree(upper, "merkle-top")
    one = root.first()  # one row
    whole = root.select("g", F.array().cast("array<string>").alias("path"))
    groups = _down(top, whole).select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"), F.col("pos").alias("place"), F.size("path").alias("above"))

    out = _down(rounds, groups).withColumn("root", F.lit(one["digest"] if one else None).cast("string"))
    side = "IF(i < size(path) - above, shiftright(pos, i), shiftright(place, i - size(path) + above)) & 1"
    fold = f"aggregate(transform(path, (s, i) -> struct(s AS s, {side} AS second)), coalesce(claim, digest), (a, x) -> sha2(IF(x.second = 1, concat(x.s, a), concat(a, x.s)), 256))"
    return out.withColumn("folded_root", F.expr(fold)).select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
