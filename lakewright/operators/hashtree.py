"""Deltas through a hash tree: what two versions share isn't read.

Every row belongs to a leaf, a range of the hash of its keys: leaf k of 16**depth holds the rows whose hash begins with
the hexadecimal digits of k. A leaf's hash is a sum over its rows' hashes, so it doesn't depend on any order and Spark
combines it before the shuffle; a node's hash is the sum of its 16 children's. Two trees are compared from the root
down, only below nodes that differ. A table that is stored by leaf is then read only where they do.

Rows count with their repeats. Columns may hold maps: equal entries are equal maps. A sum is of two independent 64-bit
hashes of each row, so that different rows don't go unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.values import comparable

from .merge import delta

FAN_BITS = 4
DEPTH = 2
MOST_DEPTH = 5


def depth_for(rows: int, per_leaf: int = 100_000) -> int:
    """So deep that a leaf holds about so many rows."""
    depth = 1
    while depth < MOST_DEPTH and rows > per_leaf << FAN_BITS * depth:
        depth += 1
    return depth


def leaf(keys: list[str], depth: int = DEPTH) -> Column:
    """The number of a row's leaf: the first bits of the hash of its keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN_BITS * depth).cast("int")


def tree(df: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """level (0: the root), node, n, hash: all nodes that have rows, (16**(depth + 1) - 1) / 15 at most."""
    row = F.struct(*(comparable(df[c], df.schema[c].dataType).alias(c) for c in sorted(df.columns)))
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    leaves = df.groupBy(leaf(keys, depth).alias("leaf")).agg(F.count("*").alias("n"), *sums)
    # Each leaf counts for its node of every level; the leaves are few.
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = leaves.withColumn("level", levels).withColumn("node", F.expr(f"shiftright(leaf, {FAN_BITS} * ({depth} - level))"))
    summed = nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return summed.select("level", "node", "n", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("hash"))


def different(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> list[int]:
    """The leaves in which two trees differ, found from the root down.

    Each step reads the children of the nodes that differ; what it brings to the driver are numbers of nodes, bounded by
    the tree, not by the rows.
    """
    found = [0]
    for level in range(depth + 1):
        at = (F.col("level") == level) & F.col("node").isin(found if level == 0 else [n << FAN_BITS | k for n in found for k in range(1 << FAN_BITS)])
        a, b = (t.where(at).select("node", F.struct("n", "hash").alias(name)) for t, name in ((old, "a"), (new, "b")))
        found = sorted(r["node"] for r in a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        if not found:
            break
    return found


def tree_delta(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, keys: list[str], *, depth: int = DEPTH, leaf_column: str = "leaf") -> DataFrame:
    """What `merge.delta` gives, from the leaves that differ. old and new have the leaf's number, best as the column they are stored by."""
    leaves = different(old_tree, new_tree, depth)
    part = lambda df: df.where(F.col(leaf_column).isin(leaves) if leaves else F.lit(False)).drop(leaf_column)
    return delta(part(old), part(new), keys)
