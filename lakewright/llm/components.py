"""Connected components of a link table, on Spark, with bounded groups.

Alternating large-star and small-star rounds move every link towards the least node of its component. A hot node's
neighbours are never gathered: each round takes a minimum over them, which Spark aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

ROUNDS = 40


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node of its component, for every node of the links (u, v) that isn't itself the root.

    u and v are of one ordered type; nulls, loops and repeats do no harm. Nodes without links have no row.
    """
    ordered = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(ordered, "links")
    print_now = _print(now)
    for _ in range(ROUNDS):
        # Large star: every larger neighbour of u links to the least of u's neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are saved, so that the joins read two plain exchanges, which Spark can split at a hot node.
        least = scratch.save(_least_neighbour(both).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u's smaller neighbours, and u, link to the least of them.
        large = scratch.save(large, "large")
        low = scratch.save(_least_neighbour(large), "low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = scratch.save(small, "links")
        print_before, print_now = print_now, _print(new)
        for done in (now, least, large, low):
            scratch.drop(done)
        now = new
        if print_now == print_before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"links still change after {ROUNDS} rounds")


def _print(links: DataFrame) -> tuple:
    """A count and a sum of hashes, to see whether a round changed anything."""
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
