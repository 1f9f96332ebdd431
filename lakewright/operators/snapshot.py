"""Hashes and summaries of groups, for change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_hash(df: DataFrame, keys: list[str], order: str, columns: list[str], *, buckets: int = 1024, name: str = "hash") -> DataFrame:
    """keys, hash: an MD5 of each group's rows in order of an integer column.

    Rows are hashed in buckets of that column, then the buckets' hashes; so no task holds a whole large group.
    """
    row = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).cast("binary"))
    lines = df.select(*keys, (F.col(order) % buckets).alias("_bucket"), F.struct(F.col(order).alias("at"), row.alias("h")).alias("_row"))
    joined = lambda x: F.md5(F.array_join(F.transform(F.array_sort(x), lambda r: r["h"]), ",").cast("binary"))
    inner = lines.groupBy(*keys, "_bucket").agg(joined(F.collect_list("_row")).alias("h"))
    return inner.groupBy(*keys).agg(joined(F.collect_list(F.struct(F.col("_bucket").alias("at"), "h"))).alias(name))


def changed_groups(old: DataFrame, new: DataFrame, keys: list[str], name: str = "hash") -> DataFrame:
    """keys, op: the groups to write anew, and those to delete."""
    both = old.select(*keys, F.col(name).alias("_old")).join(new.select(*keys, F.col(name).alias("_new")), keys, "full")
    op = F.when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "write")
    return both.withColumn("op", op).where("op IS NOT NULL").select(*keys, "op")


def count_maps(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and a map of counts by value; the values are few, and counted before they meet."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, "n"))).alias(name))
