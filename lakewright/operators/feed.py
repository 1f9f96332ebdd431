"""Change feeds: cursors, retention and last-writer-wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.values import later_than

from .pick import distinct_on


def pull(feed: DataFrame, since: int, *, sequence: str = "seq", most: int = 500, budget: int | None = None, size: Column | None = None, horizon: int = 0) -> DataFrame:
    """The next page after a cursor, lowest first. A cursor behind the horizon must start over: it gets no rows.

    budget: rows whose sizes sum up beyond it wait for the next page; the first row always goes.
    """
    if since < horizon:
        return feed.limit(0)
    # The page is cut before the running sum, so that sum has at most `most` rows in its one partition.
    page = feed.where(F.col(sequence) > since).orderBy(sequence).limit(most)
    if budget is None:
        return page
    w = Window.orderBy(sequence)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("_sum", running).withColumn("_nth", F.row_number().over(w)).where((F.col("_sum") <= budget) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def resolve(stored: DataFrame, pushed: DataFrame, key: str, same: Column) -> DataFrame:
    """key, action, updated_at: what each pushed row does to the stored one.

    stored and pushed have updated_at and deleted_at, pushed has base_updated_at (what the device last saw); a
    deleted stored row is its log entry. same: whether the stored fields equal the pushed ones, of `s` and `p`.
    """
    s, p = stored.alias("s"), pushed.alias("p")
    c = F.col
    none = c(f"s.{key}").isNull()
    s_gone, p_gone = c("s.deleted_at").isNotNull(), c("p.deleted_at").isNotNull()
    saw = ~s_gone & c("p.base_updated_at").isNotNull() & (c("s.updated_at") <= c("p.base_updated_at"))
    newer = F.coalesce((p_gone & (c("p.deleted_at") > c("s.updated_at"))) | (s_gone & ~p_gone & (c("p.updated_at") > c("s.deleted_at"))), F.lit(False))
    action = (
        F.when(none & p_gone, "skip").when(none & c("p.base_updated_at").isNotNull(), "conflict").when(none, "insert")
        .when(F.coalesce(same, F.lit(False)) | (s_gone & p_gone), "noop")
        .when(saw | newer, F.when(s_gone, "insert").otherwise("apply"))
        .otherwise("conflict")
    )
    joined = p.join(s, c(f"p.{key}") == c(f"s.{key}"), "left").select(c(f"p.{key}").alias(key), action.alias("action"), c("p.updated_at").alias("_p"), c("s.updated_at").alias("_s"))
    when = F.when(c("action").isin("insert", "apply"), F.when(c("_s").isNull(), c("_p")).otherwise(later_than(c("_p"), c("_s")))).when(c("action") == "noop", c("_s")).when(c("action") == "skip", c("_p"))
    return joined.select(key, "action", when.alias("updated_at"))


def push(stored: DataFrame, pushed: DataFrame, owner: str, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The next snapshot after a push, and what became of each pushed row: owner, key, action, updated_at.

    If a device sends a key more than once, its last row counts (by the time of the change; of equally old ones a deletion,
    then the greatest fields), and the others come out as `superseded`.

    stored: owner, key, fields, updated_at, deleted_at, seq; deleted rows stay as log entries without fields. pushed: the
    same without seq, and base_updated_at. Rows that change anything get the owner's next sequence numbers, in order of
    their keys, so that other devices pull them.
    """
    c = F.col
    same = reduce(lambda a, b: a & b, (c(f"s.{f}").eqNullSafe(c(f"p.{f}")) for f in fields)) & c("s.deleted_at").isNull() & c("p.deleted_at").isNull()
    at = lambda df: df.withColumn("_key", F.struct(owner, key))
    last_said = [F.coalesce("deleted_at", "updated_at").desc_nulls_last(), c("deleted_at").isNotNull().desc(), F.struct(*fields, "base_updated_at").desc()]
    ranked = pushed.withColumn("_said", F.row_number().over(Window.partitionBy(owner, key).orderBy(*last_said)))
    superseded = ranked.where("_said > 1").select(owner, key, F.lit("superseded").alias("action"), "updated_at")
    pushed = ranked.where("_said = 1").drop("_said")
    done = resolve(at(stored), at(pushed), "_key", same)
    acted = at(pushed).drop("updated_at").join(done, "_key").drop("_key")
    last = stored.groupBy(owner).agg(F.max("seq").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(key))
    changed = acted.where(c("action").isin("insert", "apply")).join(last, owner, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + nth).cast("long"))
    gone = c("deleted_at").isNotNull()
    rows = changed.select(owner, key, *(F.when(~gone, c(f)).alias(f) for f in fields), "updated_at", F.when(gone, c("updated_at")).alias("deleted_at"), "seq")
    kept = stored.join(rows.select(owner, key), [owner, key], "left_anti")
    return kept.select(*rows.columns).unionByName(rows), acted.select(owner, key, "action", "updated_at").unionByName(superseded)


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; each task keeps one row of a key before the shuffle."""
    return distinct_on(rows, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])
