"""Writes as snapshots: old and new rows in, the next snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.values import comparable, has_map, merged_map


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    pack = lambda df, name: df.select(*keys, F.struct(*df.columns).alias(name))
    return pack(old, "_old").join(pack(new, "_new"), keys, "full")


def _unpack(df: DataFrame, columns: list[str], extra: tuple = ()) -> DataFrame:
    return df.select(*(F.col("_row")[c].alias(c) for c in columns), *extra)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed: Column, action: str | None = None) -> DataFrame:
    """The next snapshot: new rows, and over old rows those for which `changed` holds (of `_old` and `_new`).

    action: the name of a column that says inserted, updated, unchanged or kept.
    """
    what = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(F.coalesce(changed, F.lit(False)), "updated").otherwise("unchanged")
    df = _both(old, new, keys).withColumn("_what", what)
    df = df.withColumn("_row", F.when(F.col("_what").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old")))
    return _unpack(df, old.columns, (F.col("_what").alias(action),) if action else ())


def upsert_by_hash(old: DataFrame, new: DataFrame, keys: list[str], hash_column: str, action: str | None = None) -> DataFrame:
    """Nothing happens to a row whose hash is as before."""
    return upsert(old, new, keys, ~F.col("_old")[hash_column].eqNullSafe(F.col("_new")[hash_column]), action)


def upsert_if_different(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], action: str | None = None) -> DataFrame:
    row = lambda side: F.struct(*(comparable(F.col(side)[c], old.schema[c].dataType).alias(c) for c in columns))
    return upsert(old, new, keys, ~row("_old").eqNullSafe(row("_new")), action)


def upsert_if_newer(old: DataFrame, new: DataFrame, keys: list[str], time: str, action: str | None = None) -> DataFrame:
    """A late observation never replaces a newer one; an equally old one does."""
    return upsert(old, new, keys, F.col("_new")[time] >= F.col("_old")[time], action)


def upsert_if_richer(old: DataFrame, new: DataFrame, keys: list[str], array: str, action: str | None = None) -> DataFrame:
    """The row with more array entries wins; the new one if they are as many."""
    n = lambda side: F.coalesce(F.array_size(F.col(side)[array]), F.lit(0))
    return upsert(old, new, keys, n("_new") >= n("_old"), action)


def upsert_same_owner(old: DataFrame, new: DataFrame, keys: list[str], owner: str) -> tuple[DataFrame, DataFrame]:
    """The next snapshot, in which keys keep their owner; and the new rows that conflict."""
    same = F.col("_old")[owner].eqNullSafe(F.col("_new")[owner])
    both = _both(old, new, keys).where(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~same).withColumn("_row", F.col("_new"))
    return upsert(old, new, keys, same), _unpack(both, new.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def merge_counts(merged: DataFrame, action: str) -> DataFrame:
    """inserted, updated and unchanged rows of a merge."""
    return merged.agg(*(F.count_if(F.col(action) == a).alias(a) for a in ("inserted", "updated", "unchanged")))


def last_of_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_of_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def drop_siblings(old: DataFrame, kept: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Old rows, less those of a kept key whose column has another value than the kept one."""
    k = kept.select(*keys, F.col(column).alias("_kept")).distinct()
    return old.join(k, [*(old[x] == k[x] for x in keys), old[column] != k["_kept"]], "left_anti")


def update_from(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the columns of their change, where there is one."""
    c = changes.select(*keys, F.struct(*columns).alias("_c"))
    joined = old.join(c, keys, "left")
    return joined.select(*(F.when(F.col("_c").isNotNull(), F.col("_c")[x]).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns))


def replace_by_rank(old: DataFrame, new: DataFrame, keys: list[str], rank, action: str | None = None) -> DataFrame:
    """New rows replace old ones of the same or a worse rank; `rank` maps a struct column to a number, low is good."""
    return upsert(old, new, keys, rank(F.col("_new")) <= rank(F.col("_old")), action)


def merge_maps(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of both, with the entries of both maps; the new ones win."""
    both = _both(old, new, keys)
    one = F.coalesce(F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), merged_map(F.col("_old")[column], F.col("_new")[column])), F.col("_new")[column], F.col("_old")[column])
    return both.select(*keys, one.alias(column))


def stale_removed(old: DataFrame, new: DataFrame, scope: list[str], keys: list[str], manual: Column) -> DataFrame:
    """The next mappings: new rows, manual old ones, and old ones outside the scope of the new rows.

    A manual row displaces an automatic one of the same key.
    """
    by_hand = old.where(manual)
    outside = old.where(~manual).join(new.select(*scope).distinct(), scope, "left_anti")
    return by_hand.unionByName(outside).unionByName(new.join(by_hand.select(*keys), keys, "left_anti"))


def map_changes(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A change log of rows that both sides have: keys, entry, from_value, to_value."""
    a, b = old.select(*keys, F.col(column).alias("_a")), new.select(*keys, F.col(column).alias("_b"))
    one = a.join(b, keys).withColumn("entry", F.explode(F.array_union(F.map_keys("_a"), F.map_keys("_b"))))
    out = one.select(*keys, "entry", F.try_element_at("_a", "entry").alias("from_value"), F.try_element_at("_b", "entry").alias("to_value"))
    return out.where(~F.col("from_value").eqNullSafe(F.col("to_value")))


def except_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """The different rows of new that old doesn't have; columns may hold maps, which are equal if their entries are."""
    kinds = {c: new.schema[c].dataType for c in new.columns}
    if not any(map(has_map, kinds.values())):
        return new.subtract(old.select(*new.columns))
    named = {c: f"_c{k}" for k, c in enumerate(new.columns)}
    plain = lambda df: [comparable(df[c], kinds[c]).alias(x) for c, x in named.items()]
    marked = new.select(*new.columns, *plain(new)).dropDuplicates(list(named.values()))
    held = old.select(*plain(old))
    return marked.join(held, [marked[x].eqNullSafe(held[x]) for x in named.values()], "left_anti").select(*new.columns)


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns old into new: `op` delete (other columns null) or upsert."""
    gone = old.select(*keys).subtract(new.select(*keys))
    rest = [c for c in new.columns if c not in keys]
    deletes = gone.select(F.lit("delete").alias("op"), *keys, *(F.lit(None).cast(new.schema[c].dataType).alias(c) for c in rest))
    return deletes.unionByName(except_rows(new, old).select(F.lit("upsert").alias("op"), *keys, *rest))


def apply_delta(old: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    kept = old.join(change.select(*keys), keys, "left_anti")
    return kept.unionByName(change.where("op = 'upsert'").select(*old.columns))


def reordered(df: DataFrame, key: str, ids: list | DataFrame, column: str = "position") -> DataFrame:
    """Positions from 0 by a given order of keys; others keep theirs. ids: a list from a caller, or rows (key, position)."""
    order = ids if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), [key, column])
    order = order.select(key, F.col(column).alias("_at"))
    return df.join(order, key, "left").withColumn(column, F.coalesce(F.col("_at"), F.col(column))).select(*df.columns)


def next_position(df: DataFrame, keys: list[str], column: str = "position") -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_position"))


def swept(log: DataFrame, cutoff: Column, time: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """A log without entries before the cutoff, and its horizon: the greatest sequence number removed."""
    return log.where(F.col(time) >= cutoff), log.where(F.col(time) < cutoff).agg(F.max(sequence).alias("horizon"))


def override(held: DataFrame, manual: DataFrame, keys: list[str], name: str = "manual") -> DataFrame:
    """Manual rows, and held rows of keys without one; a column says which."""
    rest = held.join(manual.select(*keys), keys, "left_anti")
    return rest.withColumn(name, F.lit(False)).unionByName(manual.withColumn(name, F.lit(True)))


def purge_marks(rows: DataFrame, status: str, time: str, cutoffs: dict[str, str], name: str = "expired") -> DataFrame:
    """Rows with a column that says whether they are older than their status allows."""
    old = F.lit(False)
    for s, at in cutoffs.items():
        old = old | ((F.col(status) == s) & (F.col(time) < F.to_timestamp(F.lit(at))))
    return rows.withColumn(name, F.coalesce(old, F.lit(False)))


def backfill_single(rows: DataFrame, details: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows with the value of their only detail row, else null."""
    one = details.groupBy(*keys).agg(F.min(value).alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return rows.join(one, keys, "left")


def bump_once(counters: DataFrame, runs: DataFrame, counter: str = "catalog_version", most: int = 10_000) -> DataFrame:
    """Counters (name, value, run_id) after finished runs (run_id): one more for each run that wasn't counted before.

    More than `most` such runs are counted page by page, by further calls.
    """
    fresh = runs.select("run_id").distinct().join(counters.where(F.col("name") == counter).select("run_id"), "run_id", "left_anti")
    last = counters.where(F.col("name") == counter).agg(F.coalesce(F.max("value"), F.lit(0)).alias("last")).first()["last"]
    # The page is cut before the window, so that its one partition is bounded.
    nth = F.row_number().over(Window.orderBy("run_id"))
    return counters.unionByName(fresh.orderBy("run_id").limit(most).select(F.lit(counter).alias("name"), (F.lit(last) + nth).cast("long").alias("value"), "run_id"))


def written_back(rows: DataFrame, jobs: DataFrame, results: DataFrame, gone: DataFrame, rank, at: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key) and the list of gone sources (url, since) after a run of transfers.

    jobs: id, url; results: url, key (null: nothing stored), status (ok, gone, failed). A row takes the new key unless it
    has a better one (`rank` maps a key to a number, low is good). A source that is gone is listed from its first time
    on, one that came leaves the list, a failure changes nothing.
    """
    c = F.col
    stored = results.where("status = 'ok' AND key IS NOT NULL").groupBy("url").agg(F.min("key").alias("_new"))
    # One job of a row counts, the one with the best picture.
    best = jobs.select("id", "url").distinct().join(stored, "url").groupBy("id").agg(F.min_by("_new", F.struct(F.coalesce(rank(c("_new")), F.lit(99)), c("_new"))).alias("_new"))
    worse = lambda x: F.coalesce(rank(x), F.lit(99))
    taken = c("_new").isNotNull() & (c("key").isNull() | (worse(c("_new")) <= worse(c("key"))))
    after = rows.join(best, "id", "left").withColumn("key", F.when(taken, c("_new")).otherwise(c("key"))).select(*rows.columns)
    came, lost = results.where("status = 'ok'").select("url").distinct(), results.where("status = 'gone'").select("url").distinct()
    fresh = lost.join(came, "url", "left_anti").join(gone, "url", "left_anti").select("url", at.alias("since"))
    return after, gone.join(came, "url", "left_anti").select("url", "since").unionByName(fresh)


def sibling_values(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows without a value take that of their first sibling (by an order) that has one; siblings share the keys."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias("_first"))
    return rows.join(first, keys, "left").withColumn(value, F.coalesce(value, "_first")).select(*rows.columns)


def swapped_keys(rows: DataFrame, key: str, pattern: str, replacement: str, held: DataFrame) -> DataFrame:
    """Rows whose key, with a pattern replaced, is one of the held keys, take that one."""
    new = F.regexp_replace(key, pattern, replacement)
    there = held.select(F.col(key).alias("_there")).distinct()
    return rows.withColumn("_there", new).join(there.withColumn("_has", F.lit(True)), "_there", "left").withColumn(key, F.when(F.col("_has"), F.col("_there")).otherwise(F.col(key))).select(*rows.columns)
