"""Work in one global order, without a task that walks the whole order.

Rows are dealt out by ranges of the order and saved, so that a place in the order is a range's number and a place in the
range. Running sums are sums within a range and the totals of the ranges before; only those totals, one a range, are
added up in one place. Chunks follow from pointers to where the next one would begin: pointer doubling finds all
beginnings that the first row leads to, in as many rounds as the longest run of chunks has binary digits. Where keys begin
anew, all this is for the largest of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakewright.sources.scratch import Steps

c = F.col
#: Rows of one value of the keys that one task takes in turn; more go by ranges of the order.
IN_TURN = 1_000_000


def ranged(df: DataFrame, order: list[Column], steps: Steps, name: str = "_range") -> DataFrame:
    """df, saved, with the number of the range that each row is in; ranges follow the order, rows that tie share one."""
    # The sort gives each range its own numbers: the order's columns are kept, and a range's number is its task's.
    return steps.save(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], range_column: str = "_range") -> DataFrame:
    """df with a running sum for each name: of all rows up to and with this one. The order must be total, df ranged by it."""
    w = Window.partitionBy(range_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(range_column).agg(*(F.sum(x).alias(f"{n}_t") for n, x in sums.items()))
    # One row a range.
    before = Window.orderBy(range_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(range_column, *(F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_t") for n in sums))
    within = df.withColumns({n: F.sum(x).over(w) for n, x in sums.items()})
    joined = within.join(offsets, range_column)
    return joined.withColumns({n: c(n) + c(f"{n}_t") for n in sums}).drop(*(f"{n}_t" for n in sums))


def greedy_chunks(df: DataFrame, keys: list[str], order: list[str], size: Column, limit: int, *, name: str = "chunk") -> DataFrame:
    """df with the number of each row's chunk, from 0 for each value of the keys.

    Rows are taken in order; one that would make its chunk larger than `limit` begins the next. A row is never split, so
    one that is larger than the limit is a chunk by itself. Sizes are whole numbers, 0 or more; a null one counts as 0.
    keys and order together must name a row; rows that tie in all of them fall in any order.

    Values of the keys with up to `IN_TURN` rows are dealt out and taken in turn; others go by ranges of the whole order.
    """
    if not keys:
        return _by_ranges(df, keys, order, size, limit, name)
    large = Steps(df.sparkSession, "large").save(df.groupBy(*(c(k).alias(f"_key{i}") for i, k in enumerate(keys))).count().where(c("count") > IN_TURN).drop("count"))
    if large.isEmpty():
        return _in_turn(df, keys, order, size, limit, name)
    same = [c(k).eqNullSafe(c(f"_key{i}")) for i, k in enumerate(keys)]
    rest, most = df.join(large, same, "left_anti"), df.join(large, same, "left_semi")
    return _in_turn(rest, keys, order, size, limit, name).unionByName(_by_ranges(most, keys, order, size, limit, name))


def _in_turn(df: DataFrame, keys: list[str], order: list[str], size: Column, limit: int, name: str) -> DataFrame:
    """One exchange by the keys; a task adds up the rows of its keys in order, batch after batch."""

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = chunk = 0
        for b in batches:
            numbers = []
            for nth, one in zip(b["_nth"].to_pylist(), b["_size"].to_pylist(), strict=True):
                if nth == 1:
                    total, chunk = one, 0
                elif total + one > limit:
                    total, chunk = one, chunk + 1
                else:
                    total += one
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in columns), pa.array(numbers, pa.int64())], names=[*columns, name])

    columns = df.columns
    out = StructType([*df.schema.fields, StructField(name, LongType())])
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumns({"_size": F.coalesce(size, F.lit(0)).cast("long"), "_nth": F.row_number().over(w)})
    return placed.mapInArrow(added, out)


def _by_ranges(df: DataFrame, keys: list[str], order: list[str], size: Column, limit: int, name: str) -> DataFrame:
    steps = Steps(df.sparkSession, "chunks")
    total_order = [c(k) for k in (*keys, *order)]
    base = df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    placed = running(ranged(base, total_order, steps), total_order, {"_at": F.lit(1).cast("long"), "_sum": c("_size")}).drop("_range")
    rows = steps.save(placed)
    # Keys are null-safe.
    by_key = [c(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    same = [c(k).eqNullSafe(c(f"_key{i}")) for i, k in enumerate(keys)]
    ends = steps.save(rows.groupBy(*by_key).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("_first IS NOT NULL"))
    # How many rows' sums stay within each row's own start plus the limit: both kinds of numbers in one order.
    marks = rows.select(c("_sum").alias("_v"), F.lit(0).alias("_kind"), "_at").unionByName(rows.select((c("_sum") - c("_size") + limit).alias("_v"), F.lit(1).alias("_kind"), "_at"))
    mark_order = [c("_v"), c("_kind"), c("_at")]
    counted = running(ranged(marks, mark_order, steps), mark_order, {"_fit": (1 - c("_kind")).cast("long")})
    reach = counted.where("_kind = 1").select("_at", F.greatest(c("_fit"), c("_at")).alias("_until"))
    held = rows.select(*keys, "_at").join(ends, same) if keys else rows.select("_at").crossJoin(F.broadcast(ends))
    # The next chunk begins after the last row that fits; none beyond the key's last row.
    hop = held.select("_at", "_first", "_last").join(reach, "_at").where("_until < _last").select(c("_at").alias("_from"), (c("_until") + 1).alias("_to"))
    hops, found = [steps.save(hop)], steps.save(ends.select(c("_first").alias("_from"), F.lit(0).cast("long").alias("_rank")))
    while not hops[-1].isEmpty():
        a, b = hops[-1].alias("a"), hops[-1].alias("b")
        hops.append(steps.save(a.join(b, c("a._to") == c("b._from")).select(c("a._from").alias("_from"), c("b._to").alias("_to"))))
    for k in range(len(hops) - 2, -1, -1):
        onward = found.join(hops[k], "_from").select(c("_to").alias("_from"), (c("_rank") + 2**k).alias("_rank"))
        found = steps.save(found.unionByName(onward))
    # A chunk's number is that of the last beginning up to the row: beginnings so far, less those before the key's own.
    begun = rows.join(found.select(c("_from").alias("_at"), F.lit(1).cast("long").alias("_begins")), "_at", "left").withColumn("_begins", F.coalesce("_begins", F.lit(0)))
    numbered = running(ranged(begun, [c("_at")], steps), [c("_at")], {"_nth": c("_begins")}).drop("_range")
    numbered = steps.save(numbered)
    if not keys:
        return numbered.select(*df.columns, (c("_nth") - 1).alias(name))
    first = steps.save(numbered.groupBy(*by_key).agg(F.min("_nth").alias("_own")))
    return numbered.join(first, same).select(*df.columns, (c("_nth") - c("_own")).alias(name))
