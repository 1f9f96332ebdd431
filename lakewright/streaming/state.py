"""Streams with state per key: newest rows, once a day, pushes resolved in turn, change feeds with a horizon.

Each job keeps what it knows of a key in Spark's state store, in the checkpoint: a restart goes on from there, rows that
come late or again change nothing that they shouldn't, and the present table of a job is read from its state. Event-time
timers drop what the watermark has passed, so state is bounded by what can still change.

The state's timers need the watermark of the stream; all jobs end when the input that was there at the start is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state of this kind is held in RocksDB; other streams of the session keep what they have."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(out: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a job gives to a folder, until no input is left."""
    with state_store(out.sparkSession):
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, checkpoint: str, name: str, times: list[str] = ()) -> DataFrame:
    """A state variable of a job as a table: its keys and values. times: the columns that are time stamps."""
    with state_store(spark):
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    if BUCKET in rows.schema["key"].dataType.names:
        # A bucket's lists hold its keys too.
        rows = rows.select("value.*").select(_unpacked(rows.schema["value"].dataType.names))
    else:
        rows = rows.select("key.*", "value.*")
    return _stamped(rows, times)


def _counted(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Time stamps as microseconds, so that no time zone of a worker has a say."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
    return df.withColumns({t: F.unix_micros(t) for t in times}), times


def _stamped(df: DataFrame, times: list[str]) -> DataFrame:
    return df.withColumns({t: F.timestamp_micros(t) for t in times})


def _schema(df: DataFrame, columns: list[str]) -> StructType:
    return StructType([StructField(c, df.schema[c].dataType) for c in columns])


class Newest(StatefulProcessor):
    """The newest row of a key. Gives each row that takes the place."""

    def __init__(self, keys: list[str], rest: StructType, time: str, tie: str):
        self.keys, self.rest = keys, rest
        self.order = [rest.names.index(time), rest.names.index(tie)]

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", self.rest)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        before = best = tuple(self.newest.get()) if self.newest.exists() else None
        rank = lambda r: [r[k] for k in self.order]
        for r in rows:
            one = tuple(r[c] for c in self.rest.names)
            if best is None or rank(one) > rank(best):
                best = one
        if best != before:
            self.newest.update(best)
            yield Row(**dict(zip(self.keys, key, strict=True)), **dict(zip(self.rest.names, best, strict=True)))

    def close(self) -> None:
        pass


def newest(stream: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """A row whenever a key has a newer one: a late observation never replaces a newer one, a repeated one changes nothing."""
    stream, times = _counted(stream)
    rest = [c for c in stream.columns if c not in keys]
    return _stamped(stream.groupBy(*keys).transformWithState(Newest(keys, _schema(stream, rest), time, tie), _schema(stream, keys + rest), "Append", "None"), times)


class OncePerDay(StatefulProcessor):
    """The first row of a key and day that arrives. A day is forgotten when the watermark has passed its end.

    A key's open days are one value, read and written once a batch; its timer is that of the first to end.
    """

    def __init__(self, out: StructType):
        self.out = out

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "until array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        passed = timerValues.getCurrentWatermarkInMs()
        before = self.days.get()
        seen = set(before[0]) if before else set()
        first = min(seen, default=None)
        new = False
        for r in rows:
            until = r["_until"]
            if until > passed and until not in seen:
                seen.add(until)
                new = True
                yield Row(**{c: r[c] for c in self.out.names})
        if new:
            self.days.update((sorted(seen),))
            if min(seen) != first:
                self.handle.registerTimer(min(seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self.days.get()
        left = [x for x in (held[0] if held else []) if x > passed]
        if left:
            self.days.update((left,))
            self.handle.registerTimer(left[0])
        else:
            self.days.clear()
        yield from ()

    def close(self) -> None:
        pass


def once_per_day(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """At most one row of each key and day of the session's time zone, over restarts; rows of days that the watermark has passed are dropped."""
    dated = stream.withColumn("day", F.to_date(time)).withWatermark(time, late)
    out = _schema(dated, dated.columns)
    ending = dated.withColumn("_until", F.unix_millis(F.date_add("day", 1).cast("timestamp")))
    return ending.groupBy(*keys).transformWithState(OncePerDay(out), out, "Append", "EventTime")


def resolved(stored: dict | None, pushed: dict, fields: list[str]) -> tuple[str, dict | None]:
    """What a pushed row does to a stored one, and the row that is stored then; times are microseconds. As `operators.feed.resolve`, for one row."""
    gone = pushed["deleted_at"] is not None
    if stored is None:
        if gone:
            return "skip", None
        if pushed["base_updated_at"] is not None:
            return "conflict", None
        return "insert", pushed
    was_gone = stored["deleted_at"] is not None
    same = not gone and not was_gone and all(stored[f] == pushed[f] for f in fields)
    if same or (gone and was_gone):
        return "noop", stored
    base = pushed["base_updated_at"]
    saw = not was_gone and base is not None and stored["updated_at"] <= base
    newer = pushed["deleted_at"] > stored["updated_at"] if gone else was_gone and pushed["updated_at"] > stored["deleted_at"]
    if not (saw or newer):
        return "conflict", stored
    # A time stamp never goes back: whole milliseconds, one more than before at least.
    at = max(pushed["updated_at"] // 1000, stored["updated_at"] // 1000 + 1) * 1000
    return "insert" if was_gone else "apply", {**pushed, "updated_at": at, "deleted_at": at if gone else None}


#: The name of a column that deals keys out to buckets whose state is one value.
BUCKET = "_bucket"
#: Rows and bytes of a task that are packed together.
PACK_ROWS, PACK_BYTES = 1 << 18, 1 << 26


def _lists(schema: StructType) -> StructType:
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in schema.fields])


def _unpacked(names: list[str]) -> Column:
    """The rows of lists side by side."""
    return F.inline(F.arrays_zip(*names))


def packed(df: DataFrame, key: str) -> DataFrame:
    """key, and a list of each other column: the rows of one key that a task has at a time in one row, in any order."""
    names = [c for c in df.columns if c != key]

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows[key])).combine_chunks()
        k = rows[key].to_numpy()
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        offsets = pa.array(np.r_[first, len(k)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(k[first]), *(pa.ListArray.from_arrays(offsets, rows[c].combine_chunks()) for c in names)], [key, *names])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held, n, size = [*held, b], n + b.num_rows, size + b.nbytes
            if n >= PACK_ROWS or size >= PACK_BYTES:
                yield pack(held)
                held, n, size = [], 0, 0
        if held:
            yield pack(held)

    return df.mapInArrow(lists, StructType([df.schema[key], *_lists(_schema(df, names)).fields]))


class Pushes(StatefulProcessor):
    """The rows of each key of a bucket resolved in turn, last writer wins. Gives an action for each.

    What is known of a bucket's keys is one value of lists, read and written once a batch; pushes come and answers go as
    lists. So calls of the state and rows that Python takes apart are counted by buckets, not by keys.
    """

    def __init__(self, keys: StructType, stored: StructType, fields: list[str], order: StructField):
        self.keys, self.stored, self.fields, self.order = keys, stored, fields, order

    def init(self, handle) -> None:
        self.now = handle.getValueState("stored", _lists(StructType([*self.keys.fields, *self.stored.fields])))
        #: The last push that was resolved of each key, also where nothing is stored.
        self.turn = handle.getValueState("turn", _lists(StructType([*self.keys.fields, self.order])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names, n = self.stored.names, len(self.keys)
        stored = {r[:n]: dict(zip(names, r[n:], strict=True)) for r in zip(*(self.now.get() or ()), strict=True)}
        turns = {r[:n]: r[n] for r in zip(*(self.turn.get() or ()), strict=True)}
        taken = [*self.keys.names, self.order.name, *names, "base_updated_at"]
        pushed = [one for r in rows for one in zip(*(r[c] for c in taken), strict=True)]
        done, changed = [], False
        for r in sorted(pushed, key=itemgetter(n)):
            one, turn = r[:n], r[n]
            last = turns.get(one)
            if last is not None and turn <= last:
                continue  # has been here before
            turns[one] = turn
            now = stored.get(one)
            action, after = resolved(now, dict(zip(taken[n + 1 :], r[n + 1 :], strict=True)), self.fields)
            if after is not None and after is not now:
                stored[one], changed = {c: after[c] for c in names}, True
            done.append((*one, turn, action))
        if changed:
            self.now.update(tuple(zip(*((*k, *v.values()) for k, v in stored.items()), strict=True)))
        if done:
            self.turn.update(tuple(zip(*((*k, v) for k, v in turns.items()), strict=True)))
            yield Row(**dict(zip([*taken[: n + 1], "action"], map(list, zip(*done, strict=True)), strict=True)))

    def close(self) -> None:
        pass


def pushes(stream: DataFrame, keys: list[str], fields: list[str], order: str, *, buckets: int = 1 << 13) -> DataFrame:
    """keys, order, action for each pushed row, in turn of a column that numbers a key's pushes as they come (a row that comes again is known by it).

    stream: keys, fields, updated_at, deleted_at, base_updated_at, and that number. The state `stored` is the table.
    buckets: among how many values of the state the keys are dealt out, fixed with the checkpoint. A batch reads and
    writes the whole buckets of its keys: more buckets suit small batches on a large table.
    """
    stream, _ = _counted(stream)
    known, stored = _schema(stream, keys), _schema(stream, [*fields, "updated_at", "deleted_at"])
    out = StructType([*_schema(stream, [*keys, order]).fields, StructField("action", StringType())])
    dealt = packed(stream.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets))), BUCKET)
    done = dealt.groupBy(BUCKET).transformWithState(Pushes(known, stored, fields, stream.schema[order]), _lists(out), "Append", "None")
    return done.select(_unpacked(out.names))


class Feed(StatefulProcessor):
    """Lets each numbered change of an owner through once, forgets deletions when their time is over, and knows the horizon that this leaves."""

    def __init__(self, out: StructType, sequence: str):
        self.out, self.sequence = out, sequence

    def init(self, handle) -> None:
        self.handle = handle
        #: All numbers up to `seq` have been here; those beyond it that have are in `ahead`, deletions that aren't over in `log`.
        self.last = handle.getValueState("last", "seq long, horizon long")
        self.open = handle.getValueState("open", "ahead array<bigint>, until array<bigint>, log array<bigint>")

    def _now(self) -> tuple[int, int]:
        return tuple(self.last.get() or (0, 0))

    def _held(self) -> tuple[set[int], list[tuple[int, int]]]:
        ahead, until, log = self.open.get() or ([], [], [])
        return set(ahead), list(zip(until, log, strict=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seq, horizon = self._now()
        ahead, log = self._held()
        before = (set(ahead), len(log))
        first = min(log, default=(None,))[0]
        for r in sorted(rows, key=lambda r: r[self.sequence]):
            n = r[self.sequence]
            if n <= seq or n in ahead:
                continue
            ahead.add(n)
            while seq + 1 in ahead:
                seq += 1
                ahead.remove(seq)
            if r["deleted"]:
                log.append((r["_until"], n))
            yield Row(**{c: r[c] for c in self.out.names})
        self.last.update((seq, horizon))
        if (ahead, len(log)) != before:
            self._keep(ahead, log)
        if log and min(log)[0] != first:
            # One that is over already is forgotten by the next batch that brings the watermark on.
            self.handle.registerTimer(max(min(log)[0], timerValues.getCurrentWatermarkInMs() + 1))

    def _keep(self, ahead: set[int], log: list[tuple[int, int]]) -> None:
        self.open.update((sorted(ahead), [t for t, _ in log], [n for _, n in log]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        seq, horizon = self._now()
        ahead, log = self._held()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        left = [x for x in log if x[0] > passed]
        self.last.update((seq, max([horizon, *(n for t, n in log if t <= passed)])))
        self._keep(ahead, left)
        if left:
            self.handle.registerTimer(min(left)[0])
        yield from ()

    def close(self) -> None:
        pass


def change_feed(stream: DataFrame, owner: str, sequence: str, time: str, *, keep: timedelta, late: str = "1 hour") -> DataFrame:
    """The changes of each owner once, with the state `last`: seq, and horizon, the greatest number of a deletion that is forgotten.

    stream: owner, sequence (1, 2, ... for each owner, in any order of arrival), time, deleted (whether the change is a
    deletion), and more. A device whose cursor is behind the horizon must start over.
    """
    marked = stream.withWatermark(time, late)
    out = _schema(marked, marked.columns)
    ending = marked.withColumn("_until", F.unix_millis(time) + int(keep.total_seconds() * 1000))
    return ending.groupBy(owner).transformWithState(Feed(out, sequence), out, "Append", "EventTime")
