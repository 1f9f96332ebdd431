"""Keyed streams over restarts, with rows that come late, again and out of order."""

import datetime
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.operators import feed
from lakewright.streaming import state

T0 = datetime.datetime(2024, 1, 1)


def fed(spark, tmp_path, batches, schema, job):
    """Runs a job once for each batch of rows, a restart every time; what it gave, and its checkpoint."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        state.run(job(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint"


def test_newest(spark, tmp_path):
    draw = random.Random(1)
    data = [(k % 7, T0 + timedelta(minutes=draw.randrange(500)), k, f"v{k}") for k in range(120)]
    draw.shuffle(data)
    batches = [data[:50], data[50:90] + data[:20], data[90:]]
    out, checkpoint = fed(spark, tmp_path, batches, "user int, ts timestamp, id long, v string", lambda s: state.newest(s, ["user"], "ts", "id"))
    want = feed.latest(spark.createDataFrame(data, "user int, ts timestamp, id long, v string"), ["user"], "ts", "id")
    assert rows(state.held(spark, checkpoint, "newest", ["ts"])) == rows(want)
    # Each row that took the place came out, none twice.
    assert out.count() == out.distinct().count() and rows(feed.latest(out, ["user"], "ts", "id")) == rows(want)


def test_once_per_day(spark, tmp_path):
    at = lambda d, h: T0 + timedelta(days=d, hours=h)
    batches = [[(1, at(0, 3)), (1, at(0, 9)), (2, at(0, 1))], [(1, at(0, 5)), (1, at(1, 2)), (2, at(0, 2)), (2, at(1, 1))], [(1, at(9, 1))], [(1, at(0, 7)), (2, at(9, 2)), (2, at(9, 3)), (1, at(9, 1))]]
    out, checkpoint = fed(spark, tmp_path, batches, "user int, ts timestamp", lambda s: state.once_per_day(s, ["user"], "ts", "2 hours"))
    days = [(r["user"], (r["day"] - T0.date()).days) for r in out.collect()]
    assert sorted(days) == [(1, 0), (1, 1), (1, 9), (2, 0), (2, 1), (2, 9)]


def test_pushes_as_the_batch_rules(spark, tmp_path):
    """Against `feed.resolve`, one push after the other."""
    draw, schema = random.Random(3), "id int, nth long, v string, updated_at timestamp, deleted_at timestamp, base_updated_at timestamp"
    at = lambda: T0 + timedelta(minutes=draw.randrange(40))
    data = [(k, n, draw.choice("ab"), t := at(), t if draw.random() < 0.3 else None, at() if draw.random() < 0.5 else None) for n in range(1, 7) for k in range(12)]
    batches = [data[:24], data[24:40] + data[10:20], data[40:]]
    out, checkpoint = fed(spark, tmp_path, batches, schema, lambda s: state.pushes(s, ["id"], ["v"], "nth"))
    now, want = {}, []
    for n in range(1, 7):
        pushed = [r for r in data if r[1] == n]
        stored = spark.createDataFrame([(k, *v) for k, v in now.items()], "id int, v string, updated_at timestamp, deleted_at timestamp")
        same = F.col("s.v").eqNullSafe(F.col("p.v")) & F.col("s.deleted_at").isNull() & F.col("p.deleted_at").isNull()
        for r in feed.resolve(stored, spark.createDataFrame(pushed, schema), "id", same).collect():
            row = next(x for x in pushed if x[0] == r["id"])
            want.append((r["id"], n, r["action"]))
            if r["action"] in ("insert", "apply"):
                now[r["id"]] = (row[2], r["updated_at"], r["updated_at"] if row[4] else None)
    assert rows(out) == sorted(want, key=repr)
    held = {r["id"]: (r["v"], r["updated_at"], r["deleted_at"]) for r in state.held(spark, checkpoint, "stored", ["updated_at", "deleted_at"]).collect()}
    assert held == now


def test_feed_and_horizon(spark, tmp_path):
    at = lambda d: T0 + timedelta(days=d)
    batches = [
        [("u", 1, at(0), True), ("u", 3, at(1), False), ("w", 1, at(1), False)],
        [("u", 2, at(1), True), ("u", 3, at(1), False), ("u", 1, at(0), True)],
        [("w", 2, at(5), True)], [("w", 2, at(5), True), ("u", 4, at(5), False)], [("w", 3, at(6), False)],
    ]
    out, checkpoint = fed(spark, tmp_path, batches, "owner string, seq long, ts timestamp, deleted boolean", lambda s: state.change_feed(s, "owner", "seq", "ts", keep=timedelta(days=3)))
    assert rows(out.select("owner", "seq")) == [("u", 1), ("u", 2), ("u", 3), ("u", 4), ("w", 1), ("w", 2), ("w", 3)]
    assert rows(state.held(spark, checkpoint, "last")) == [("u", 4, 2), ("w", 3, 0)]


def test_other_streams_keep_their_store(spark):
    before = spark.conf.get(state.PROVIDER, None)
    with pytest.raises(ValueError, match="x"), state.state_store(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
        raise ValueError("x")
    assert spark.conf.get(state.PROVIDER, None) == before


def test_state_is_read_and_written_once_a_batch():
    """Calls of the state don't grow with a key's rows."""
    from types import SimpleNamespace

    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    calls = []

    class Held:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                self.value = args[0] if name == "update" else self.value
                return self.value if name == "get" else False

            return call

    handle = SimpleNamespace(getValueState=lambda *_: Held(), getMapState=lambda *_: Held(), registerTimer=lambda _: calls.append("timer"))
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    out = StructType().add("seq", "long")
    data = [Row(seq=n, deleted=True, _until=n) for n in range(1, 200)]
    for job in (state.OncePerDay(out), state.Feed(out, "seq")):
        calls.clear()
        job.init(handle)
        assert len(list(job.handleInputRows(("u",), iter(data), times))) == 199 and len(calls) <= 6


def test_keys_of_a_bucket_are_one_value(spark, tmp_path):
    """The state holds a value a bucket, not one a key; values of any type come back as they were."""
    from decimal import Decimal

    schema = "id long, part string, nth long, n long, price decimal(20,3), day date, v string, updated_at timestamp, deleted_at timestamp, base_updated_at timestamp"
    value = lambda k: (None if k % 3 == 0 else 2**60 + k, None if k % 4 == 0 else Decimal(f"{k}.125"), T0.date(), None if k % 5 == 0 else f"v{k}")
    key = lambda k: (None if k == 7 else k, "ä" if k % 2 else None)
    rows_of = lambda ks, nth: [(*key(k), nth, *value(k), T0, None, None) for k in ks]
    job = lambda s: state.pushes(s, ["id", "part"], ["n", "price", "day", "v"], "nth", buckets=2)
    out, checkpoint = fed(spark, tmp_path, [rows_of(range(200), 1), rows_of(range(150, 300), 2) + rows_of(range(20), 1)], schema, job)
    actions = {(r["id"], r["part"], r["nth"]): r["action"] for r in out.collect()}
    assert actions == {**{(*key(k), 1): "insert" for k in range(200)}, **{(*key(k), 2): "noop" if k < 200 else "insert" for k in range(150, 300)}} and out.count() == 350
    assert rows(state.held(spark, checkpoint, "stored", ["updated_at", "deleted_at"])) == sorted(((*key(k), *value(k), T0, None) for k in range(300)), key=repr)
    with state.state_store(spark):
        assert all(spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count() <= 2 for name in ("stored", "turn"))


def test_packed_rows_are_whole(spark, monkeypatch):
    monkeypatch.setattr(state, "PACK_ROWS", 50)
    rows_in = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v"))
    lists = state.packed(rows_in, "k")
    assert rows(lists.select("k", state._unpacked(["id", "v"]))) == rows(rows_in)
