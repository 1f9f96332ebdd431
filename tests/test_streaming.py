"""Streams that come in several files and stop and go on."""

from helpers import rows
from lakewright.streaming import feeds


def test_latest_wins_over_restarts(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "job")
    write = lambda data: spark.createDataFrame(data, "k long, ts string, id long, v string").selectExpr("k", "cast(ts as timestamp) ts", "id", "v").write.mode("append").parquet(source)
    write([(1, "2024-01-02", 1, "a"), (2, "2024-01-01", 2, "b")])
    schema = spark.read.parquet(source).schema
    newest = lambda: rows(feeds.latest_wins(spark, feeds.read_files(spark, source, schema), root, ["k"], "ts", "id").select("k", "v"))
    assert newest() == [(1, "a"), (2, "b")]
    write([(1, "2024-01-01", 3, "late"), (2, "2024-01-03", 4, "new"), (3, "2024-01-01", 5, "c")])
    assert newest() == [(1, "a"), (2, "new"), (3, "c")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.sql("SELECT 1L AS k, TIMESTAMP'2024-01-01' AS ts, 1L AS id, 'a' AS v")
    table = feeds.LatestTable(spark, str(tmp_path / "t"), batch.schema, ["k"], "ts", "id")
    table.merge(batch, 0)
    table.merge(batch, 0)
    assert rows(table.current().select("k", "v")) == [(1, "a")]


def test_batches_are_compacted(spark, tmp_path):
    import os

    batch = lambda n: spark.sql(f"SELECT {n % 3}L AS k, TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, {n if n != 5 else 0}) AS ts, {n}L AS id, 'v{n}' AS v")
    table = feeds.LatestTable(spark, str(tmp_path / "t"), batch(0).schema, ["k"], "ts", "id")
    table.COMPACT = 3
    for n in range(8):
        table.merge(batch(n), n)
    table.merge(batch(1), 1)
    assert rows(table.current().select("k", "v")) == [(0, "v6"), (1, "v7"), (2, "v2")]
    assert sorted(os.listdir(tmp_path / "t")) == ["b2", "b5", "d1", "d3", "d4", "d5", "d6", "d7"]


def test_once_per_day(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01 01:00:00'), (1L, TIMESTAMP'2024-01-01 05:00:00'), (1L, TIMESTAMP'2024-01-02 01:00:00') t(k, ts)").write.parquet(source)
    stream = feeds.read_files(spark, source, spark.read.parquet(source).schema)
    feeds.append(feeds.once_per_day(stream, ["k"], "ts").select("k", "day"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert [str(r["day"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("day").collect()] == ["2024-01-01", "2024-01-02"]
