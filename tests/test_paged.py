"""Paged answers: pages in any order, one that is missing, restarts."""

import json

import pytest

from helpers import rows
from lakewright.sources import paged


@pytest.fixture
def source(spark):
    spark.dataSource.register(paged.PagedAnswers)
    return spark


def put(path, token, data, after=None, key="next_page"):
    (path / f"{token}.json").write_text(json.dumps({"data": data} | ({key: after} if after is not None else {})))


def load(spark, path, **options):
    reader = spark.read.format("paged").option("path", str(path)).option("first", "a")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_order_of_links(source, tmp_path):
    put(tmp_path, "z", [{"k": 1}, {"k": 2}], 7)
    put(tmp_path, "7", [], {"y": "b", "x": "a"}, "continue")
    put(tmp_path, "a%7Cb", [{"k": 3}])
    put(tmp_path, "a", [{"k": 0}], "z")
    put(tmp_path, "stray", [{"k": 9}])
    assert rows(load(source, tmp_path).select("place", "record")) == [(0, '{"k":0}'), (1, '{"k":1}'), (1, '{"k":2}'), (3, '{"k":3}')]


def test_a_missing_page_is_named(source, tmp_path):
    put(tmp_path, "a", [{"k": 0}], "b")
    with pytest.raises(Exception, match="'b' hasn't landed"):
        load(source, tmp_path).count()
    assert load(source, tmp_path, partial="true").count() == 1
    with pytest.raises(Exception, match="'a' hasn't landed"):
        load(source, tmp_path / "none").count()
    put(tmp_path, "b", [], "a")
    with pytest.raises(Exception, match="'a' comes again"):
        load(source, tmp_path).count()


def test_a_stream_goes_on_where_pages_were_missing(source, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        stream = source.readStream.format("paged").option("path", str(tmp_path / "in")).option("first", "a").option("perBatch", "2").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
        return sorted(r["place"] for r in source.read.schema(paged.SCHEMA).parquet(f"{tmp_path}/out").collect())

    put(tmp_path / "in", "a", [{"k": 0}], "b")
    put(tmp_path / "in", "c", [{"k": 2}], "d")
    assert run() == [0]
    put(tmp_path / "in", "b", [{"k": 1}], "c")
    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    put(tmp_path / "in", "d", [{"k": 3}, {"k": 4}])
    assert run() == [0, 1, 2, 3, 3] and run() == [0, 1, 2, 3, 3]


def test_missing_ids(spark):
    held = spark.createDataFrame([(1, "de"), (1, "de"), (2, "en")], "id int, lang string")
    wanted = spark.createDataFrame([(k, x) for k in (1, 2) for x in ("de", "en")], "id int, lang string")
    assert rows(paged.missing_ids(held, wanted, "id", ["lang"])) == [(1, "en"), (2, "de")]


def test_a_task_reads_a_run_of_pages(source, tmp_path):
    n = 2 * paged.PER_TASK + 5
    for k in range(n):
        put(tmp_path, "a" if k == 0 else f"t{k}", [{"k": k}], f"t{k + 1}" if k + 1 < n else None)
    found = load(source, tmp_path)
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r["place"], r["record"]) for r in found.collect()) == [(k, f'{{"k":{k}}}') for k in range(n)]
