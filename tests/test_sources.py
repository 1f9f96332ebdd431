"""Feeds and derived files on small inputs made here."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.operators import hashtree
from lakewright.sources import feeds, files


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_json_lines_skips_blanks_and_filters_by_language(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id":"1","lang":"en"}\n\n   \n{"id":"2", "lang" : "de"}\n{"id":"3","lang":"fr","x":{"lang":"de"}}')
    assert rows(feeds.json_lines(spark, str(tmp_path), "id string, lang string")) == [("1", "en"), ("2", "de"), ("3", "fr")]
    assert rows(feeds.json_lines(spark, str(tmp_path), "id string", ["de"])) == [("2",)]


def test_chunks_are_bounded(spark, tmp_path):
    lines = spark.range(25).select(F.col("id").cast("string").alias("value"))
    feeds.write_chunks(lines.coalesce(1), str(tmp_path / "out"), 10, F.col("value") != "3")
    parts = [p for p in os.listdir(tmp_path / "out") if p.startswith("part")]
    assert len(parts) == 3 and spark.read.text(str(tmp_path / "out")).count() == 24


def test_envelope(spark):
    good = json.dumps({"success": True, "errors": [], "results": [{"id": 1, "name": "a"}, {"id": 2, "name": None}]})
    df = spark.createDataFrame([(7, good)], "k int, value string")
    assert rows(feeds.envelope(df, "id:int,name:string")) == [(7, 1, "a"), (7, 2, None)]
    bad = spark.createDataFrame([(json.dumps({"success": False, "errors": ["no"], "results": []}),)], "value string")
    with pytest.raises(Exception, match="no success: no"):
        feeds.envelope(bad, "id:int").collect()


def test_archive_takes_keys_from_paths(spark, tmp_path):
    for day, group, price in (("2024-01-01", 5, 1.5), ("2024-01-02", 5, 2.5), ("2024-01-02", 6, 3.0)):
        put(f"{tmp_path}/{day}/3/{group}/prices", json.dumps({"success": True, "errors": [], "results": [{"productId": group, "marketPrice": price}]}))
    got = feeds.archive(spark, str(tmp_path), "productId:int,marketPrice:double").select(F.col("day").cast("string"), "category", "group", "marketPrice")
    assert rows(got) == [("2024-01-01", "3", 5, 1.5), ("2024-01-02", "3", 5, 2.5), ("2024-01-02", "3", 6, 3.0)]


def test_data_array(spark, tmp_path):
    put(f"{tmp_path}/a.json", '{"meta": 1,\n "data": [{"id": 1, "desc": "a } ] \\" b"},\n {"id": 2, "desc": "c"}]}')
    assert rows(feeds.data_array(spark, f"{tmp_path}/a.json", "id:int,desc:string")) == [(1, 'a } ] " b'), (2, "c")]
    put(f"{tmp_path}/b.json", '{"data": []}')
    with pytest.raises(Exception, match="empty"):
        feeds.data_array(spark, f"{tmp_path}/b.json", "id:int").collect()


def test_backfill_days(spark):
    daily = spark.sql("SELECT TIMESTAMP'2024-01-02 00:00:00' AS observed_at")
    spine = feeds.days(spark, "2024-01-01", "2024-01-03")
    assert [str(r[0]) for r in feeds.missing_days(spine, daily).orderBy("day").collect()] == ["2024-01-01", "2024-01-03"]
    assert feeds.has_day(daily, "2024-01-02") and not feeds.has_day(daily, "2024-01-03")


def test_effective_dates(spark):
    dates = spark.sql("SELECT 'x' AS format, explode(array(DATE'2024-01-01', DATE'2024-02-01', DATE'2024-09-01')) AS date")
    assert str(feeds.effective_dates(dates, "2024-03-01").first()["date"]) == "2024-02-01"


PAGE = """Intro {{Unrelated|x=1}}
{{ set gallery | region = de | rarity=Common|
AB1-DE001; First card (alias); ; AA
AB1-DE002; {{nested|a|b}} [[Link|with bar]]; Rare // file::Own.jpg; x::y
AB1-DE003; Third; Weird
; no code; Rare
AB1-DE004; Last; Rare // extension::jpg
}} {{Set gallery|abbr=1|
AB1-XX; skipped; Rare
}}"""


def test_template_calls():
    one, two = feeds.template_calls(PAGE, "Set gallery")
    assert dict(one["named"]) == {"region": "de", "rarity": "Common"}
    assert sum(bool(x.strip()) for x in one["lines"]) == 5 and dict(two["named"]) == {"abbr": "1"}
    assert feeds.template_calls(None, "x") == [] and feeds.template_calls("{{x|a", "x") == [{"named": [], "lines": ["a"]}]


def test_gallery_rows(spark):
    pages = spark.createDataFrame([("Set Card Galleries:Alpha Beta (TCG-EN-1E)", PAGE), ("Set Card Galleries:Other (OCG-JP)", PAGE)], "title string, text string")
    titled = feeds.gallery_titles(pages)
    known = {"Common": "C", "Rare": "R"}
    abbreviation = lambda x: F.try_element_at(F.create_map(*(F.lit(v) for kv in known.items() for v in kv)), x)
    got = feeds.gallery_rows(titled, abbreviation).orderBy("line").select("set", "lang", "code", "rarity", "alt", "file")
    assert [tuple(r) for r in got.collect()] == [
        ("Alpha Beta", "en", "AB1-DE001", "C", "AA", "Firstcard-AB1-DE-C-1E-AA.png"),
        ("Alpha Beta", "en", "AB1-DE002", "R", "", "Own.jpg"),
        ("Alpha Beta", "en", "AB1-DE004", "R", "", "Last-AB1-DE-R-1E.jpg"),
    ]


def test_set_list_codes(spark):
    text = "{{Set list|region=DE|\nAB1-DE001; Name; Rare\nAB1-DE002 // note\nnot a code; x\n}}"
    pages = spark.createDataFrame([("t", text)], "title string, text string")
    assert [r["code"] for r in feeds.set_list_codes(pages).orderBy("line").collect()] == ["AB1-DE001", "AB1-DE002"]


def test_wiki_answers(spark):
    prints = {"Password": ["00123"], "English name": ["A"], "German name": ["Der <b>A</b>"], "German lore": ["''Es war''"], "German Pendulum Effect": ["Zieh"], "French name": [" "]}
    body = json.dumps({"query": {"results": {"A page": {"printouts": prints}}}})
    got = feeds.wiki_answers(spark.createDataFrame([(body,)], "value string"))
    assert rows(got) == [("A page", ["123"], "A", "de", "Der A", "[ Pendulum Effect ]\nZieh\n\n[ Flavor Text ]\nEs war")]


def test_csv_file(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b "q"'), (1, "a,\r\nb"), (3, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "c"), [F.col("k").asc()])
    text = b"".join(open(p.removeprefix("file:"), "rb").read() for p in files.csv_files(spark, str(tmp_path / "c")))
    assert text.decode() == 'k,v\r\n1,"a,\r\nb"\r\n2,"b ""q"""\r\n3,\r\n'


def test_deck_text(spark):
    df = spark.createDataFrame([(1, 2, "b", 2), (1, 3, "a", 1)], "deck int, quantity int, name string, pos int")
    assert files.deck_text(df, ["deck"], "pos").first()["text"] == "3 a\n2 b"


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "p")
    files.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, g string"), path, ["g"])
    files.overwrite_partitions(spark.createDataFrame([(9, "a")], "v int, g string"), path, ["g"])
    assert rows(spark.read.parquet(path).select("v", "g")) == [(2, "b"), (9, "a")]


def test_snapshots_and_deltas(spark, tmp_path):
    store = files.Snapshots(spark, str(tmp_path / "s"), {"t": ["k"]})
    version = lambda *r: {"t": spark.createDataFrame(list(r), "k int, v string")}
    assert store.publish(1, version((1, "a"), (2, "b")))
    assert not store.publish(1, version((1, "z")))
    assert store.publish(2, version((1, "a"), (2, "c"), (3, "d")))
    assert store.publish(3, version((2, "c"), (3, "d"), (4, None)))
    assert store.names() == ["manifest", "v1-v2", "v2", "v2-v3", "v3"]
    first = version((1, "a"), (2, "b"))["t"]
    assert rows(store.caught_up("t", first, 1)) == rows(store.read("v3", "t")) == [(2, "c"), (3, "d"), (4, None)]
    assert rows(store.read("v2-v3", "t").select("op", "k", "v")) == [("delete", 1, None), ("upsert", 4, None)]


def test_a_delta_reads_where_versions_differ(spark, tmp_path):
    """Tables with maps; files of leaves that are alike may be missing when the delta is made."""
    import shutil

    store = files.Snapshots(spark, str(tmp_path / "s"), {"t": ["k"]})
    df = spark.range(3000).select(F.col("id").alias("k"), F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("b"), F.lit("x")).alias("m"))
    changed = df.where("k != 5").withColumn("m", F.when(F.col("k") == 77, F.create_map(F.lit("b"), F.lit("y"))).otherwise(F.map_from_entries(F.reverse(F.map_entries("m")))))
    store.publish(1, {"t": df})
    store._write(2, "t", changed, 1)
    touched = {r[0] for r in spark.createDataFrame([(5,), (77,)], "k long").select(hashtree.leaf(["k"], 1)).collect()}
    for v in (1, 2):
        for folder in (tmp_path / "s" / f"v{v}" / "t").glob("_leaf=*"):
            if int(folder.name[6:]) not in touched:
                shutil.rmtree(folder)
    assert rows(store._delta(1, 2, "t").select("op", "k", "m")) == [("delete", 5, None), ("upsert", 77, {"b": "y"})]


def test_manifest_chain_is_bounded():
    m = files.Manifest(0, 1)
    for v in range(1, 41):
        m = files.next_manifest(m, v, 1, v - 1)
    assert len(m.deltas) == files.MAX_DELTAS and m.deltas[-1] == (39, 40)
    assert files.planned(m, 40, 1) == (True, None) and files.planned(m, 41, 2) == (False, None)
