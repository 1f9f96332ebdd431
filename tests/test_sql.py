"""Key functions from SQL, JSON of unknown shape, collations."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.functions import sql, text, variants

CODES = ["OP-007b", "op7B", "EN-001", "a00", "0", "", None, "SV01-0120/200", "xx12", "É-01", "000"]


def test_keys_are_those_of_the_columns_and_inlined(spark):
    sql.register(spark)
    spark.createDataFrame([(x,) for x in CODES], "x string").createOrReplaceTempView("codes")
    got = spark.sql("SELECT x, code_key(x) AS a, number_key(x) AS b, numeric_part(x) AS c FROM codes")
    want = spark.table("codes").select("x", text.code_key(F.col("x")), text.number_key(F.col("x")), text.numeric_part(F.col("x")))
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp_replace" in plan


def test_templates(spark):
    sql.register(spark)
    got = spark.sql("SELECT * FROM template_calls('{{Card|a=1|two}}{{card|b={{x|y}}}}', 'card')").collect()
    assert [(r["call"], r["named"], r["lines"]) for r in got] == [(0, {"a": "1"}, ["two"]), (1, {"b": "{{x|y}}"}, [])]
    assert spark.sql("SELECT * FROM template_calls(NULL, 'card')").count() == 0 == spark.sql("SELECT * FROM template_calls('{{card|x}}', NULL)").count()


BODIES = ['{"a": {"b": [1, {"c": null}]}, "d": "x"}', '{"a": null}', "[1]", "3", "null", "no json", None, '{"d": 2.5, "e": {}}']


def test_variants_of_any_shape(spark):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(BODIES)], "k int, body string").withColumn("v", variants.parsed(F.col("body")))
    v = F.col("v")
    got = df.orderBy("k").select(variants.has(v, "$.a").alias("a"), variants.has(v, "$.a.b[1].c").alias("c"), variants.at(v, "$.a.b[0]", "int").alias("n"), variants.at(v, "$.d", "double").alias("d")).collect()
    assert [r["a"] for r in got] == [True, True, False, False, False, False, False, False] and [r["c"] for r in got] == [True] + [False] * 7
    assert [r["n"] for r in got] == [1] + [None] * 7 and [r["d"] for r in got] == [None] * 7 + [2.5]
    more = variants.parsed(F.lit('{"d": 1, "z": {"y": true}}'))
    merged = df.orderBy("k").select(F.to_json(variants.merged(v, more)).alias("j"), F.to_json(variants.without(v, ["a", "e"])).alias("w")).collect()
    assert merged[0]["j"] == '{"a":{"b":[1,{"c":null}]},"d":1,"z":{"y":true}}' and merged[7]["j"] == '{"d":1,"e":{},"z":{"y":true}}'
    assert [r["j"] for r in merged[2:7]] == ['{"d":1,"z":{"y":true}}'] * 5
    assert [merged[k]["w"] for k in (0, 1, 2, 7)] == ['{"d":"x"}', "{}", "{}", '{"d":2.5}']


@pytest.mark.parametrize(("how", "groups"), [({}, 1), ({"case": True}, 3), ({"accents": True}, 2), ({"case": True, "accents": True}, 4)])
def test_collations(spark, how, groups):
    df = spark.createDataFrame([("Éclair",), ("eclair",), ("Eclair",), ("ÉCLAIR",)], "x string")
    assert df.select(text.collated(F.col("x"), **how).alias("x")).distinct().count() == groups
    names = spark.createDataFrame([("b",), ("Ä",), ("a",), ("Z",), ("é",), ("f",)], "x string")
    assert [r["x"] for r in names.orderBy(text.collated(F.col("x"), "de"), "x").collect()] == ["a", "Ä", "b", "é", "f", "Z"]
    assert [r["x"] for r in names.orderBy("x").collect()] == ["Z", "a", "b", "f", "Ä", "é"]
