"""The quality classifier: held-out accuracy, training, leakage, cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lakewright.llm import quality_model as op

BIG, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    out = [(r["score"], r["quality"]) for r in op.op9_quality_classifier(spark, BIG).where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(bad) > 5 and auc > 0.9
    assert sum(g >= op.KEEP_AT for g in good) / len(good) > 0.95


def test_training_separates(spark):
    draw = np.random.default_rng(0)
    rows = [(int(k % 2), np.array([k % 2, 2 + int(draw.integers(50))], np.int32), np.array([1.0, 1.0], np.float32)) for k in range(400)]
    w, b = op.train(rows)
    p = lambda *at: 1 / (1 + math.exp(-(b + float(w[list(at)].sum()))))
    assert p(1) > 0.8 > 0.2 > p(0)
    assert op.train([])[1] == 0.0


def test_learns_only_from_the_other_folds(spark, docs_of):
    draw = random.Random(0)
    docs = docs_of(*[" ".join(draw.choice(("good fine well" if k % 2 else "spam junk buy").split()) for _ in range(30)) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    lied = labels.withColumn("quality", F.when(op.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = op.fit(docs, labels), op.fit(docs, lied)
    assert (one[0] == two[0]).all() and one[1] == two[1]
    scored = {r["doc_id"]: r for r in op.quality_scores(docs, labels).collect()}
    assert all((scored[k]["score"] > 0.5) == (k % 2 == 1) and scored[k]["predicted"] == (scored[k]["score"] >= 0.7) for k in range(80))
    shuffled = op.quality_scores(docs.withColumn("lang", F.lit("other")).withColumn("source", F.lit("y")), labels)
    assert {r["doc_id"]: r["score"] for r in shuffled.collect()} == {k: r["score"] for k, r in scored.items()}


def test_cases(spark, docs_of):
    docs = docs_of(None, "", "... !!!", "fine words", "fine words", "é" * 50_000)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = op.quality_scores(docs, none).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == [0.5] * 6 and {r["predicted"] for r in got} == {0}
    assert op.quality_scores(docs.limit(0), none).count() == 0
    kept = op.accepted(docs, none, keep_at=0.5)
    assert kept.columns == docs.columns and kept.count() == 6 and op.accepted(docs, none).count() == 0


def test_against_plain_scores(spark):
    """Every text of the small table: tokens and pairs looked up one by one."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = op.fit(docs, labels)
    hashes = op.WordHashes()

    def plain(text):
        tokens, at = op.TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), []
        for k, t in enumerate(tokens):
            at.append(hashes[t] >> (64 - op.BITS))
            if k:
                pair = int(op.SAME) if hashes[tokens[k - 1]] == hashes[t] else int(op.mix(np.array([hashes[tokens[k - 1]] * 0x9E3779B97F4A7C15 % 2**64], np.uint64) + np.uint64(hashes[t]))[0])
                at.append(pair >> (64 - op.BITS))
        odds = bias + sum(float(weights[a]) for a in at) * op.SCALE / max(1, len(at))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    got = {r["doc_id"]: r for r in op.op9_quality_classifier(spark, SMALL).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = plain(r["text"])
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-4 and (abs(want - 0.7) < 1e-3 or got[r["doc_id"]]["predicted"] == (want >= 0.7))


def test_a_repeated_label_row_does_not_crowd_out_the_others(spark, docs_of):
    docs = docs_of(*((k, f"good text number {k}" if k % 2 else f"junk !!! {k} $$$") for k in range(600)))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    again = labels.unionAll(spark.range(1_000_000).select(F.lit(17).cast("long").alias("doc_id"), F.lit(1).alias("quality")))
    one, many = op.fit(docs, labels, max_train=200), op.fit(docs, again, max_train=200)
    assert (one[0] == many[0]).all() and one[1] == many[1] and (one[0] != 0).sum() > 5
