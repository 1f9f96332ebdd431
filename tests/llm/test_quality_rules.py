"""Base counts against a plain count; estimation on votes with known accuracies."""

import random
import re

import pytest
from oracle import difference, views
from pyspark.sql import functions as F

from lakewright.llm import quality_rules as op


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for k in range(len(ws) - 2):
        windows.setdefault(tuple(ws[k : k + 3]), []).append(k)
    repeat = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)


def test_base_counts(docs_of):
    draw = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b c a b c", "x x x x", "\n\n a \n\n a \na\n", "é é b 😀# $$<|>"]
    texts += ["".join(draw.choice(("a", "b", "é", "😀", " ", " ", "\n", "#", "$", "a b c ", "\r", "\x1c")) for _ in range(draw.randrange(400))) for _ in range(60)]
    got = op.quality_rules(docs_of(*texts)).orderBy("doc_id").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(r[f] for f in fields) for r in got] == [brute(t) for t in texts]
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_documents(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op.op7_quality_rules(spark, sf_dir).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])


def test_no_python_in_the_plan(docs_of):
    plan = op.quality_rules(docs_of("a b"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and not re.search("Python|Pandas|Arrow", op.measured(docs_of("a"))._jdf.queryExecution().executedPlan().toString())


def test_estimation_recovers_classes():
    """Of planted classes with rules of known rates, the posterior tells nearly all apart."""
    draw = random.Random(1)
    rates = {True: [0.02, 0.05, 0.1, 0.01], False: [0.7, 0.6, 0.3, 0.5]}
    items = [(good := draw.random() < 0.8, [op.BAD if draw.random() < rates[good][k] else op.GOOD for k in range(4)]) for _ in range(4000)]
    counts = {}
    for _, v in items:
        counts[tuple(v)] = counts.get(tuple(v), 0) + 1
    prior, weights = op.estimate([(list(v), n) for v, n in counts.items()], 4)
    right = sum((prior + sum(w[x] for w, x in zip(weights, v, strict=True)) > 0) == good for good, v in items)
    assert right / len(items) > 0.92  # the best possible is 0.944
    assert weights[0][op.BAD] < weights[2][op.BAD] < 0


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(docs_of, n):
    assert op.quality_rules(docs_of("one two").limit(n)).count() == n


def test_keeps_prose_and_drops_junk(docs_of):
    draw = random.Random(3)
    prose = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvw") for _ in range(draw.randint(2, 9))) + ("." if k % 12 == 11 else "") for k in range(150)) for _ in range(60)]
    junk = [" ".join(draw.choice(("###", "$$$", "<|>", "&&", "W1N", "!!!", "%%")) + str(draw.randrange(10**6)) for _ in range(150)) for _ in range(10)]
    out = op.quality_rules(docs_of(*prose, *junk, *prose[:5])).orderBy("doc_id").select("doc_id", "kept").collect()
    kept = [r["kept"] for r in out]
    assert all(kept[:60]) and not any(kept[60:70]) and all(kept[70:])


def test_other_columns_are_not_read(docs_of):
    clash = docs_of("a b c", extra=False).withColumn("n_words", F.lit("mine")).withColumn("votes", F.lit("mine"))
    assert op.quality_rules(clash).first()["n_words"] == 3


def test_sql(spark, sf_dir):
    assert difference(spark, views(sf_dir), op.base_quality_counts, op.BASE_SQL, sf_dir) == ""
