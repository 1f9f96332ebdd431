"""Suffix automata against windows cut one by one."""

import hashlib
import random
import time

import pytest
from oracle import difference, views

from lakewright.llm import decontaminate as op
from lakewright.llm.base import words


def brute(text, items):
    ws = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            w = own[k : k + n]
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == w:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize(("seed", "max_words"), [(1, 10**6), (2, 40)])
def test_against_windows(spark, docs_of, seed, max_words):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefg")
    items = [(k, " ".join(word() for _ in range(draw.choice((0, 1, 2, 5, 12, 13, 14, 30))))) for k in range(25)] + [(99, None)]
    items = [x for x in items if not x[1] or len(x[1].split()) != 1 or draw.random() < 0.2]
    texts = []
    for _ in range(40):
        t = [word() for _ in range(draw.randrange(0, 60))]
        if draw.random() < 0.7:
            t[5:5] = (draw.choice(items)[1] or "").upper().split()
        texts.append(", ".join(t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.match_benchmark(docs_of(*texts), bench, max_words=max_words).orderBy("doc_id").collect()
    assert [tuple(r["hits"][f] for f in FIELDS) for r in got] == [brute(t, items) for t in texts]


def test_cases(spark, docs_of):
    bench = spark.createDataFrame([(1, "Short item"), (2, "..."), (10, "short item")], "item_id long, text string")
    docs = docs_of(None, "", "a short, ITEM here", "a short, ITEM here", "short " * 9, " ".join(["x"] * 41) + " short item")
    got = op.match_benchmark(docs, bench).orderBy("doc_id").collect()
    assert [(r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"], r["hits"]["contaminated"]) for r in got] == [(0, 0, [], False), (0, 0, [], False), (4, 2, ["1", "10"], True), (4, 2, ["1", "10"], True), (9, 0, [], False), (43, 2, ["1", "10"], False)]
    assert op.match_benchmark(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert op.match_benchmark(docs.limit(0), bench).count() == 0
    kept = op.uncontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 5]


def test_spans_are_removed():
    text = "One two. THREE four! five"
    assert op.without_spans(text, [[1, 3]], longest=2) == "One  four! five"
    assert op.without_spans(text, [[1, 3]], longest=3) == text and op.without_spans(None, []) is None


def test_long_spans_of_kept_texts_are_cut(spark, docs_of):
    item = " ".join(f"i{k}" for k in range(40))
    rest = " ".join(f"w{k}" for k in range(1000))
    bench = spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string")
    docs = docs_of(f"{rest} {item.upper()}. End", f"{rest} short item", None, item)
    out = op.uncontaminated(docs, bench)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {0: (f"{rest} . End", len(rest) + 6), 1: (f"{rest} short item", len(rest) + 11), 2: (None, None)} and out.columns == docs.columns
    assert op.uncontaminated(docs.drop("n_chars"), bench).columns == docs.drop("n_chars").columns


def test_no_window_survives(spark, docs_of):
    """Neither one that a cut puts together, nor one that a cut for another automaton leaves."""
    a, b, c = ([f"{x}{k}" for k in range(20)] for x in "abc")
    rest = [f"w{k}" for k in range(2000)]
    texts = [" ".join(rest[:1000] + x + rest[1000:]) for x in (a, a[:9] + b + a[9:], b + c, a[:12], a[3:16])]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((a, b, c))], "item_id long, text string")
    windows = {tuple(x[k : k + 13]) for x in (a, b, c) for k in range(8)}
    for max_words in (10**6, 20):
        out = {r["doc_id"]: words(r["text"]) for r in op.uncontaminated(docs_of(*texts), bench, max_words=max_words).collect()}
        assert len(out) == 5 and out[3] == words(texts[3]) and not [w for ws in out.values() for k in range(len(ws)) if (w := tuple(ws[k : k + 13])) in windows]


@pytest.mark.parametrize("max_words", [10**6, 20])
def test_a_task_takes_one_python_worker(spark, docs_of, max_words):
    """Each Python node of a stage has a worker of its own, which stays, with its automaton and caches."""
    bench = spark.createDataFrame([(k, " ".join(f"{x}{j}" for j in range(20))) for k, x in enumerate("ab")], "item_id long, text string")
    docs = docs_of("some text", None)
    for out in (op.uncontaminated(docs, bench, max_words=max_words), op.match_benchmark(docs, bench, max_words=max_words)):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_long_repetitive_items_and_texts_take_linear_time():
    began = time.time()
    automaton = op.SuffixAutomaton([(k, ["a"] * 100_000) for k in range(2)] + [(9, ["a"] * 5)])
    assert automaton.scan(["a"] * 100_000 + ["b"]) == ([(0, 100_000)], {0, 1, 9})
    assert time.time() - began < 8


def test_sql(spark, sf_dir):
    assert difference(spark, views(sf_dir), op.op2_decontamination, op.OP2_SQL, sf_dir) == ""


def test_a_clashing_column_gives_way(spark, docs_of):
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    docs = docs_of("zero one two three", None).withColumnRenamed("score", "hits")
    for words in (1000, 2):
        got = op.match_benchmark(docs, items, max_words=words)
        assert [r["hits"]["n_hit"] for r in got.orderBy("doc_id").collect()] == [3, 0] and got.columns.count("hits") == 1
