"""The n-gram join against all pairs."""

import itertools
import random

import pytest

from lakewright.llm import ngram_join as op
from lakewright.llm.base import words


def grams(text):
    ws = words(text)
    n = min(5, len(ws))
    return frozenset(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)) if ws else frozenset()


def brute(pairs, similarity=0.8):
    """doc_id -> (class, links), for rows with ids."""
    sets = [grams(t) for _, t in pairs]
    ids = [i for i, _ in pairs]
    root, links = list(range(len(ids))), [0] * len(ids)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if sets[a] and sets[b] and ids[a] is not None and ids[b] is not None and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(least.get(top(k), i), i) if i is not None else None
    return sorted((ids[k], least[top(k)], links[k]) for k in range(len(ids)))


def corpus(seed, n=60):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        ws = [f"w{draw.randrange(3000)}" for _ in range(draw.choice((3, 6, 30, 120, 400)))]
        out.append(" ".join(ws))
        for _ in range(draw.choice((0, 0, 1, 3, 8))):
            edited = list(ws)
            for _ in range(draw.randrange(0, max(1, len(ws) // 40) + 1)):
                edited[draw.randrange(len(edited))] = f"x{draw.randrange(99)}"
            out.append(" ".join(edited))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_all_links_and_classes(docs_of, seed):
    pairs = list(enumerate(corpus(seed)))
    got = sorted(tuple(r) for r in op.ngram_join(docs_of(*pairs)).collect())
    assert got == brute(pairs)


def test_large_groups_in_blocks(docs_of, monkeypatch):
    """Copies and near copies by the hundred, compared in small blocks."""
    monkeypatch.setattr(op, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(op, "SET_BLOCK", 8)
    monkeypatch.setattr(op, "STRIP", 700)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)] * 30 + [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(70)]
    got = sorted(tuple(r) for r in op.ngram_join(docs_of(*texts)).collect())
    assert got == brute(list(enumerate(texts)))


def test_cases(docs_of, spark):
    pairs = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, "..."), (None, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "x" * 5000), (9, " ".join(["same"] * 3000)), (10, " ".join(["same"] * 6))]
    got = sorted((tuple(r) for r in op.ngram_join(docs_of(*pairs)).collect()), key=repr)
    want = [(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 0), (None, None, 0), (7, 7, 1), (7, 7, 1), (8, 8, 0), (9, 9, 1), (10, 9, 1)]
    assert got == sorted(want, key=repr)
    assert op.ngram_join(docs_of(*pairs).limit(0)).count() == 0


def test_one_of_each_class(docs_of):
    docs = docs_of((1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words are here too"), (3, "other words are here too"), (None, "a b c d e f g"), (4, None))
    kept = op.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["text"]) == [(-1, "a b c d e f g"), (1, "a b c d e f g"), (3, "other words are here too")]
    assert kept.where("doc_id = 4").count() == 1


def test_several_texts_of_one_id(docs_of):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    near = a.replace("a39", "other")
    kept = op.one_of_each_class(docs_of((1, a), (2, a), (2, b), (3, near), (1, near), (2, "!!"), (2, a)))
    assert sorted(tuple(r)[:2] for r in kept.select("doc_id", "text").collect()) in ([(1, a), (2, "!!"), (2, b)], [(1, near), (2, "!!"), (2, b)])


def test_plan_hashes(spark, sf_dir, monkeypatch):
    """No aggregation sorts its rows."""
    plans, save = [], op.Scratch.save
    monkeypatch.setattr(op.Scratch, "save", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, name))[1])
    op.op1_ngram_join(spark, sf_dir)
    assert len(plans) > 8 and not [p for p in plans if "SortAggregate" in p]


def test_runs_reach_the_recall():
    once = (1 - 0.2**op.PICKS) ** op.DEPTH
    assert 1 - (1 - once) ** op.runs_for(0.8, 0.9999) >= 0.9999


def test_brute_force_on_documents(spark, sf_dir):
    pairs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op.op1_ngram_join(spark, sf_dir).collect()) == brute(pairs)


def test_an_id_with_many_texts_is_read_once_a_text(spark, docs_of, monkeypatch):
    """Near copies under one id: as many rows reach the sets as there are texts, repeats and all."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(60)]
    docs = docs_of(*((7, t) for t in texts), *((7, texts[0]) for _ in range(500))).coalesce(1)
    whole = op.shingle_sets

    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        def told():
            for b in batches:
                yield b

        for out in whole(told()):
            count.add(out.num_rows)
            yield out

    monkeypatch.setattr(op, "shingle_sets", counted)
    rows = op.ngram_join(docs).collect()
    assert len(rows) == 560 and {r["class_id"] for r in rows} == {7} and count.value <= 60 * 4
