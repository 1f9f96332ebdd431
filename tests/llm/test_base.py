"""Words, hashes, shingles, components."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import base
from lakewright.llm.components import components


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_word_hashes_are_hashes_of_words(texts):
    by_word, by_hash = {}, {}
    for t in texts:
        ws, hs = base.words(t), base.word_hashes(t).tolist()
        assert len(ws) == len(hs)
        for w, h in zip(ws, hs, strict=True):
            assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w


def test_words_lower_only_ascii():
    assert base.words("Ab-C ÀÉ x_1") == ["ab", "c", "ÀÉ", "x", "1"] and base.words(None) == [] == base.words("")


def test_blocks_do_not_change_hashes(monkeypatch):
    text = " ".join(f"w{k}é" for k in range(500)) + " " + "long" * 200
    whole = base.word_hashes(text)
    monkeypatch.setattr(base, "BLOCK", 64)
    assert (base.word_hashes(text) == whole).all()


def test_shingles():
    h = base.word_hashes("a b c d e f a b c d e")
    s = base.shingles(h, 5)
    assert len(s) == 7 and s[0] == s[6] and len(set(s.tolist())) == 6
    assert len(base.shingles(h[:3], 5)) == 1 and len(base.shingles(h[:0], 5)) == 0
    assert base.shingles(h[:3], 5)[0] != base.shingles(h[:2], 5)[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {x: top(x) for x in {v for ab in links if None not in ab for v in ab} if top(x) != x}
    got = components(spark.createDataFrame(links, "u long, v long"), base.Scratch(spark, "test"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long"), base.Scratch(spark, "test")).count() == 0


def test_long_powers():
    p = base.powers(3, 10).tolist()
    assert p == [3**k for k in range(10)] and (base.powers(base.BASE, 100) * base.powers(base.INVERSE, 100) == np.uint64(1)).all()


def test_small_batches_end(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError, match="x"), base.small_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise ValueError("x")
    assert spark.conf.get(name) == before


def test_a_cluster_must_name_the_shared_folder():
    conf = SimpleNamespace(get=lambda name, default: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        base.shared_dir(session)


def test_only_what_is_named_stays(spark):
    scratch = base.Scratch(spark, "test")
    a, b = scratch.save(spark.range(3), "a"), scratch.save(spark.range(4), "b")
    scratch.only("b")
    assert b.count() == 4 and len(scratch.paths) == 1
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FAILED_READ_FILE"):
        a.collect()
