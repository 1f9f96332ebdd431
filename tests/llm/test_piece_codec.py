"""Encodings against the public library, round trips, shortest paths."""

import itertools
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import piece_codec as op
from lakewright.llm.transducer import Machine, compose, shortest


@pytest.fixture(scope="module")
def machine():
    return op.machine(op.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.model_path())


TEXTS = ["", " ", "  two  spaces ", "Hello, world!", "É ça—naïve", "日本語 テキスト", "😀 x 😀😀", "a\nb\tc\r\n", "1234567890.50", "    code:\n        indented()", "x" * 300, "▁ mark ▁▁", "ﬁ ligature   nbsp", "\u0000 zero"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(machine, library, text):
    assert machine.encode(text) == library.encode(text)
    assert machine.decode(machine.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  aeiou thn.,\n0")), max_size=60))
def test_any_text_is_like_the_library(text):
    m, lib = op.machine(op.MODEL), sentencepiece.SentencePieceProcessor(model_file=op.model_path())
    assert m.encode(text) == lib.encode(text)
    if "▁" not in text:
        assert m.decode(m.encode(text)) == text


def test_documents_are_like_the_library(spark, sf_dir, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op.op5_sentencepiece(spark, sf_dir).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) and r["round_trip"]


class Toy(op.PieceMachine):
    """A unigram model of a few pieces."""

    def __init__(self, scores):
        self.dummy, self.bpe = False, False
        self.pieces = ["<unk>", *scores]
        self.score = [0.0, *scores.values()]
        self.ids = {p: k + 1 for k, p in enumerate(scores)}
        self.bytes, self.byte_of, self.unknown, self.silent = {}, {}, 0, {0}
        self.longest, self.cache = max(map(len, scores)), op.Paths(self.path)
        self.parts = op.re.compile(self._part_pattern())


def test_unigram_takes_the_shortest_path():
    toy = Toy({"a": -3.0, "b": -3.5, "ab": -4.0, "aba": -9.0, "ba": -4.5, "c": -2.0})
    for text in map("".join, itertools.product("abc", repeat=5)):
        cuts = ["".join(ch + ("|" if k < 4 and bits[k] else "") for k, ch in enumerate(text)).split("|") for bits in itertools.product((0, 1), repeat=4)]
        best = min(sum(-toy.score[toy.ids[x]] for x in cut) for cut in cuts if all(x in toy.ids for x in cut))
        got = toy.encode(text)
        assert abs(sum(-toy.score[k] for k in got) - best) < 1e-9 and "".join(toy.pieces[k] for k in got) == text
    assert toy.encode("d") == [0]


def test_unigram_is_the_composed_machine(machine):
    draw = random.Random(4)
    toy = Toy({"a": -3.0, "b": -3.5, "ab": -4.1, "aba": -9.0, "ba": -4.7, "c": -2.2, "▁": -1.0, "▁a": -2.9, "▁ab": -3.3})
    composed = toy.transducer()
    for _ in range(300):
        text = "".join(draw.choice("abc x") for _ in range(draw.randrange(12)))
        assert list(shortest(composed, text)) == toy.encode(text), text


def test_bpe_is_the_composed_machine(machine):
    """On words of the model's own pieces, and on characters that fall back to bytes."""
    draw = random.Random(5)
    composed, pieces = machine.transducer(), [p.strip("▁") for p in machine.ids]
    texts = ["Hello, world!", "naïve café 日本", "😀 x", "a\nb\tc", "1234567890.50", "unbelievably internationalisation"]
    texts += [" ".join(w for w in ("".join(draw.choice(pieces) for _ in range(draw.randint(1, 3))) for _ in range(3)) if w) for _ in range(150)]
    for text in texts:
        assert list(shortest(composed, text)) == machine.encode(text), text


def test_composition_and_shortest_paths():
    double = Machine(0, lambda s, c: [((c, c), 1.0, 0)])
    pairs = Machine("", lambda s, c: [((), 0.0, c)] if not s else [((s + c,), 0.5 if s == c else 9.0, "")], final=lambda s: not s)
    assert shortest(compose(double, pairs), "xy") == ("xx", "yy") and shortest(pairs, "xyz") is None and shortest(pairs, "") == ()


def test_a_model_is_named_or_a_path(machine):
    assert op.model_path("/some/file.model") == "/some/file.model" and op.machine(op.model_path()).ids == machine.ids


def test_decode_column_and_cases(spark, docs_of):
    docs = docs_of(None, "", "plain text", "plain text", "ab " * 20_000, "ok")
    out = op.encode_pieces(docs).orderBy("doc_id")
    got = out.collect()
    assert (got[0]["ids"], got[0]["n_pieces"]) == (None, None) and (got[1]["ids"], got[1]["n_pieces"]) == ([], 0)
    assert got[2]["ids"] == got[3]["ids"] and all(r["round_trip"] for r in got[1:])
    back = out.select("doc_id", op.decoder()("ids").alias("text")).collect()
    assert [r["text"] for r in sorted(back)] == [None, "", "plain text", "plain text", "ab " * 20_000, "ok"]
    assert op.encode_pieces(docs.limit(0)).count() == 0


def test_long_runs_of_marks(machine, library):
    draw = random.Random(1)
    for _ in range(60):
        text = "".join(draw.choice((" " * draw.randint(1, 40), "a", "the", "\n")) for _ in range(6))
        assert machine.encode(text) == library.encode(text)


def test_pairs_are_those_that_merges_leave_apart(machine):
    draw = random.Random(2)
    ids = sorted(machine.ids.values())
    short = [k for k in ids if len(machine.pieces[k]) < 4]
    pairs = [(draw.choice(ids), draw.choice(ids)) for _ in range(4000)] + [(draw.choice(short), draw.choice(short)) for _ in range(8000)]
    for a, b in pairs:
        x, y = machine.pieces[a], machine.pieces[b]
        if machine.stands(a) and machine.stands(b):
            assert machine._apart(a, b) == (machine.merged(x + y) == [x, y]), (x, y)


def test_a_full_cache_changes_nothing(machine, monkeypatch):
    monkeypatch.setattr(op, "CACHED", 5)
    texts = [f"some words {k} and {k % 7} others" for k in range(40)]
    want = [machine.encode(t) for t in texts]
    assert [machine.encode(t) for t in texts] == want and len(machine.cache) <= 5 + 12
