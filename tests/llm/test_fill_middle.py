"""Fill-in-the-middle: exact round trips, the contract's rule by SQL, odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import difference, views

from lakewright.llm import fill_middle as fim

PIECES = st.sampled_from(["<P>", "<S>", "<M>", "<", "P", "S", ">", "<S", "a", "word", " ", "\n", "\x0b", "\x85", "　", "é", "\U0001f600"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join), st.integers(0, 10**6))
def test_round_trip(text, key):
    n, form, a, m, output = fim.rearranged(text, key, fim_percent=100)
    assert fim.restored(output, form) == text
    assert (form == "plain") == (not text or any(x in text for x in ("<P>", "<S>", "<M>"))) == (a is None) == (m is None)
    if form != "plain":
        assert sorted(output) == sorted(text + "<P><S><M>") and output.endswith("<M>" + text[a : a + m])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_units_cover_the_text(text):
    ends = fim.unit_ends(text)
    units = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    white = " \t\n\x0b\f\r"
    assert "".join(units) == text and all(u.lstrip(white) for u in units[:-1]) and all(not any(c in white for c in u.lstrip(white)) for u in units)


def test_draws_are_those_of_the_contract():
    h = hashlib.sha256(b"42:17").hexdigest()
    assert fim.draws(42, 17) == [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def test_query_against_sql(spark, sf_dir):
    assert difference(spark, views(sf_dir), fim.op12_fill_middle, fim.OP12_SQL, sf_dir) == ""


def test_every_form_occurs_and_turns_back(spark, docs_of):
    docs = docs_of(*(f"text {k} of  some words\n" * (k % 5) for k in range(300)))
    made = fim.fill_in_middle(docs)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = {(r["doc_id"], r["text"]) for r in fim.unmade(made).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in docs.collect()}


@pytest.mark.parametrize("name", ["n", "Form", "output", "made"])
def test_odd_rows(spark, docs_of, name):
    long = "many words " * 200_000
    rows = [(1, None), (1, ""), (None, "a b c"), (2, long), (2, long), (3, "<P> x"), (4, " \n"), (5, "one")]
    docs = docs_of(*rows).withColumnRenamed("score", name)
    got = fim.fill_in_middle(docs, fim_percent=100)
    kept = [c for c in docs.columns if c not in ("text", "n", "Form", "output")]
    assert got.columns == [*kept, "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(((k, *fim.rearranged(t, k, fim_percent=100)) for k, t in rows), key=repr)
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got.collect()), key=repr) == want
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
