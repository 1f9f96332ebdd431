"""Column functions on a handful of values."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakewright.functions import text, values
from lakewright.operators import gallery


def of(spark, column, **cells):
    """One value of a column over one row."""
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string') if not isinstance(v, list) else 'array<string>'}" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(cells.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize(("typed", "cents"), [("1.234,50", 123450), ("1,234.50", 123450), ("12", 1200), ("3,5", 350), ("€ 7.99", 799), ("none", None), (".5", 50)])
def test_parse_cents(spark, typed, cents):
    assert of(spark, text.parse_cents(F.col("x")), x=typed) == cents


@pytest.mark.parametrize(("code", "key"), [("OP-007b", "op7b"), ("sv01", "sv1"), ("LOB-EN001", "loben1"), ("A0B00", "a0b0"), ("97★", "97")])
def test_code_key(spark, code, key):
    assert of(spark, text.code_key(F.col("x")), x=code) == key


@pytest.mark.parametrize(("number", "key"), [("EN012a", "12a"), ("012", "12"), ("★", None), ("SE1", "1"), ("ABC1", "abc1")])
def test_number_key(spark, number, key):
    assert of(spark, text.number_key(F.col("x")), x=number) == key


@pytest.mark.parametrize(("name", "plain"), [("Ætsu & Ōkami-Ré", "ætsuandokamire"), ("ﬁre 2", "fire2"), (None, None)])
def test_plain_name(name, plain):
    assert text.plain_name(name) == plain


def test_round_half_up_goes_up(spark):
    assert [of(spark, values.round_half_up(F.col("x")), x=v) for v in (0.5, 1.5, -0.5, -1.5, 2.4)] == [1, 2, 0, -1, 2]


def test_share_of_nothing_is_null(spark):
    assert of(spark, values.share(F.col("a"), F.col("b")), a=1, b=0) is None
    assert of(spark, values.share(F.col("a"), F.col("b")), a=1, b=3) == 0.3333


@pytest.mark.parametrize(("finish", "finishes", "rank"), [("normal", ["foil", "normal"], 1), ("foil", ["foil", "normal"], 2), ("etched", ["foil"], 1001), ("normal", [], 1), ("foil", ["foil"], 1)])
def test_finish_rank(spark, finish, finishes, rank):
    assert of(spark, values.finish_rank(F.col("f"), F.col("fs")), f=finish, fs=finishes) == rank


@pytest.mark.parametrize(("a", "b", "backs"), [("C", "R", True), ("UtR", "C", False), ("C", "UtR", True), ("GMR", "UR", False), ("XX", "XX", True), ("XX", "C", False), ("C", "XX", True), ("UtR", "XX", False)])
def test_scan_backs(spark, a, b, backs):
    assert of(spark, gallery.scan_backs(F.col("a"), F.col("b")), a=a, b=b) is backs


@pytest.mark.parametrize(("game", "rarity", "finish", "foil"), [("yugioh", "Ultra Rare", "normal", True), ("yugioh", "Common", "normal", False), ("pokemon", "Rare Holo", "normal", True), ("pokemon", "Rare", "reverse", True), ("mtg", "mythic", "normal", False), ("mtg", "common", "etched", True)])
def test_is_foil(spark, game, rarity, finish, foil):
    assert of(spark, gallery.is_foil(F.col("g"), F.col("r"), F.col("f"), F.lit(False)), g=game, r=rarity, f=finish) is foil


def test_plain_wikitext(spark):
    assert of(spark, text.plain_wikitext(F.col("x")), x="''A''<br />[[Page|the label]] [[Other]] <i>x</i> &amp; &#39;y&#39; ") == "A\nthe label Other x & 'y'"
    assert of(spark, text.plain_wikitext(F.col("x")), x="&#8222;a&#x201C; &#128512; 1 < 2 [[a|b|c]]  \n&amp;#39; &APOS;") == "„a“ 😀 1 < 2 b|c\n&#39; '"


def test_csv_field_quotes_only_where_needed(spark):
    assert of(spark, values.csv_line(F.col("a"), F.col("b"), F.col("c")), a='say "hi"', b="x,y", c="plain") == '"say ""hi""","x,y",plain'


def test_later_than_never_goes_back(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00.123456' AS now, TIMESTAMP'2024-01-01 10:00:00.5' AS old")
    assert df.select(values.later_than(F.col("now"), F.col("old"))).first()[0] == datetime.datetime(2024, 1, 1, 10, 0, 0, 501000)


def test_printed_limit(spark):
    limit = values.printed_limit(F.col("x"), 4)
    assert of(spark, limit, x="A deck can have up to seven cards named Dwarf.") == 7
    assert of(spark, limit, x="A deck can have any number of cards named Rat.") is None
    assert of(spark, limit, x="Flying") == 4


def test_stable_hash_and_owned_merge(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS x, map('b', '2', 'a', '1') AS y, map('b', '3', 'c', '4') AS z")
    same, merged = df.select(values.stable_hash(F.col("x")) == values.stable_hash(F.col("y")), values.owned_merge(F.col("x"), F.col("z"), ["a"])).first()
    assert same and merged == {"a": "1", "b": "3", "c": "4"}


def test_trigram_similarity(spark):
    s = text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))
    assert round(of(spark, s, a="word", b="two words"), 4) == 0.3636
    assert of(spark, s, a="", b="x") == 0.0
