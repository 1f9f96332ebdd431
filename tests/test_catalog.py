"""Catalog questions on a small catalog made here."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.plans import catalog as q


@pytest.fixture(scope="module")
def k(spark):
    def df(schema, *data):
        return spark.createDataFrame(list(data), schema)

    day = lambda d, *cols: d.select(*(F.col(c).cast("date").alias(c) if c == "released_on" else F.col(c).cast("timestamp").alias(c) if c in ("created_at", "observed_at") else c for c in d.columns))
    m = "map<string,string>"
    return q.Catalog(
        games=df("id string, name string, sort int, card_format string", ("g", "Game", 1, "standard"), ("h", "Empty", 2, "standard")),
        sets=day(df(
            "id string, game_id string, code string, name string, released_on string, created_at string",
            ("s1", "g", "ab01", "Alpha", "2024-01-01", "2023-01-01"), ("s2", "g", "ab2", "Beta", "2024-03-01", "2023-01-01"),
            ("s3", "g", "prm", "Promo", None, "2024-03-05"), ("s4", "g", "old", "Undated", None, "2023-01-01"))),
        set_localizations=df("set_id string, lang string, name string", ("s1", "de", "Alfa")),
        cards=df(
            f"id string, game_id string, name string, type_line string, text string, legalities {m}",
            ("c1", "g", "Fire Lion", "Beast", "It burns the sun.", {"t": "Limited"}), ("c2", "g", "Sun Cat", "Beast", "Purr", {"t": "Forbidden"}), ("c3", "g", "Moon Dog", None, None, {})),
        prints=day(df(
            f"id string, card_id string, set_id string, number string, variant string, rarity string, finishes array<string>, external_ids {m}, released_on string",
            ("p1", "c1", "s1", "EN001", "", "rare", ["normal", "foil"], {"image_url": "x", "alt": "EA"}, "2024-01-01"), ("p2", "c1", "s2", "7", "", "common", ["foil"], {}, "2024-03-01"),
            ("p3", "c2", "s1", "EN010", "", None, [], {}, "2024-01-01"), ("p4", "c3", "s1", "EN002", "", "common", ["normal"], {}, "2024-01-01"))),
        print_localizations=df("print_id string, lang string, name string, text string", ("p1", "de", "Feuerlöwe", None), ("p3", "de", "Sonnenkatze", None)),
        prices=day(df(
            "print_id string, finish string, source string, lang string, currency string, cents_market long, observed_at string",
            ("p1", "foil", "tcgplayer", "en", "USD", 500, "2024-03-01"), ("p1", "normal", "cardmarket", "en", "EUR", 100, "2024-03-01"), ("p1", "normal", "cardmarket", "de", "EUR", 120, "2024-03-02"),
            ("p2", "foil", "tcgplayer", "en", "USD", 900, "2024-03-01"), ("p3", "etched", "cardmarket", "fr", "EUR", 50, "2024-03-01"))),
    )


def test_games_and_sets(k):
    assert rows(q.list_games(k).select("id", "set_count")) == [("g", 4), ("h", 0)]
    assert [(r["code"], r["localized_name"]) for r in q.list_sets(k, "g", "de").collect()] == [("ab2", None), ("ab01", "Alfa"), ("old", None), ("prm", None)]


def test_new_sets(k):
    """An undated set that came with the first import isn't new."""
    assert rows(q.new_sets(k, "en", "2024-02-01", "2024-04-01").select("code")) == [("ab2",), ("prm",)]
    assert rows(q.new_sets(k, "en", "2024-02-01", "2024-04-01", most=1).select("code")) == [("ab2",)]


def test_set_page_by_price_and_language(k):
    page = q.set_page(k, "s1", lang="de", currency="EUR", sort="price").collect()
    assert [(r["id"], r["name"], r["market"] and r["market"]["cents"]) for r in page] == [("p1", "Feuerlöwe", 120), ("p3", "Sonnenkatze", 50), ("p4", "Moon Dog", None)]
    assert [r["id"] for r in q.set_page(k, "s1", lang="en", currency="USD", rarity="rare").collect()] == ["p1"]
    assert [r["id"] for r in q.set_page(k, "s1", lang="en", currency="USD", size=1, number=2).collect()] == ["p4"]
    assert [r["id"] for r in q.set_page(k, "s1", lang="en", currency="USD", sort="rarity").collect()] == ["p4", "p1", "p3"]


def test_set_facets(k):
    assert rows(q.set_facets(k, "s1")) == [("finish", "foil", 1), ("finish", "normal", 2), ("language", "de", 1), ("rarity", "common", 1), ("rarity", "rare", 1)]


def test_card_prints(k):
    got = q.card_prints(k, "c1", lang="en", currency="USD").collect()
    assert [(r["id"], r["set_code"], r["market"]["cents"]) for r in got] == [("p2", "ab2", 900), ("p1", "ab01", 100)]
    assert got[1]["external_ids"] == {"alt": "EA"} and got[1]["localizations"][0]["lang"] == "de"


@pytest.mark.parametrize(
    ("typed", "first"),
    [("ab01-en001", "p1"), ("AB1 EN1", "p1"), ("ab27", "p2"), ("feuer", "p1"), ('"sun cat"', "p3"), ("sun", "p3"), ("lion -beast", None), ("Fire Lyon", "p2"), ("moon or cat", "p4"), ("zzzzzz", None)],
)
def test_search(k, typed, first):
    hits = q.search_prints(k, typed, lang="en", currency="EUR").collect()
    assert (hits[0]["id"] if hits else None) == first


def test_search_shows_the_language_of_the_match(k):
    hit = q.search_prints(k, "feuerlöwe", lang="en", currency="EUR").first()
    assert (hit["lang"], hit["name"]) == ("de", "Feuerlöwe")


def test_name_hits_come_before_text_hits(k):
    ids = [r["id"] for r in q.search_prints(k, "sun", lang="en", currency="EUR").collect()]
    assert ids[0] == "p3" and set(ids) == {"p1", "p2", "p3"}


def test_suggest(k):
    got = [(r["kind"], r["id"], r["tier"]) for r in q.suggest(k, "ab01", lang="en").collect()]
    assert got[0] == ("set", "s1", 3) and {x[1] for x in got[1:]} == {"p1", "p3", "p4"} and {x[2] for x in got[1:]} == {4}
    assert [(r["id"], r["tier"], r["lang"]) for r in q.suggest(k, "fire", lang="en").collect()] == [("p2", 5, "en")]
    assert [(r["id"], r["tier"], r["lang"]) for r in q.suggest(k, "feuer", lang="en").collect()] == [("p1", 5, "de")]
    assert [(r["id"], r["tier"]) for r in q.suggest(k, "fyre lion", lang="en").collect()] == [("p2", 6)]
    assert q.suggest(k, "ab01en001", lang="en").first()["tier"] == 0


def test_print_prices(k):
    assert ("p1", "normal", "cardmarket", "de") in rows(q.print_prices(k, lang="de").select("print_id", "finish", "source", "lang"))


def test_condition_estimates(spark):
    shown = spark.createDataFrame([("p", "g", 100), ("q", "h", 99)], "print_id string, game_id string, cents long")
    factors = spark.createDataFrame([("h", "EX", 0.5)], "game_id string, condition string, factor double")
    got = {(r["print_id"], r["condition"]): r["cents"] for r in q.condition_estimates(shown, factors).collect()}
    assert got[("p", "PO")] == 30 and got[("p", "EX")] == 85 and len(got) == 7 and got[("q", "EX")] == 50


def test_price_history_fills_with_english_and_thins(spark):
    data = [("p", "normal", "x", lang, "EUR", f"2024-{mo:02d}-{d:02d}", 1) for mo in (1, 6) for d in range(1, 15) for lang in (["en"] if d < 8 else ["en", "de"])]
    daily = spark.createDataFrame(data, "print_id string, finish string, source string, lang string, currency string, observed_at string, cents long").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    got = rows(q.price_history(daily, lang="de", today="2024-07-15", days=365).select(F.col("day").cast("string"), "lang"))
    assert len(got) == 14 + 2 and ("2024-06-09", "de") in got and ("2024-06-02", "en") in got
    assert [g for g in got if g[0] < "2024-06"] == [("2024-01-07", "en"), ("2024-01-14", "de")]


def test_banlist(spark, k):
    assert rows(q.banlist(k.cards, "t")) == [("c1", "Fire Lion", "Limited"), ("c2", "Sun Cat", "Forbidden")]
    changes = spark.createDataFrame([("1", "c1", "t", None, "Limited", "2024-05-01"), ("2", "c3", "t", None, "Unlimited", "2024-05-01"), ("3", "c1", "t", "Limited", None, "2020-01-01")], "id string, card_id string, format string, from_status string, to_status string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    assert rows(q.banlist_changes(changes, "t", "2024-01-01").select("id")) == [("1",)]
    owned = spark.createDataFrame([("u", "p1", 2), ("u", "p2", 1), ("u", "p3", 1)], "user_id string, print_id string, quantity int")
    decks = spark.createDataFrame([("d", "c2", 1), ("d", "c3", 9)], "deck_id string, card_id string, quantity int")
    got = q.banlist_impact(k.cards, changes, owned, k.prints, decks, "t", "2024-01-01").select("kind", "owner", "card_id", "copies", "allowed")
    assert rows(got) == [("collection", "u", "c1", 3, 1), ("deck", "d", "c2", 1, 0)]


def entries(spark):
    return spark.createDataFrame([("e1", "u", "p1", 2, "de", "NM", "normal"), ("e2", "u", "p2", 1, "en", "EX", "foil"), ("e3", "u", "p4", 5, "en", "NM", "normal")], "id string, user_id string, print_id string, quantity int, language string, condition string, finish string")


def test_collection(spark, k):
    assert rows(q.collection_rows(k, entries(spark), "feuer").select("id")) == [("e1",)]
    assert rows(q.collection_rows(k, entries(spark), "AB2").select("id")) == [("e2",)]
    assert rows(q.collection_rows(k, entries(spark), condition="NM").select("id")) == [("e1",), ("e3",)]
    counts, worth = q.collection_summary(k, entries(spark), "EUR", ["user_id"])
    assert rows(counts) == [("u", 8, 3, 5)]
    assert rows(worth.select("source", "currency", "cents")) == [("cardmarket", "EUR", 240), ("tcgplayer", "USD", 765)]


def test_deck_analysis(spark, k):
    deck = spark.createDataFrame([("d", "c1", "main", 3), ("d", "c2", "attic", 1)], "deck_id string, card_id string, zone string, quantity int")
    zones = spark.createDataFrame([("main", 4, 60)], "zone string, least int, most int")
    owned = spark.createDataFrame([("p1", 1)], "print_id string, quantity int")
    problems, missing = q.deck_analysis(k, deck, owned, zones, F.lit(2), "EUR")
    assert rows(problems) == [("d", "too_few", "main", 3), ("d", "too_many_copies", "Fire Lion", 3), ("d", "wrong_zone", "Sun Cat", 1)]
    assert rows(missing.select("name", "missing", "print_id", "market")) == [("Fire Lion", 2, "p1", 100), ("Sun Cat", 1, "p3", 50)]


def test_growing_sides_are_never_broadcast(spark, sf_dir):
    """Files say little of how large their rows are: cards and prints are dealt out, whatever their size."""
    import re

    from lakewright.plans import shop

    for query in (shop.catalog_search, shop.catalog_deck_problems, shop.catalog_collection_rows):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[card_id#", plan)
