"""Operators on small tables made here: matching, galleries, lists, merges, feeds."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.functions.text import norm_name
from lakewright.operators import feed, gallery, lists, matching, merge, pick, pricing


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_rules_in_order_and_unique(spark):
    a = table(spark, "a int, x string, y string", (1, "k", "m"), (2, None, "m"), (3, "q", None), (4, "k", "n"))
    b = table(spark, "b int, x string, y string", (10, "k", "m"), (11, "z", "m"), (12, "q", "o"))
    rules = [("x", F.col("x"), F.col("x")), ("y", F.col("y"), F.col("y"))]
    assert rows(matching.by_rules(a, b, "a", "b", rules)) == [(1, 10, "x"), (2, 10, "y"), (3, 12, "x"), (4, 10, "x")]
    assert rows(matching.by_rules(a, b, "a", "b", rules, unique=True)) == [(1, 10, "x"), (3, 12, "x"), (4, 10, "x")]


def test_tie_in_confidence_leaves_none(spark):
    m = table(spark, "p int, q int, confidence int", (1, 1, 70), (1, 2, 70), (2, 3, 100), (2, 4, 70), (3, 5, 40))
    assert rows(matching.best_unambiguous(m, ["p"]).select("p", "q")) == [(2, 3), (3, 5)]


def test_prefix_splits_find_every_cut(spark):
    asked = table(spark, "t string", ("ab12",), ("a",))
    codes = table(spark, "head string, number string", ("x", "1"))
    codes = table(spark, "code string, number string", ("ab", "123"), ("ab1", "2"), ("a", "b12"), ("ab", "99"))
    assert rows(matching.split_join(asked, "t", codes, "code", "number").select("t", "code", "number")) == [("a", "a", "b12"), ("ab12", "a", "b12"), ("ab12", "ab", "123"), ("ab12", "ab1", "2")]


def test_norm_name(spark):
    assert [r[0] for r in table(spark, "n string", ("Ré & Ō",), (None,)).select(norm_name()("n")).collect()] == ["reando", None]


def test_pick_pages(spark):
    pages = table(spark, "pos int, title string, passwords array<string>, langs array<string>", (0, "Other", ["1"], ["fr"]), (1, "German", ["1"], ["de"]), (2, "Name", ["1", "2"], ["fr"]), (3, "None", ["3"], []), (4, "Only", ["2"], ["fr"]))
    cards = table(spark, "key string, name string", ("1", "Name"), ("2", "x"), ("3", "None"))
    assert rows(gallery.pick_pages(pages, cards)) == [("1", "Name"), ("2", "Name")]
    assert rows(gallery.pick_pages(pages, table(spark, "key string, name string", ("1", "?")))) == [("1", "German")]


def test_localized_cards(spark):
    entries = table(spark, "entry long, image_ids array<long>, name_en string", (1, [1], "A"), (9, [9, 2], "B"), (8, [2], "B"), (7, [3], "not C"), (6, [1], "A"))
    cards = table(spark, "card_id string, key string, name string", ("a", "1", "A"), ("b", "2", "B"), ("c", "3", "C"))
    assert rows(gallery.localized_cards(entries, cards)) == [("a", 1), ("b", 8)]


def test_resolve_rarities(spark):
    prints = table(spark, "print_id string, set string, lang string, number string, rarity string, alt string", ("p", "s", "en", "EN001", None, None), ("q", "s", "en", "EN001", "UR", None), ("r", "s", "en", "EN002", None, None), ("t", "s", "en", "EN002", None, None))
    galleries = table(spark, "set string, lang string, pos int, code string, rarity string, alt string, file string", ("s", "en", 0, "S-EN001", "UR", "", "a"), ("s", "en", 1, "S-EN001", "UR", "EA", "b"), ("s", "en", 2, "S-EN002", "C", "", "c"))
    assert rows(gallery.resolve_rarities(prints, galleries)) == [("p", "UR", "EA")]


def test_plan_artworks(spark):
    prints = table(spark, "print_id string, set string, number string, rarity string, alt string, artworks int, langs array<string>", ("p", "s", "EN001", "StR", None, 2, ["de"]), ("q", "s", "EN002", "C", None, 1, ["de"]), ("g", "s", "EN003", "GMR", None, 2, []))
    galleries = table(
        spark, "set string, lang string, pos int, code string, rarity string, alt string, file string",
        ("s", "en", 0, "S-EN001", "StR", "AA", "star"), ("s", "en", 1, "S-EN001", "UR", "AA", "ultra"), ("s", "en", 2, "S-EN001", "UtR", "AA", "ultimate"), ("s", "en", 3, "S-EN001", "GMR", "AA", "grand"),
        ("s", "de", 4, "S-DE001", "StR", "", "stern"), ("s", "de", 5, "S-DE001", "UR", "", "ultra-de"), ("s", "en", 6, "S-EN002", "C", "", "common"),
        ("s", "en", 7, "S-EN003", "GMR", "", "own"), ("s", "en", 8, "S-EN003", "UR", "EA", "extended"),
    )
    got = {(r["print_id"], r["lang"]): (r["alt"], r["own_art"], r["files"], r["siblings"]) for r in gallery.plan_artworks(prints, galleries).collect()}
    assert got == {
        ("p", "en"): ("AA", False, ["star"], ["ultra", "ultimate"]),
        ("p", "de"): ("", False, ["stern"], []),
        ("g", "en"): ("", True, ["own"], ["extended"]),
    }


def test_plan_codes(spark):
    prints = table(spark, "print_id string, set string, number string, langs array<string>", ("p", "s", "EN001", ["de", "fr", "it"]), ("x", "s", "EN099", ["de"]), ("u", "dark", "EN001", ["de"]))
    codes = table(spark, "set string, lang string, pos int, code string", ("s", "en", 0, "S-EN001"), ("s", "de", 1, "S-DE001"), ("s", "de", 2, "Z-DE001"), ("s", "fr", 3, "F-FR001"), ("s", "it", 4, None), ("dark", "en", 0, None), ("dark", "de", 1, "dark-DE001"))
    assert rows(gallery.plan_codes(prints, codes)) == [("p", "de", "S-DE001"), ("p", "fr", "F-FR001")]


def test_fold_variants(spark):
    prints = table(spark, "pos int, card_id int, set string, number string, english_number string, variant string, code string", (0, 1, "s", "EN001", None, "ur", "S-EN001"), (1, 1, "s", "DE001", "EN001", "ur", "S-DE001"), (2, 1, "s", "FR001", "EN001", "ur", "S-FR001"), (3, 1, "s", "DE002", "EN002", "ur", "S-DE002"))
    assert rows(gallery.fold_variants(prints).select("number", "code", "variants")) == [("DE002", "S-DE002", []), ("EN001", "S-EN001", ["S-DE001", "S-FR001"])]


def test_pick_artwork(spark):
    products = table(
        spark, "key int, product int, name string, alt_art boolean",
        (1, 5, "Harp (Original Artwork)", False), (1, 4, "Harp (New Artwork)", False), (2, 5, "Harp (Original Artwork)", True), (2, 4, "Harp (New Artwork)", True),
        (3, 1, "One", False), (3, 2, "Two", False), (4, 7, "Lone", False), (5, 9, "Bare", False), (5, 8, "Bare (Alternate Art)", False),
    )
    assert rows(gallery.pick_artwork(products)) == [(1, 5), (2, 4), (5, 9)]


def test_regional_matches(spark):
    prints = table(spark, "print_id string, set string, number string, name string, rarity string", ("a", "s", "S-001", "X", "R"), ("b", "s", "S-EN002", "Y", "R"), ("c", "s", "S-E003", "Z", "R"), ("d", "s", "S-004", "X", "R"))
    products = table(spark, "product int, number string, name string, rarity string", (1, "S-EN001", "X", "R"), (2, "S-EN002", "Y", "R"), (3, "S-EN003", "Z", "R"), (4, "S-EN008", "Z", "R"))
    claimed = table(spark, "print_id string", ("d",))
    assert rows(gallery.regional_matches(prints, products, claimed)) == [("a", 1), ("c", 3)]


CARDS = "list_id int, zone string, name string, quantity long"


def test_lists(spark):
    cards = table(spark, CARDS, (1, "main", "a", 3), (1, "side", "a", 2), (1, "main", "b", 60), (2, "attic", "c", 1))
    zones = table(spark, "zone string, least int, most int", ("main", 60, 60), ("side", None, 1))
    assert rows(lists.size_problems(cards, zones, ["list_id"])) == [(1, "main", "wrong_size", 63), (1, "side", "too_many", 2), (2, "main", "wrong_size", 0)]
    assert rows(lists.zone_problems(cards, zones).select("name")) == [("c",)]
    assert rows(lists.copy_problems(cards, ["list_id"], F.when(F.col("name") == "b", F.lit(None).cast("int")).otherwise(4))) == [(1, "a", 5, 4)]
    assert rows(lists.first_per_name(cards.withColumn("code", F.when(F.col("name") == "a", "banned")), ["list_id"], [F.col("zone").asc()], "code")) == [(1, "a", "banned")]
    assert rows(lists.more_than_one(cards, ["list_id"], F.col("name") == "a", "two_aces")) == [(1, "two_aces", 5)]
    assert rows(lists.without_any(cards, ["list_id"], F.col("name") == "b", "no_b")) == [(2, "no_b")]
    assert rows(lists.outside_identity(table(spark, "list_id int, zone string, name string, identity array<string>", (1, "commander", "c", ["R"]), (1, "main", "x", ["R", "G"]), (1, "main", "y", []), (2, "commander", "d", ["R"]), (2, "commander", "e", ["R"]), (2, "main", "x", ["G"])), ["list_id"], "commander")) == [(1, "x")]


def test_health(spark):
    fresh = table(spark, "source string, game string, share double, stale long, priced long", ("a", "g", 0.94, 6, 100), ("b", "g", 0.99, 40, 100), ("c", "g", None, 0, 0))
    before = table(spark, "source string, game string, stale long", ("a", "g", 5), ("b", "g", 10), ("c", "g", 0))
    assert rows(lists.freshness_problems(fresh, before)) == [("a", "g", "a/g 94.0% refreshed in 24 h"), ("b", "g", "b/g 40 stale (was 10)")]
    runs = table(spark, "source string, status string, last_ok string", ("a", "done", "2024-01-01"), ("b", "failed", "2024-01-09"), ("c", "running", None)).withColumn("last_ok", F.col("last_ok").cast("timestamp"))
    assert rows(lists.run_problems(runs, "2024-01-10", hours=48)) == [("a", "missing"), ("b", "failed")]


@pytest.mark.parametrize(
    ("stored", "pushed", "action"),
    [
        (None, ("2", None, None), "insert"), (None, ("2", "2", None), "skip"), (None, ("2", None, "1"), "conflict"),
        (("1", None, "x"), ("2", None, "1"), "apply"), (("3", None, "x"), ("4", None, "1"), "conflict"), (("3", None, "x"), ("4", "4", "1"), "apply"),
        (("3", None, "x"), ("2", "2", "1"), "conflict"), (("3", "3", "x"), ("2", "2", "1"), "noop"), (("3", "3", "x"), ("4", None, "1"), "insert"), (("3", "3", "x"), ("2", None, "3"), "conflict"), (("1", None, "y"), ("2", None, None), "noop"),
    ],
)
def test_resolve(spark, stored, pushed, action):
    day = lambda d: f"2024-01-0{d}" if d else None
    stamps = lambda df: df.select("id", "v", *(F.col(c).cast("timestamp").alias(c) for c in df.columns if c.endswith("_at")))
    s = stamps(table(spark, "id int, v string, updated_at string, deleted_at string", *([(1, stored[2], day(stored[0]), day(stored[1]))] if stored else [])))
    p = stamps(table(spark, "id int, v string, updated_at string, deleted_at string, base_updated_at string", (1, "y", *map(day, pushed))))
    assert feed.resolve(s, p, "id", F.col("s.v") == F.col("p.v")).first()["action"] == action


def test_pull(spark):
    rows_ = spark.range(1, 11).withColumnRenamed("id", "seq").withColumn("size", F.lit(40))
    assert [r["seq"] for r in feed.pull(rows_, 3, budget=100, size=F.col("size")).collect()] == [4, 5]
    assert [r["seq"] for r in feed.pull(rows_, 3, budget=1, size=F.col("size")).collect()] == [4]
    assert feed.pull(rows_, 3, horizon=5).count() == 0


def test_merges_are_idempotent(spark):
    old = table(spark, "k int, v string, h string", (1, "a", "x"), (2, "b", "y"))
    new = table(spark, "k int, v string, h string", (2, "c", "z"), (3, "d", "w"))
    once = merge.upsert_by_hash(old, new, ["k"], "h")
    again = merge.upsert_by_hash(once, new, ["k"], "h", "action")
    assert rows(again.select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(again.groupBy("action").count()) == [("kept", 1), ("unchanged", 2)]


def test_map_changes(spark):
    old = spark.sql("SELECT 1 AS k, map('a', 'x', 'b', 'y', 'd', 'z') AS m")
    new = spark.sql("SELECT 1 AS k, map('a', 'x', 'b', 'q', 'c', 'n') AS m UNION ALL SELECT 2, map('a', 'x')")
    assert rows(merge.map_changes(old, new, ["k"], "m")) == [(1, "b", "y", "q"), (1, "c", None, "n"), (1, "d", "z", None)]


def test_thinning_across_weeks(spark):
    points = spark.sql("SELECT 's' AS s, explode(sequence(DATE'2024-01-01', DATE'2024-01-31')) AS d, 1 AS v")
    got = [str(r["d"]) for r in pricing.thin_history(points, ["s"], "d", "2024-01-31", 10).orderBy("d").collect()]
    assert got == ["2024-01-07", "2024-01-14", "2024-01-20"] + [f"2024-01-{d}" for d in range(21, 32)]


def test_first_nonempty(spark):
    assert pick.first_nonempty([spark.range(0), spark.range(2), spark.range(3)]).count() == 2


def test_sets_by_year(spark):
    sets = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', 'a'), (DATE'2024-05-01', 'b'), (NULL, 'c'), (DATE'2023-01-01', 'd') t(day, code)")
    assert {r["year"]: r["items"] for r in pick.by_year(sets, "day", "code").collect()} == {"2024": ["b", "a"], "": ["c"], "2023": ["d"]}


def test_a_run_is_counted_once(spark):
    counters = table(spark, "name string, value long, run_id string", ("catalog_version", 1, "r1"))
    once = merge.bump_once(counters, table(spark, "run_id string", ("r1",), ("r2",), ("r2",)))
    assert rows(once) == [("catalog_version", 1, "r1"), ("catalog_version", 2, "r2")]
    assert rows(merge.bump_once(once, table(spark, "run_id string", ("r2",)))) == rows(once)


def test_set_value_leaves_other_currencies(spark):
    prices = table(spark, "g string, p string, cents long, currency string, observed_at string", ("g", "a", 100, "EUR", "1"), ("g", "b", 50, "EUR", "2"), ("g", "c", 9, "USD", "3"))
    owned = table(spark, "p string, quantity int", ("a", 2), ("a", 1), ("c", 1))
    assert rows(pricing.set_value(prices, owned, ["g"], "p", "EUR")) == [("g", 300, 50, 3, 1, "2")]


def test_similar_pairs_are_all_pairs(spark):
    import random

    from lakewright.operators.search import similar_pairs

    draw = random.Random(1)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(80)]
    grams = [{f"  {w} "[i : i + 3] for i in range(len(w) + 1)} for w in words]
    want = sorted((i, j) for i in range(40) for j in range(40, 80) if len(grams[i] & grams[j]) >= 0.3 * len(grams[i] | grams[j]) - 1e-9)
    df = table(spark, "k long, w string", *enumerate(words))
    got = similar_pairs(df.where("k < 40"), df.where("k >= 40").withColumnRenamed("k", "l"), "k", "w", "l", "w")
    assert sorted((r["k"], r["l"]) for r in got.collect()) == want


def test_similar_pairs_of_equal_texts_and_no_broadcast(spark):
    from lakewright.operators.search import similar_pairs

    left = table(spark, "k long, w string", (1, "small ring"), (2, "small ring"), (3, None))
    right = table(spark, "l long, v string", *((n, "smal ring") for n in range(5)), (9, "other"), (10, None))
    got = similar_pairs(left, right, "k", "w", "l", "v")
    assert sorted((r["k"], r["l"]) for r in got.collect()) == [(k, n) for k in (1, 2) for n in range(5)]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_products_and_prints_of_one_number_make_no_pairs(spark, monkeypatch):
    """Copies of one number and rarity: what is saved on the way grows with the rows, not with their product."""
    from lakewright.operators import imports

    n, saved = 400, []
    monkeypatch.setattr(imports.Steps, "save", lambda self, d, save=imports.Steps.save: saved.append(save(self, d)) or saved[-1])
    shape = lambda key: [F.col("id").alias(key), F.lit("s").alias("set_id"), F.lit("B-EN001").alias("number"), F.lit("Rare").alias("rarity")]
    products = spark.range(n).select(*shape("product_id"), F.when(F.col("id") == 7, "lone").otherwise("copy").alias("name"))
    prints = spark.range(n).select(*shape("print_id"), F.when(F.col("id") < 3, "lone").otherwise("copy").alias("name"), F.lit(False).alias("alt_art"))
    got = imports.match_group(products, prints, regional=True)
    assert rows(got) == [(7, k, "number", 70) for k in range(3)]
    assert saved and all(d.count() <= n for d in saved)


def test_the_parts_of_asked_prices_are_not_packed_by_bytes(spark):
    """Sorted rows are far larger than shuffled ones, so a part that is packed up to a number of bytes takes much memory."""
    made = spark.createDataFrame([(p, f, None if p == 2 else "de", "NM", ["normal", "foil"]) for p in (1, 2, 3) for f in ("foil", "foil", "normal")], "p int, finish string, lang string, condition string, finishes array<string>")
    prices = spark.createDataFrame([(1, "foil", "tcgplayer", "de", "USD", 10), (1, "foil", "cardmarket", "de", "EUR", 20), (1, "normal", "cardmarket", "en", "EUR", 30), (2, "normal", "cardmarket", "fr", "EUR", 40)], "p int, finish string, source string, lang string, currency string, market int")
    priced = pricing.entry_price(made, prices.withColumn("observed_at", F.lit("2024-01-01")), ["p"], "EUR")
    assert priced._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert rows(priced.select("p", "finish", "market_cents").orderBy("p", "finish")) == [(1, "foil", 20)] * 2 + [(1, "normal", 30)] + [(2, "foil", 40)] * 2 + [(2, "normal", 40)] + [(3, "foil", None)] * 2 + [(3, "normal", None)]
