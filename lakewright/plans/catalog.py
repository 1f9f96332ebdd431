"""Questions about a catalog of sets, cards and prints, their prices, collections and lists.

Each function takes a `Catalog` of DataFrames and returns one; nothing is read before an action.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.text import alnum, code_key, numeric_part, tokens
from lakewright.functions.values import ban_limit, condition_factor, language_rank, preference, round_half_up, without_keys
from lakewright.operators import lists, pick, pricing, search
from lakewright.operators.feed import latest
from lakewright.sources.tables import dealt

c = F.col
#: Rarities that sort before all others, in order.
RARITIES = ["common", "uncommon", "rare", "mythic"]
#: Conditions with an estimated price, best first.
CONDITIONS = ["NM", "EX", "GD", "LP", "PL", "PO"]
#: Keys of a print's external ids that stay internal.
INTERNAL_IDS = ["scryfall_images", "scryfall_back_images", "tcgdex_images", "pokemontcg_images", "tcgdex_marketplace", "image_url", "image_url_small", "artwork"]
NEW_SETS = 8


@dataclass
class Catalog:
    games: DataFrame
    sets: DataFrame
    set_localizations: DataFrame
    cards: DataFrame
    prints: DataFrame
    print_localizations: DataFrame
    prices: DataFrame
    #: The index of names: what `name_postings` gives, written in order of its grams; made anew where it is missing.
    postings: DataFrame | None = None


def name_postings(cards: DataFrame, print_localizations: DataFrame) -> DataFrame:
    """gram, name, size over all names, for typos."""
    return search.sized_postings(cards.select("name").unionByName(print_localizations.select("name")).distinct(), "name", "name")


def index_rows(k: Catalog) -> DataFrame:
    """group, key, name, text: the prints of each set with their names in all languages, their types and texts, for a `sources.search_index.SearchIndex`."""
    names = k.print_localizations.groupBy("print_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("name"))).alias("_names"), F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("_texts"))
    card = k.cards.select(c("id").alias("card_id"), "name", "type_line", "text")
    rows = k.prints.select("set_id", c("id").alias("print_id"), "card_id").join(dealt(card), "card_id").join(dealt(names), "print_id", "left")
    return rows.select(c("set_id").cast("string").alias("group"), c("print_id").cast("long").alias("key"), F.concat_ws(" ", "name", "_names").alias("name"), F.concat_ws(" ", "type_line", "text", "_texts").alias("text"))


def like_names(k: Catalog, typed: str) -> DataFrame:
    """name and similarity of the names that are like a typed one."""
    held = k.postings if k.postings is not None else name_postings(k.cards, k.print_localizations)
    return search.similar_names(held, "name", "name", typed, 0.3)


def number_order(prefix: str = "") -> list[Column]:
    """By the number's digits, then its text, then the variant."""
    number = c(f"{prefix}number")
    return [numeric_part(number).asc_nulls_last(), number.asc(), c(f"{prefix}variant").asc()]


def list_games(k: Catalog) -> DataFrame:
    sets = k.sets.select(c("game_id").alias("id"))
    return pick.with_count(k.games, sets, ["id"], "set_count").select("id", "name", "card_format", "set_count", "sort")


def set_summaries(k: Catalog, lang: str) -> DataFrame:
    names = k.set_localizations.where(c("lang") == lang).select(c("set_id").alias("id"), c("name").alias("localized_name"))
    return k.sets.join(names, "id", "left")


def list_sets(k: Catalog, game: str, lang: str) -> DataFrame:
    return set_summaries(k, lang).where(c("game_id") == game).orderBy(c("released_on").desc_nulls_last(), "code")


def new_sets(k: Catalog, lang: str, since: str, today: str, most: int = NEW_SETS) -> DataFrame:
    """The newest sets of each game. Undated ones count by their import, a day after the game's first import or later."""
    first = k.sets.groupBy("game_id").agg(F.min("created_at").alias("_first"))
    day = lambda x: F.lit(x).cast("date")
    undated = c("released_on").isNull() & (c("created_at") >= day(since)) & (c("created_at") > c("_first") + F.expr("INTERVAL 1 DAY"))
    fresh = set_summaries(k, lang).join(first, "game_id").where(c("released_on").between(day(since), day(today)) | undated)
    order = [c("released_on").desc_nulls_last(), c("created_at").desc(), c("code").asc()]
    return pick.top_n(fresh, ["game_id"], order, most).drop("_first")


def market_price(prints: DataFrame, prices: DataFrame, currency: str, lang: str) -> DataFrame:
    """Prints (id, finishes, ...) with the price to show, or null."""
    candidates = prints.select(c("id").alias("print_id"), "finishes").join(prices.drop("finishes"), "print_id")
    best = pricing.display_price(candidates, ["print_id"], currency=currency, lang=lang, finishes=c("finishes"))
    shown = best.select(c("print_id").alias("id"), F.struct(c("cents_market").alias("cents"), "currency", "source", "finish", "lang", "observed_at").alias("market"))
    return prints.join(shown, "id", "left")


def named_prints(k: Catalog, lang: str) -> DataFrame:
    """Prints with their card's columns and the name in a language, else in English, else the card's."""
    card = k.cards.select(c("id").alias("card_id"), c("name").alias("card_name"), "game_id", "type_line")
    names = k.print_localizations
    own = names.where(c("lang") == lang).select(c("print_id").alias("id"), c("name").alias("_own"))
    english = names.where(c("lang") == "en").select(c("print_id").alias("id"), c("name").alias("_english"))
    out = k.prints.join(dealt(card), "card_id").join(dealt(own), "id", "left").join(dealt(english), "id", "left")
    return out.withColumn("name", F.coalesce("_own", "_english", "card_name")).withColumn("localized", c("_own").isNotNull()).drop("_own", "_english")


def set_page(k: Catalog, set_id: str, *, lang: str, currency: str, sort: str = "number", rarity: str | None = None, finish: str | None = None, size: int = 60, number: int = 1) -> DataFrame:
    """One page of a set's prints. Sorted by price, prints without one in the currency come last."""
    conditions = [c("set_id") == set_id, c("rarity") == rarity if rarity else None, F.array_contains("finishes", finish) if finish else None]
    shown = market_price(pick.optional_filters(named_prints(k, lang), conditions), k.prices, currency, lang)
    order = {
        "number": [],
        "name": [c("name").asc()],
        "rarity": [preference(c("rarity"), RARITIES).asc()],
        "price": [(c("market.currency") == currency).desc_nulls_last(), c("market.cents").desc_nulls_last()],
    }[sort]
    return pick.page(shown, [*order, *number_order()], size, number)


def set_facets(k: Catalog, set_id: str) -> DataFrame:
    """facet, value, n: rarities, finishes and languages of a set's prints."""
    own = k.prints.where(c("set_id") == set_id)
    langs = k.print_localizations.join(own.select(c("id").alias("print_id")), "print_id", "left_semi").select("lang").distinct()
    one = lambda df, name: df.select(F.lit(name).alias("facet"), "value", "n")
    rarities, finishes = pick.facet(own.where("rarity IS NOT NULL"), c("rarity")), pick.exploded_facet(own, c("finishes"))
    return one(rarities, "rarity").unionByName(one(finishes, "finish")).unionByName(one(langs.select(c("lang").alias("value"), F.lit(1).cast("long").alias("n")), "language"))


def card_prints(k: Catalog, card_id: str, *, lang: str, currency: str) -> DataFrame:
    """A card's prints, newest first, with their set, localizations and price."""
    own = k.prints.where(c("card_id") == card_id)
    sets = k.sets.select(c("id").alias("set_id"), c("code").alias("set_code"), c("name").alias("set_name"))
    texts = k.print_localizations.groupBy(c("print_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("lang", "name", "text"))).alias("localizations"))
    shown = market_price(own, k.prices, currency, lang).join(sets, "set_id").join(texts, "id", "left")
    return shown.withColumn("external_ids", without_keys(c("external_ids"), INTERNAL_IDS)).orderBy(c("released_on").desc_nulls_last(), "set_code", *number_order())


def code_hits(k: Catalog, typed: str) -> DataFrame:
    """print_id, rank: prints whose set code and number are spelt as typed; 300 all, 200 without leading zeros, 100 the beginning."""
    spark = k.prints.sparkSession
    key = spark.range(1).select(alnum(F.lit(typed)).alias("key")).where("key != ''")
    cuts = key.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("cut")).select(code_key(F.left("key", "cut")).alias("head"), F.substr("key", c("cut") + 1).alias("rest")).distinct()
    sets = k.sets.select(c("id").alias("set_id"), code_key(c("code")).alias("head"))
    # A typed code has a few dozen cuts at most.
    hits = k.prints.join(sets.join(F.broadcast(cuts), "head"), "set_id")
    exact, bare = alnum(c("number")), code_key(c("number"))
    rank = F.when(exact == c("rest"), 300).when(bare == code_key(c("rest")), 200).when((c("rest") != "") & bare.startswith(c("rest")), 100).when(c("rest") == "", 0)
    return hits.withColumn("rank", rank.cast("double")).where("rank IS NOT NULL").groupBy(c("id").alias("print_id")).agg(F.max("rank").alias("rank"))


def card_texts(k: Catalog) -> DataFrame:
    """print_id, lang, name, words of the name, words of name, type and text: one row for each language of a print."""
    card = k.prints.select(c("id").alias("print_id"), "card_id").join(dealt(k.cards.select(c("id").alias("card_id"), "name", "type_line", "text")), "card_id")
    own = card.select("print_id", F.lit("en").alias("lang"), "name", "type_line", "text")
    other = k.print_localizations.select("print_id", "lang", "name", F.lit(None).cast("string").alias("type_line"), "text")
    both = own.unionByName(other)
    return both.select("print_id", "lang", "name", tokens(c("name")).alias("name_words"), tokens(c("name"), c("type_line"), c("text")).alias("words"))


def search_hits(k: Catalog, typed: str) -> DataFrame:
    """print_id, rank, langs: by code, by words, and only if neither finds anything, by similar names.

    A hit in the name counts 1 more than one in the text; langs are the languages of the best hits.
    """
    texts = card_texts(k)
    words = search.token_search(texts, typed, c("name_words"), c("words")).select("print_id", c("score").alias("rank"), "lang")
    codes = code_hits(k, typed).where("rank > 0").select("print_id", "rank", F.lit(None).cast("string").alias("lang"))
    exact = words.unionByName(codes)
    branches = [exact]
    if search.TokenQuery.of(typed).fuzzy and len(typed) >= 4:
        branches.append(texts.join(like_names(k, typed), "name").select("print_id", c("similarity").cast("double").alias("rank"), "lang"))
    hits = pick.first_nonempty(branches)
    # A print has a hit a language, and one by its code.
    best = hits.groupBy("print_id").agg(F.max("rank").alias("rank"), F.max(F.when(c("lang").isNotNull(), c("rank"))).alias("_top"), F.collect_set(F.struct("lang", "rank")).alias("_hits"))
    langs = F.transform(F.filter("_hits", lambda h: h["lang"].isNotNull() & (h["rank"] == c("_top"))), lambda h: h["lang"])
    return best.select("print_id", "rank", F.array_sort(langs).alias("langs"))


def search_prints(k: Catalog, typed: str, *, lang: str, currency: str, game: str | None = None, set_code: str | None = None, rarity: str | None = None, finish: str | None = None, size: int = 60, number: int = 1) -> DataFrame:
    """One page of hits. The page is cut first; names and prices are looked up for its prints only."""
    sets = k.sets.select(c("id").alias("set_id"), c("code").alias("set_code"), c("released_on").alias("set_released"), "game_id")
    card = k.cards.select(c("id").alias("card_id"), c("name").alias("card_name"))
    rows = search_hits(k, typed).withColumnRenamed("print_id", "id").join(dealt(k.prints), "id").join(sets, "set_id").join(dealt(card), "card_id")
    conditions = [c("game_id") == game if game else None, c("set_code") == set_code if set_code else None, c("rarity") == rarity if rarity else None, F.array_contains("finishes", finish) if finish else None]
    order = [c("rank").desc(), c("card_name").asc(), c("set_released").desc_nulls_last(), c("set_code").asc(), *number_order()]
    page = pick.page(pick.optional_filters(rows, conditions), order, size, number)
    shown = F.when(F.array_contains("langs", lang), lang).when(F.array_contains("langs", "en"), "en").otherwise(F.coalesce(F.get("langs", F.lit(0)), F.lit(lang)))
    page = page.withColumn("lang", shown)
    names = k.print_localizations.select(c("print_id").alias("id"), "lang", c("name").alias("_own"))
    named = page.join(names, ["id", "lang"], "left").withColumn("name", F.coalesce("_own", "card_name")).drop("_own")
    return market_price(named, k.prices, currency, lang).orderBy(*order)


def newest_print(k: Catalog, ranked: DataFrame) -> DataFrame:
    """Of each ranked card (card_id, ord, lang), the newest print that has a name in its language."""
    names = k.print_localizations.select(c("print_id").alias("id"), "lang")
    held = names.unionByName(k.prints.select("id", F.lit("en").alias("lang"))).distinct()
    released = k.sets.select(c("id").alias("set_id"), c("released_on").alias("set_released"))
    own = k.prints.select("id", "card_id", "set_id", "number", "variant")
    fits = ranked.join(dealt(own), "card_id").join(dealt(held), ["id", "lang"]).join(released, "set_id")
    return pick.distinct_on(fits, ["card_id"], [c("set_released").desc_nulls_last(), *number_order(), c("id").asc()]).select("id", "ord", "lang")


def suggest(k: Catalog, typed: str, *, lang: str, limit: int = 10) -> DataFrame:
    """kind, id, tier, ord, lang: exact codes, bare codes, partial numbers, sets, prints of a set named by its code, names that begin so, similar names."""
    codes = code_hits(k, typed).join(dealt(k.prints.select(c("id").alias("print_id"), "number", "variant")), "print_id")
    tier = F.when(c("rank") >= 300, 0).when(c("rank") >= 200, 1).when(c("rank") > 0, 2).otherwise(4)
    shape = lambda df, kind, t: df.select(F.lit(kind).alias("kind"), "id", t.alias("tier"), "ord", "lang")
    by_code = pick.top_n(codes.withColumn("id", c("print_id")).withColumn("_part", c("rank") > 0).withColumn("_tier", tier), ["_part"], [c("rank").desc(), *number_order(), c("id").asc()], limit, rank="ord", keep_rank=True).withColumn("lang", F.lit(None).cast("string"))
    by_code = shape(by_code.where((c("_tier") < 4) | (c("ord") <= 3)), "print", c("_tier"))

    starts = lambda x: F.lower(x).startswith(typed.lower())
    local = k.set_localizations.where((c("lang") == lang) & starts(c("name"))).select(c("set_id").alias("id"), F.lit(True).alias("_local"))
    sets = k.sets.join(local, "id", "left").where((code_key(c("code")) == code_key(F.lit(typed))) | starts(c("name")) | F.coalesce("_local", F.lit(False)))
    order = [c("released_on").desc_nulls_last(), c("code").asc(), c("id").asc()]
    by_set = shape(pick.numbered(pick.page(sets, order, limit), order, "ord").withColumn("lang", F.lit(None).cast("string")), "set", F.lit(3))

    names = k.cards.select(c("id").alias("card_id"), "name", F.lit("en").alias("lang")).unionByName(k.print_localizations.join(dealt(k.prints.select(c("id").alias("print_id"), "card_id")), "print_id").select("card_id", "name", "lang"))
    picked = F.when(F.bool_or(c("lang") == lang), F.lit(lang)).when(F.bool_or(c("lang") == "en"), F.lit("en")).otherwise(F.min("lang"))
    begin = names.where(starts(c("name"))).groupBy("card_id").agg(F.min(F.length("name")).alias("_len"), F.min("name").alias("_name"), picked.alias("lang"))
    order = [c("_len").asc(), c("_name").asc(), c("card_id").asc()]
    prefix = pick.numbered(pick.page(begin, order, limit), order, "ord")
    tiers = [by_code, by_set, shape(newest_print(k, prefix), "print", F.lit(5))]
    if len(typed) >= 4 and prefix.count() < limit:
        near = names.join(like_names(k, typed).withColumnRenamed("similarity", "s"), "name")
        best = near.groupBy("card_id").agg(F.max("s").alias("_s"), F.min("name").alias("_name"), F.min_by("lang", F.struct(-c("s"), c("lang") != lang, c("lang") != "en", "lang")).alias("lang"))
        order = [c("_s").desc(), c("_name").asc(), c("card_id").asc()]
        tiers.append(shape(newest_print(k, pick.numbered(pick.page(best, order, limit), order, "ord")), "print", F.lit(6)))
    every = reduce(DataFrame.unionByName, tiers)
    best = every.groupBy("kind", "id").agg(F.min_by(F.struct("tier", "ord", "lang"), F.struct("tier", "ord")).alias("b")).select("kind", "id", "b.*")
    return best.orderBy("tier", "ord", "kind", "id").limit(limit)


def print_prices(k: Catalog, *, lang: str) -> DataFrame:
    """Of each print, source and finish the price in the language, else English, else another."""
    return pick.distinct_on(k.prices, ["print_id", "source", "finish"], [language_rank(c("lang"), lang).asc(), c("lang").asc()])


def condition_estimates(displayed: DataFrame, factors: DataFrame) -> DataFrame:
    """print_id, condition, factor, cents: estimates from the price to show (print_id, game_id, cents) by the game's own factors, else the defaults."""
    graded = displayed.withColumn("condition", F.explode(F.array(*(F.lit(x) for x in CONDITIONS))))
    own = factors.select("game_id", "condition", c("factor").cast("double").alias("_own"))
    has = factors.select("game_id").distinct().withColumn("_has", F.lit(True))
    out = graded.join(own, ["game_id", "condition"], "left").join(has, "game_id", "left").where(c("_has").isNull() | c("_own").isNotNull())
    factor = condition_factor(c("condition"), c("_own"))
    return out.select("print_id", "condition", factor.alias("factor"), round_half_up(c("cents") * factor).alias("cents"))


def price_history(daily: DataFrame, *, lang: str, today: str, days: int) -> DataFrame:
    """Series by print, source, finish and currency: a language's price of each day, thinned to weeks where old."""
    recent = daily.where(F.to_date("observed_at") >= F.date_sub(F.lit(today).cast("date"), days)).withColumn("day", F.to_date("observed_at"))
    best = pick.distinct_on(recent, ["print_id", "source", "finish", "day"], [language_rank(c("lang"), lang).asc(), c("lang").asc()])
    return pricing.thin_history(best, ["print_id", "source", "finish", "currency"], "day", today)


#: Statuses of a ban list.
BAN_STATUSES = {"Forbidden": "forbidden", "Limited": "limited", "Semi-Limited": "semi-limited"}


def _status(column: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in BAN_STATUSES.items() for x in kv)), column)


def banlist(cards: DataFrame, fmt: str) -> DataFrame:
    """id, name, status: the cards that a format restricts."""
    status = F.try_element_at("legalities", F.lit(fmt))
    return cards.select("id", "name", status.alias("status")).where(c("status").isin(*BAN_STATUSES))


def banlist_changes(changes: DataFrame, fmt: str, since: str) -> DataFrame:
    """Changes since a time that aren't the same status under another spelling; no status counts as unlimited."""
    known = lambda x: F.coalesce(c(x), F.lit("Unlimited"))
    return changes.where((c("format") == fmt) & (c("seen_at") >= F.lit(since).cast("timestamp")) & (known("from_status") != known("to_status")))


def banlist_impact(cards: DataFrame, changes: DataFrame, collection: DataFrame, prints: DataFrame, deck_entries: DataFrame, fmt: str, since: str) -> DataFrame:
    """kind (collection or deck), owner, card_id, copies, allowed, changed: owned cards with a change; deck cards with one, or over the limit."""
    last = latest(banlist_changes(changes, fmt, since).select("card_id", "from_status", "to_status", "seen_at", "id"), ["card_id"], "seen_at", "id").select("card_id", c("seen_at").alias("changed"))
    status = cards.select(c("id").alias("card_id"), ban_limit(_status(F.try_element_at("legalities", F.lit(fmt)))).alias("_limit"), F.try_element_at("legalities", F.lit(fmt)).isNotNull().alias("_listed"))
    limit = F.coalesce("_limit", F.when(c("_listed"), 3))
    owned = collection.join(prints.select(c("id").alias("print_id"), "card_id"), "print_id").groupBy(c("user_id").alias("owner"), "card_id").agg(F.sum("quantity").cast("long").alias("copies")).join(last, "card_id")
    used = deck_entries.groupBy(c("deck_id").alias("owner"), "card_id").agg(F.sum("quantity").cast("long").alias("copies")).join(last, "card_id", "left")
    shape = lambda df, kind: df.join(status, "card_id").select(F.lit(kind).alias("kind"), "owner", "card_id", "copies", limit.alias("allowed"), "changed")
    return shape(owned, "collection").unionByName(shape(used, "deck").where(c("changed").isNotNull() | (c("copies") > c("allowed"))))


def collection_rows(k: Catalog, entries: DataFrame, typed: str | None = None, **filters) -> DataFrame:
    """Entries with their print, card and set; filtered by columns, and by a text that the name, set or number holds."""
    prints = k.prints.select(c("id").alias("print_id"), "card_id", "set_id", "number", "finishes")
    cards = k.cards.select(c("id").alias("card_id"), "name", "game_id")
    sets = k.sets.select(c("id").alias("set_id"), c("code").alias("set_code"), c("name").alias("set_name"))
    rows = entries.join(dealt(prints), "print_id").join(dealt(cards), "card_id").join(sets, "set_id")
    rows = pick.optional_filters(rows, [c(x) == v for x, v in filters.items() if v is not None])
    if not typed:
        return rows
    holds = lambda x: F.lower(x).contains(typed.lower())
    local = k.print_localizations.where(holds(c("name"))).select("print_id").distinct().withColumn("_local", F.lit(True))
    return rows.join(local, "print_id", "left").where(holds(c("name")) | (F.lower("set_code") == typed.lower()) | (F.lower("number") == typed.lower()) | F.coalesce("_local", F.lit(False))).drop("_local")


def collection_summary(k: Catalog, entries: DataFrame, currency: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """By the keys: copies, entries and unpriced copies; and what they are worth by source and currency."""
    held = collection_rows(k, entries).withColumnRenamed("id", "entry_id").withColumnRenamed("language", "lang")
    prices = k.prices.select("print_id", "finish", "source", "lang", "currency", c("cents_market").alias("market"), "observed_at")
    priced = pricing.entry_price(held, prices, ["print_id"], currency)
    return pricing.summary(priced, keys), pricing.totals(priced, keys)


def deck_analysis(k: Catalog, deck_entries: DataFrame, owned: DataFrame, zones: DataFrame, limit: Column, currency: str) -> tuple[DataFrame, DataFrame]:
    """Problems of each deck (sizes, zones, copies), and its missing cards with the cheapest print."""
    cards = deck_entries.join(dealt(k.cards.select(c("id").alias("card_id"), "name", "type_line", "text", "legalities")), "card_id")
    code = lambda df, name: df.select("deck_id", F.lit(name).alias("code"), "name", "n")
    sizes = lists.size_problems(cards, zones, ["deck_id"]).select("deck_id", "code", c("zone").alias("name"), "n")
    strays = lists.zone_problems(cards, zones).select("deck_id", "name", c("quantity").cast("long").alias("n"))
    copies = lists.copy_problems(cards, ["deck_id"], limit)
    problems = sizes.unionByName(code(strays, "wrong_zone")).unionByName(code(copies, "too_many_copies"))
    have = owned.join(dealt(k.prints.select(c("id").alias("print_id"), "card_id")), "print_id").join(dealt(k.cards.select(c("id").alias("card_id"), "name")), "card_id")
    missing = lists.missing_cards(cards, have, ["deck_id"])
    prices = k.prices.join(dealt(k.prints.select(c("id").alias("print_id"), "card_id")), "print_id").join(dealt(k.cards.select(c("id").alias("card_id"), "name")), "card_id").withColumnRenamed("cents_market", "market")
    return problems, missing.join(pricing.cheapest(prices, ["name"], currency), "name", "left")
