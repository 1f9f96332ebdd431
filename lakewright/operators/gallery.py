"""Prints against galleries and lists: which picture, rarity and code belongs to which print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.text import number_key

from .pick import distinct_on

c = F.col

#: Foil tiers by abbreviation; a rarity that isn't listed has a tier of its own.
FOIL_TIERS = {"C": 0, "NR": 0, "SP": 0, "SSP": 0, "R": 0, "SR": 0, "UR": 0, "ScR": 0, "UtR": 1, "CR": 2, "StR": 3, "QCScR": 4, "PlScR": 5, "PScR": 6, "GUR": 7, "GR": 8, "GMR": 9}
#: Rarities printed with an artwork of their own, and its code in the other rarities.
OWN_ARTWORK = {"GMR": "EA"}
#: Finishes that are foil in every game.
FOIL_FINISHES = ["foil", "etched", "holo", "reverse", "first_edition_holo"]


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def tier(rarity: Column) -> Column:
    return lookup(FOIL_TIERS, rarity)


def scan_backs(sibling: Column, rarity: Column) -> Column:
    """Whether a scan in one rarity may stand in for another: its own always, else one from a plainer tier; plain ones for plain and unlisted rarities too."""
    highest = F.greatest(F.coalesce(tier(rarity), F.lit(0)) - 1, F.lit(0))
    return F.coalesce(sibling == rarity, F.lit(False)) | F.coalesce(tier(sibling) <= highest, F.lit(False))


def is_foil(game: Column, rarity: Column, finish: Column, extended: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(rarity, F.lit(""))))
    by_game = F.when(game == "yugioh", r.rlike("rare|foil|secret|parallel")).when(game == "pokemon", (r != "") & ~r.isin("common", "uncommon", "rare", "none")).otherwise(False)
    return F.coalesce(extended, F.lit(False)) | F.coalesce(finish, F.lit("normal")).isin(FOIL_FINISHES) | by_game


def region_free(number: Column) -> Column:
    """A print number without the token of its region."""
    return F.regexp_replace(number, "^(EN|DE|FR|IT|SP|PT|E|G|F|I|S|P)(?=[A-Z]*[0-9])", "")


def pick_pages(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """key, title: the page of each card among those with its password: the one of its name, else one with a German name, else the first.

    pages: pos, title, passwords, langs (of its localizations); cards: key, name.
    """
    held = pages.where(F.size("langs") > 0).select("pos", "title", "langs", F.explode("passwords").alias("key"))
    order = [(c("title") != c("name")).asc(), (~F.array_contains("langs", "de")).asc(), c("pos").asc()]
    return distinct_on(held.join(cards, "key"), ["key"], order).select("key", "title")


def localized_cards(entries: DataFrame, cards: DataFrame) -> DataFrame:
    """card_id, entry: an entry's own id, else an artwork's id whose card has the entry's English name.

    entries: entry, image_ids, name_en; cards: card_id, key, name. A card matched by its own id takes no other entry;
    of several entries that fall back to one card the least counts.
    """
    keyed = cards.select("card_id", c("key").cast("long").alias("_key"), "name")
    own = entries.join(keyed, c("entry") == c("_key")).select("card_id", "entry")
    rest = entries.join(own.select("entry"), "entry", "left_anti").select("entry", "name_en", F.posexplode("image_ids").alias("pos", "_image"))
    free = keyed.join(own.select("card_id"), "card_id", "left_anti")
    hits = rest.join(free, (c("_image") == c("_key")) & (c("name_en") == c("name")))
    fallback = hits.groupBy("entry").agg(F.min_by("card_id", "pos").alias("card_id")).groupBy("card_id").agg(F.min("entry").alias("entry"))
    return own.unionByName(fallback)


def gallery_numbers(rows: DataFrame) -> DataFrame:
    """rows (set, lang, pos, code, rarity, alt, file) with their number without region; the best page's come first by pos."""
    return rows.withColumn("_number", region_free(F.upper(F.regexp_replace("code", "^.*-", ""))))


def resolve_rarities(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """print_id, rarity, alt: for the only print of a number without a rarity, the only row that no other print has.

    prints: print_id, set, lang, number, rarity (null: unknown), alt.
    """
    keyed = prints.withColumn("_number", region_free(F.upper("number")))
    on = ["set", "lang", "_number"]
    held = gallery_numbers(rows).groupBy(*on, "rarity", "alt").agg(F.min("pos").alias("pos"))
    first = distinct_on(held, [*on, "rarity"], [c("pos").asc()]).select(*on, "rarity", c("alt").alias("_first"))
    taken = keyed.where("rarity IS NOT NULL").join(first, [*on, "rarity"], "left").select(*on, "rarity", F.coalesce("alt", "_first").alias("alt")).where("alt IS NOT NULL")
    unknown = keyed.where("rarity IS NULL").withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where("_n = 1")
    free = held.join(taken, [*on, "rarity", "alt"], "left_anti").groupBy(*on).agg(F.count("*").alias("_free"), F.min(F.struct("rarity", "alt")).alias("_row")).where("_free = 1")
    return unknown.join(free, on).select("print_id", c("_row.rarity").alias("rarity"), c("_row.alt").alias("alt"))


def plan_artworks(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """print_id, lang, alt, own_art, files, siblings: files to try for each print and language, best first.

    prints: print_id, set, number, rarity, alt, artworks (how many its card has), langs. A shown artwork may fall back
    to the same artwork in a rarity that may stand in for it, plainest first.
    """
    numbered = gallery_numbers(rows)
    p = prints.where("rarity IS NOT NULL").withColumn("_number", region_free(F.upper("number"))).withColumnRenamed("rarity", "_rarity").withColumnRenamed("alt", "_alt")
    several = numbered.where("alt != ''").select("set", "_number").distinct().withColumn("_coded", F.lit(True))
    p = p.join(several, ["set", "_number"], "left").where((c("artworks") > 1) | c("_coded")).withColumn("lang", F.explode(F.array_union(F.array(F.lit("en")), "langs")))
    hits = p.join(numbered, ["set", "_number", "lang"])
    same = (c("rarity") == c("_rarity")) & (c("_alt").isNull() | (c("alt") == c("_alt")))
    shown = distinct_on(hits.where(same), ["print_id", "lang"], [c("pos").asc()]).select("print_id", "lang", c("alt").alias("_shown"))
    art = lambda rarity, alt: F.coalesce(F.nullif(alt, F.lit("")), lookup(OWN_ARTWORK, rarity), F.lit(""))
    own_art = (c("_shown") == "") & lookup(OWN_ARTWORK, c("_rarity")).isNotNull()
    both = hits.join(shown, ["print_id", "lang"]).withColumn("own_art", own_art)
    own = (c("rarity") == c("_rarity")) & (c("alt") == c("_shown"))
    backs = ((c("_shown") != "") | c("own_art")) & (c("rarity") != c("_rarity")) & (art(c("rarity"), c("alt")) == art(c("_rarity"), c("_shown"))) & scan_backs(c("rarity"), c("_rarity"))
    packed = lambda keep, rank: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(rank.alias("a"), "pos", "file")))), lambda x: x["file"]))
    # A number has a handful of rows in a language's galleries.
    out = both.groupBy("print_id", "lang", c("_shown").alias("alt"), "own_art")
    return out.agg(packed(own, F.lit(0)).alias("files"), packed(backs, F.coalesce(tier(c("rarity")), F.lit(99))).alias("siblings"))


def plan_codes(prints: DataFrame, codes: DataFrame) -> DataFrame:
    """print_id, lang, code: each localization's printed code by the set's lists; null where the lists say that it has none.

    prints: print_id, set, number, langs; codes: set, lang, pos, code (null: a page without rows, so the language is
    unknown; an unknown English page leaves the set alone). Another set's codes count only in a language without ours,
    in sets whose English rows are all ours.
    """
    parts = codes.withColumn("_ours", F.lower(F.regexp_replace("code", "-[^-]*$", "")) == F.lower("set")).withColumn("_number", region_free(F.upper(F.regexp_replace("code", "^.*-", ""))))
    known = parts.groupBy("set", "lang").agg(F.max(c("code").isNotNull()).alias("_known"), F.max(F.coalesce("_ours", F.lit(False))).alias("_any"), F.min(F.coalesce("_ours", F.lit(True))).alias("_all"))
    english = known.where("lang = 'en'").select("set", c("_known").alias("_en"), c("_all").alias("_alone"))
    rows = parts.where("code IS NOT NULL").join(known.drop("_known", "_all"), ["set", "lang"]).join(english, "set", "left")
    rows = rows.where(c("_ours") | (F.coalesce(c("_alone") & c("_en"), F.lit(False)) & ~c("_any")))
    best = distinct_on(rows, ["set", "_number", "lang"], [c("pos").asc()]).select("set", "_number", "lang", "code")
    numbers = best.select("set", "_number").distinct()
    p = prints.withColumn("_number", region_free(F.upper("number"))).join(numbers, ["set", "_number"], "left_semi").join(english.select("set", "_en"), "set", "left").where(F.coalesce("_en", F.lit(True)))
    asked = p.withColumn("lang", F.explode("langs")).join(known.where("NOT _known").select("set", "lang"), ["set", "lang"], "left_anti")
    return asked.join(best, ["set", "_number", "lang"], "left").select("print_id", "lang", "code")


def fold_variants(prints: DataFrame) -> DataFrame:
    """card_id, set, number, variant, code, variants: language variants folded into the English print of their number and variant.

    prints: pos, card_id, set, number, english_number (of a variant, else null), variant, code.
    """
    own = prints.where("english_number IS NULL").select("card_id", "set", c("number").alias("english_number"), "variant").distinct().withColumn("_folds", F.lit(True))
    marked = prints.join(own, ["card_id", "set", "english_number", "variant"], "left").withColumn("_folds", F.coalesce("_folds", F.lit(False)))
    keyed = marked.withColumn("number", F.when(c("_folds"), c("english_number")).otherwise(c("number")))
    code = F.min_by("code", F.when(~c("_folds"), c("pos")))
    return keyed.groupBy("card_id", "set", "number", "variant").agg(code.alias("code"), F.array_sort(F.collect_set(F.when(c("_folds"), c("code")))).alias("variants"))


#: Fixed value: names of products that differ only by their artwork end so.
ARTWORK = r"(?i)\s+\((?:[^()]*\bArtwork|Alternate Art)\)$"


def pick_artwork(products: DataFrame) -> DataFrame:
    """key, product: of products that differ only by artwork, the one for a print: another artwork if the print has its code, else the original.

    products: key, product, name, alt_art (whether the print has another artwork's code). Keys whose names differ
    otherwise, or with several bare names or several other artworks to choose from, have none.
    """
    one = products.groupBy("key").agg(*artwork_sums(c("product"), c("name")), F.max("alt_art").alias("alt_art"))
    return one.select("key", artwork_of(c("alt_art")).alias("product")).where("product IS NOT NULL")


#: How sums over some products' names become sums over all of them.
ARTWORK_SUMS = {"n": F.sum, "n_bare": F.sum, "n_other": F.sum, "b0": F.min, "b1": F.max, "other": F.min, "original": F.min}


def artwork_sums(product: Column, name: Column) -> list[Column]:
    """What the artwork rule asks of a group of products; sums of parts of a group can be added up by `ARTWORK_SUMS`."""
    original, bare = name.rlike(r"(?i)\(Original Artwork\)$"), ~name.rlike(ARTWORK)
    other, base = ~bare & ~original, F.lower(F.regexp_replace(name, ARTWORK, ""))
    rank = F.struct(F.when(original, 0).when(bare, 1).otherwise(2).alias("r"), product.alias("product"))
    return [F.count("*").alias("n"), F.count_if(bare).alias("n_bare"), F.count_if(other).alias("n_other"), F.min(base).alias("b0"), F.max(base).alias("b1"), F.min(F.when(other, product)).alias("other"), F.min(rank).alias("original")]


def artwork_of(alt_art: Column) -> Column:
    """The product that a print takes of a group with these sums, or null."""
    chosen = F.when(alt_art & (c("n_other") > 0), F.when(c("n_other") == 1, c("other"))).otherwise(c("original")["product"])
    return F.when((c("n") > 1) & (c("b0") == c("b1")) & (c("n_bare") < 2), chosen)


def regional_matches(prints: DataFrame, products: DataFrame, claimed: DataFrame) -> DataFrame:
    """print_id, product: prints that no product claimed, each to the one product of its name and rarity; of several, the English one.

    prints: print_id, set, number, name, rarity; products: product, number, name, rarity.
    """
    rest = prints.join(claimed.select("print_id"), "print_id", "left_anti").where(F.regexp_replace("number", "^.*-", "").rlike("^(A|E|AE)?[0-9]"))
    hits = rest.join(products.select("product", c("number").alias("_number"), "name", "rarity"), ["name", "rarity"])
    english = F.regexp_replace("_number", "^.*-", "").startswith("EN")
    sized = hits.withColumn("_n", F.count("*").over(Window.partitionBy("print_id"))).where((c("_n") == 1) | english)
    digits = lambda x: number_key(F.regexp_replace(x, "^.*-", ""))
    again = sized.withColumn("_m", F.count("*").over(Window.partitionBy("print_id"))).where((c("_m") == 1) | (digits("_number") == digits("number")))
    return again.withColumn("_k", F.count("*").over(Window.partitionBy("print_id"))).where("_k = 1").select("print_id", "product")
