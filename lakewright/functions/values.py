"""Money, ranks, dates, hashes, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Estimated share of the near-mint price by condition. Mint has a factor of its own.
CONDITION_FACTORS = {"MT": 1.05, "NM": 1.0, "EX": 0.85, "GD": 0.7, "LP": 0.6, "PL": 0.45, "PO": 0.3}
#: Price sources in the order in which a user of a currency sees them.
SOURCE_ORDER = {
    "EUR": ["cardmarket", "tcgplayer", "tcgplayer_scryfall"],
    "USD": ["tcgplayer", "tcgplayer_scryfall", "cardmarket"],
}


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def cents(amount: Column) -> Column:
    return round_half_up(amount * 100)


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole to some places; null where the whole is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), places)


def preference(x: Column, order: list) -> Column:
    """0 for the first of the order, and so on; the order's length for anything else."""
    rank = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        rank = F.when(x == order[k], k).otherwise(rank)
    return rank


def language_rank(lang: Column, wanted: Column | str) -> Column:
    """The wanted language, then English, then any."""
    return F.when(lang == wanted, 0).when(lang == "en", 1).otherwise(2)


def position(values: Column, x: Column) -> Column:
    """Where x stands, from 1; null, not 0, where it doesn't."""
    return F.nullif(F.array_position(values, x), F.lit(0))


def finish_rank(finish: Column, finishes: Column, asked: Column | None = None) -> Column:
    """Asked for, then "normal" if listed (else the first listed), then the listed ones in order, then others.

    A print that lists no finish counts as listing "normal".
    """
    listed = F.when(F.size(finishes) > 0, finishes).otherwise(F.array(F.lit("normal")))
    main = F.when(F.array_contains(listed, "normal"), F.lit("normal")).otherwise(F.get(listed, F.lit(0)))
    rank = F.when(finish == main, 1).otherwise(1 + F.coalesce(position(listed, finish), F.lit(1000))).cast("long")
    return rank if asked is None else F.when(finish == asked, F.lit(0).cast("long")).otherwise(rank)


def condition_factor(condition: Column, own: Column | None = None) -> Column:
    """Mint's fixed factor, else the game's own, else the default, else 1."""
    known = F.create_map(*(F.lit(x) for kv in CONDITION_FACTORS.items() for x in kv))
    default = F.coalesce(F.try_element_at(known, condition), F.lit(1.0))
    return F.when(condition == "MT", F.lit(CONDITION_FACTORS["MT"])).otherwise(default if own is None else F.coalesce(own, default))


def week_number(day: Column) -> Column:
    """Weeks since the one of 1970-01-01, beginning on Mondays."""
    return F.floor((F.datediff(day, F.lit("1970-01-01").cast("date")) + 3) / 7).cast("long")


def later_than(now: Column, before: Column) -> Column:
    """A time stamp that never goes back: now, or a millisecond after the one before."""
    return F.greatest(F.date_trunc("MILLISECOND", now), F.date_trunc("MILLISECOND", before) + F.expr("INTERVAL 0.001 SECOND"))


def fnv1a(x: Column) -> Column:
    """The 32-bit hash of an ASCII text."""
    bytes_ = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(bytes_, F.lit(2166136261).cast("long"), step)


def rotates(key: Column, day: Column, period: int = 30) -> Column:
    """Whether a key's turn comes on that day: each key has one day in every period."""
    return fnv1a(key) % period == F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(period))


def stable_hash(m: Column) -> Column:
    """A SHA-256 of a map that doesn't depend on the order of its entries."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(m))), 256)


def has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, MapType) or (isinstance(kind, StructType) and any(has_map(f.dataType) for f in kind.fields))


def comparable(x: Column, kind: DataType) -> Column:
    """A value that Spark can compare, group and hash: maps become arrays of their entries in order of the keys."""
    if not has_map(kind):
        return x
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: comparable(e, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(comparable(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    entry = lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(x), entry))


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both; the new one's win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def owned_merge(old: Column, new: Column, owned: list[str]) -> Column:
    """The new map, but with the old values of keys that another writer owns."""
    kept = F.map_filter(old, lambda k, _: k.isin(owned))
    return F.map_concat(F.map_filter(new, lambda k, _: ~k.isin(owned)), kept)


def without_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(keys))


def only_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(keys))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def csv_field(x: Column) -> Column:
    """Quoted only if it must be; quotes inside are doubled; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *(csv_field(c) for c in columns))


def ban_limit(status: Column) -> Column:
    """Copies allowed by a list's status; null where there is none."""
    return F.when(status == "forbidden", 0).when(status == "limited", 1).when(status == "semi-limited", 2).when(status.isNotNull(), 3)


def image_url(base: Column, key: Column, source: Column) -> Column:
    return F.coalesce(F.when(key.isNotNull(), F.concat(base, F.lit("/"), key)), source)


def first_keyword(text: Column, ordered: list[str], other: str) -> Column:
    """The first of an ordered list of words that the text holds."""
    return F.coalesce(*(F.when(F.lower(text).contains(w.lower()), F.lit(w)) for w in ordered), F.lit(other))


def least_cost(attacks: Column) -> Column:
    """The fewest entries of `cost` over an array of attacks; null without attacks."""
    return F.array_min(F.transform(attacks, lambda a: F.size(a["cost"])))


def printed_limit(text: Column, default: int) -> Column:
    """The number of copies that a card's own text allows, else the default; "any number" has no limit."""
    words = ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    found = F.regexp_extract(F.lower(text), r"deck can have up to (\w+) cards named", 1)
    number = F.create_map(*(F.lit(x) for k, w in enumerate(words) for x in (w, k + 2)))
    return F.when(F.lower(text).contains("a deck can have any number of cards named"), F.lit(None).cast("int")).otherwise(F.coalesce(F.try_element_at(number, found), F.lit(default)))


def offset_time(text: Column) -> Column:
    """A time stamp from a text with an offset without a colon (2024-01-31T20:05:00+0000); null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssxx"))


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that depends on its parts alone, so a run that is repeated gives the same one."""
    h = F.md5(F.to_json(F.array(*(p.cast("string") for p in parts))))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def records(text: Column, schema: str) -> Column:
    """The objects of a JSON array, as an array of structs for `inline`."""
    return F.from_json(text, f"array<struct<{schema}>>")
