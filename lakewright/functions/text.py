"""Text keys, tokens and trigram similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRIGRAM_LEAST = 0.3


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def code_key(x: Column) -> Column:
    """Lower case, letters and digits only, runs of digits without leading zeros: "OP-007b" and "op7B" are one."""
    return F.regexp_replace(alnum(x), "(^|[^0-9])0+([0-9])", "$1$2")


def number_key(x: Column) -> Column:
    """A collector number without separators, a prefix of one or two letters, or leading zeros; null if nothing is left."""
    bare = F.regexp_replace(alnum(x), "^[a-z]{1,2}([0-9])", "$1")
    return F.nullif(F.regexp_replace(bare, "^0+([0-9a-z])", "$1"), F.lit(""))


def numeric_part(x: Column) -> Column:
    """The digits before the first other character, as an integer, else null."""
    return F.nullif(F.regexp_replace(x, "[^0-9].*$", ""), F.lit("")).try_cast("int")


def english_code(x: Column, tokens: tuple[str, ...] = ("de", "fr", "it", "pt", "sp", "es", "jp", "ja")) -> Column:
    """A language token at the start of a printed code, before digits or the end, becomes "en"."""
    return F.regexp_replace(x, f"^({'|'.join(tokens)})(?=[0-9]|$)", "en")


def tokens(*columns: Column) -> Column:
    """The lower-case words of the columns, in order."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(x: Column) -> Column:
    """The distinct trigrams of each word, padded with two blanks before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays, in single precision."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both).cast("float")


def collated(x: Column, locale: str = "UNICODE", *, case: bool = False, accents: bool = False) -> Column:
    """A text that sorts, groups and compares as a locale does (UNICODE: the root locale); case and accents only count if asked for.

    Without it text is compared by its bytes, which is the order of files and keys.
    """
    return F.collate(x, f"{locale}{'_CS' if case else '_CI'}{'_AS' if accents else '_AI'}")


def contains_prefix(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: w.startswith(prefix))


def contains_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words stand next to each other in this order."""
    wanted = F.array(*(F.lit(w) for w in phrase))
    last = F.size(words) - len(phrase)
    return F.when(last < 0, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.slice(words, i, len(phrase)) == wanted))


def plain_name(name: str | None) -> str | None:
    """A name for comparing: decomposed, without marks, lower-case, "&" read as "and", letters and digits only."""
    if name is None:
        return None
    flat = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return "".join(c for c in flat.lower().replace("&", " and ") if c.isalnum())


def norm_name():
    """An Arrow-batched `plain_name`; Spark has no built-in decomposition."""

    @F.pandas_udf("string")
    def norm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(plain_name, na_action="ignore")

    return norm


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def like_literal(x: str) -> str:
    """A text for LIKE with its own wildcards escaped."""
    return x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def url_component(x: Column) -> Column:
    """Percent-encoding with %20 for blanks."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def char_of(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def decoded_numbers(x: Column) -> Column:
    """Numeric character references as characters."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    code = lambda e: F.when(F.lower(e).startswith("x"), F.conv(F.substr(e, F.lit(2)), 16, 10)).otherwise(e)
    return F.aggregate(found, x, lambda acc, e: F.replace(acc, F.concat(F.lit("&#"), e, F.lit(";")), char_of(code(e))))


def plain_wikitext(x: Column) -> Column:
    """Wikitext without breaks, links, quotes and tags; character references decoded once."""
    for pattern, to in (
        (r"(?i)<br\s*/?>", "\n"), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), ("'{2,}", ""), (r"(?i)</?[a-z][^>]*>", ""),
    ):
        x = F.regexp_replace(x, pattern, to)
    x = decoded_numbers(x)
    for pattern, to in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&apos;", "'"), ("(?i)&amp;", "&")):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(F.regexp_replace(x, r"[ \t]+\n", "\n"))


def parse_cents(x: Column) -> Column:
    """A typed price like "1.234,50" or "1,234.50" in cents; the last separator before one or two digits is the decimal one."""
    bare = F.regexp_replace(x, r"[^0-9.,]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,]([0-9]{1,2})$", ""), "[.,]", "")
    part = F.rpad(F.regexp_extract(bare, r"[.,]([0-9]{1,2})$", 1), 2, "0")
    return F.when(bare.rlike("[0-9]"), F.concat(F.when(whole == "", "0").otherwise(whole), part).try_cast("long"))


def joined_faces(faces: Column, field: str, separator: str) -> Column:
    """A field of all faces of a card that have it; null if none has."""
    held = F.filter(F.transform(F.coalesce(faces, F.array()), lambda f: f[field]), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.array_join(held, separator))


def rules_text(abilities: Column, attacks: Column, effect: Column) -> Column:
    """A card's abilities (type, name, effect), attacks (name, damage, effect) and effect, one a line; null without any."""
    after = lambda lead, x: F.coalesce(F.concat(F.lit(lead), F.nullif(x.cast("string"), F.lit(""))), F.lit(""))
    kind = lambda x: F.coalesce(F.concat(F.nullif(x["type"], F.lit("")), F.lit(" ")), F.lit(""))
    told = F.transform(F.coalesce(abilities, F.array()), lambda a: F.concat(kind(a), a["name"], after(": ", a["effect"])))
    fought = F.transform(F.coalesce(attacks, F.array()), lambda a: F.concat(a["name"], after(" ", a["damage"]), after(": ", a["effect"])))
    lines = F.concat(told, fought, F.when(F.length(effect) > 0, F.array(effect)).otherwise(F.array()))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
