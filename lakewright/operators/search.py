"""Search: boolean token queries, codes, trigrams and tiered suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.text import TRIGRAM_LEAST, contains_phrase, contains_prefix, similarity, trigrams
from lakewright.sources.tables import dealt


@dataclass
class TokenQuery:
    """Alternatives of terms that must all hold: (words, negated, prefix). A typed query, not a language of its own."""

    alternatives: list[list[tuple[list[str], bool, bool]]] = field(default_factory=list)

    @classmethod
    def of(cls, typed: str) -> TokenQuery:
        """Words must all occur, "phrases" in order, -words not; "or" separates alternatives; the last word is a prefix."""
        found = re.findall(r'-?"[^"]*"|\S+', typed.lower())
        parts: list[list[tuple[list[str], bool, bool]]] = [[]]
        for k, t in enumerate(found):
            if t == "or" and parts[-1] and k < len(found) - 1:
                parts.append([])
                continue
            negated, quoted = t.startswith("-"), '"' in t
            words = re.findall(r"[^\W_]+", t)
            if words:
                parts[-1].append((words, negated, k == len(found) - 1 and not negated and not quoted))
        return cls([p for p in parts if p])

    def matches(self, words: Column) -> Column:
        def term(ws: list[str], negated: bool, prefix: bool) -> Column:
            if prefix:
                head = [F.array_contains(words, w) for w in ws[:-1]]
                hit = reduce(lambda a, b: a & b, [*head, contains_prefix(words, ws[-1])])
            else:
                hit = F.array_contains(words, ws[0]) if len(ws) == 1 else contains_phrase(words, ws)
            return ~hit if negated else hit

        every = [reduce(lambda a, b: a & b, (term(*t) for t in p)) for p in self.alternatives]
        return reduce(lambda a, b: a | b, every) if every else F.lit(False)

    @property
    def fuzzy(self) -> bool:
        """Typos are only looked for in plain queries."""
        return len(self.alternatives) == 1 and not any(n or len(w) > 1 for w, n, _ in self.alternatives[0])


def token_search(rows: DataFrame, typed: str, name_words: Column, all_words: Column) -> DataFrame:
    """Matching rows with a score: 1 for a hit in the name, plus the share of the words that are query words."""
    q = TokenQuery.of(typed)
    asked = sorted({w for p in q.alternatives for ws, negated, _ in p for w in ws if not negated})
    hits = F.size(F.filter(all_words, lambda w: reduce(lambda a, b: a | b, (w.startswith(x) for x in asked)) if asked else F.lit(False)))
    score = F.when(q.matches(name_words), 1.0).otherwise(0.0) + F.round(hits / F.greatest(F.size(all_words), F.lit(1)), 6)
    return rows.where(q.matches(all_words)).withColumn("score", score)


def trigram_postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key: written once, it answers any number of queries."""
    return rows.select(F.explode(trigrams(F.col(text))).alias("gram"), key)


def fuzzy_search(rows: DataFrame, postings: DataFrame, key: str, text: str, typed: str, *, candidates: int = 500, share: float = 0.2, least: float = TRIGRAM_LEAST) -> DataFrame:
    """Rows whose text is similar to a typed one, best first. Grams that more than a share of the rows have don't look for candidates."""
    spark = rows.sparkSession
    asked = spark.range(1).select(F.explode(trigrams(F.lit(typed))).alias("gram"))
    hits = postings.join(F.broadcast(asked), "gram")
    per_gram = hits.groupBy("gram").agg(F.count("*").alias("n"))
    total = rows.count()
    informative = per_gram.where(F.col("n") <= max(1, int(share * total))).select("gram")
    found = hits.join(F.broadcast(informative), "gram").groupBy(key).agg(F.count("*").alias("shared"))
    top = found.orderBy(F.desc("shared"), key).limit(candidates)
    near = rows.join(F.broadcast(top.select(key)), key).withColumn("similarity", similarity(trigrams(F.col(text)), trigrams(F.lit(typed))))
    return near.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key)


def similar_names(postings: DataFrame, key: str, text: str, typed: str, least: float = TRIGRAM_LEAST) -> DataFrame:
    """key and similarity of all keys whose text is as similar to a typed one as `least`, looked up in an index.

    postings: gram, key, size (the number of the key's grams), as `sized_postings` makes them. The similarity of two
    sets follows from their sizes and what they share, so no text is read: an index stored in order of its grams is
    read only where the typed ones are.
    """
    grams = F.size(trigrams(F.lit(typed)))
    asked = postings.sparkSession.range(1).select(F.explode(trigrams(F.lit(typed))).alias("gram"))
    shared = postings.join(F.broadcast(asked), "gram").groupBy(key, "size").agg(F.count("*").alias("_n"))
    alike = (F.col("_n") / (F.col("size") + grams - F.col("_n"))).cast("float")
    return shared.select(key, alike.alias("similarity")).where(F.col("similarity") >= F.lit(least).cast("float"))


def sized_postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key, size: each key's grams, once, in order of the grams for an index that is written."""
    held = rows.select(key, trigrams(F.col(text)).alias("_g")).distinct()
    return held.select(F.explode("_g").alias("gram"), key, F.size("_g").alias("size"))


def rare_grams(rows: DataFrame, key: str, grams: Column, frequency: DataFrame, least: float) -> DataFrame:
    """key, gram: so many of each row's rarest grams that two rows as similar as `least` share one of them."""
    ranked = rows.select(key, F.explode(grams).alias("gram")).join(dealt(frequency), "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("_g"))
    n = F.size("_g")
    few = F.slice("_g", 1, (n - F.ceil(n * least - 1e-6) + 1).cast("int"))
    return ranked.select(key, F.explode(F.transform(few, lambda g: g["gram"])).alias("gram"))


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, least: float = TRIGRAM_LEAST) -> DataFrame:
    """left_key, right_key, similarity: rows that share a rare trigram, then the exact similarity.

    Two sets that share `least` of their union share one of their rarest grams, so frequent grams are not joined on. Each
    different text is compared once, however many rows have it.
    """
    own = lambda df, key, text, name: df.select(key, F.col(text).alias(name)).where(F.col(name).isNotNull())
    rows_a, rows_b = own(left, left_key, left_text, "_a"), own(right, right_key, right_text, "_b")
    a, b = rows_a.select("_a").distinct(), rows_b.select("_b").distinct()
    grams_a, grams_b = trigrams(F.col("_a")), trigrams(F.col("_b"))
    frequency = a.select(F.explode(grams_a).alias("gram")).unionAll(b.select(F.explode(grams_b).alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    near = rare_grams(a, "_a", grams_a, frequency, least).join(dealt(rare_grams(b, "_b", grams_b, frequency, least)), "gram").select("_a", "_b").distinct()
    alike = near.withColumn("similarity", similarity(grams_a, grams_b)).where(F.col("similarity") >= least)
    return alike.join(dealt(rows_a), "_a").join(dealt(rows_b), "_b").select(left_key, right_key, "similarity")


def suggest(tiers: list[DataFrame], entity: list[str], limit: int) -> DataFrame:
    """The best suggestions over tiers (in order of preference; each with `ord` and the same columns), each entity once."""
    rows = reduce(DataFrame.unionByName, (t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers)))
    rest = [c for c in rows.columns if c not in entity]
    best = rows.groupBy(*entity).agg(F.min_by(F.struct(*rest), F.struct("tier", "ord")).alias("_b")).select(*entity, "_b.*")
    return best.orderBy("tier", "ord", *entity).limit(limit)
