"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain on each text. Expectation-maximisation over the counted vote patterns (at most
3**len(RULES) rows, however many texts there are) estimates how reliable each rule is; a text is kept when its
posterior probability of being good is high enough and the base rules hold.

Cases: a null or empty text has no words, so the base rules fail it; repeated rows are judged each on its own;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, table

SPACE = r"[\x20\x09-\x0D]"
GOOD, BAD, ABSTAIN = 1, 0, 2
ROUNDS = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are sorted by hash, so equal ones are neighbours: n log n for a text of n words.
    """

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def twice(windows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(windows, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(windows, k + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(windows, same), lambda x: x["i"]))

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: covered(twice(s))))

    return count(ws)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at.

    Runs of characters are dropped from ever shorter texts, and what is left is counted, so few pieces are copied.
    """
    dropped = lambda text, pattern: F.regexp_replace(text, pattern, "")
    size = lambda text: F.length(text).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    words = let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    read = docs.select("doc_id", words.alias("words"), duplicate_lines(text).alias("n_dup_lines"), dropped(text, SPACE + "+").alias("body"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))
    split = read.select("*", dropped(F.col("body"), r"\p{L}+").alias("others"), dropped(F.col("body"), r"[^\p{Lu}]+").alias("upper"))
    others = F.col("others")
    return split.select(
        "doc_id",
        F.col("words.n").alias("n_words"),
        size("body").alias("word_chars"),
        size(dropped(others, "[^#*$%&|<>]+")).alias("n_symbols"),
        "n_dup_lines",
        F.col("words.repeated").alias("n_repeat_words"),
        (size("body") - size(others)).alias("letters"),
        size("upper").alias("capitals"),
        size(dropped(others, "[^.!?]+")).alias("ends"),
        size(dropped(others, "[^!]+")).alias("cries"),
        "breaks",
    )


def band(x: Column, good: Column, bad: Column) -> Column:
    return F.when(x.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> list[tuple[str, Column]]:
    """Each rule's vote, by shares that don't depend on a text's length."""
    c, n = F.col, F.nullif(F.col("n_words"), F.lit(0))
    share = lambda a, b: c(a) / F.nullif(c(b), F.lit(0))
    symbols, repeats, length = c("n_symbols") / n, c("n_repeat_words") / n, c("word_chars") / n
    letters, capitals = share("letters", "word_chars"), share("capitals", "letters")
    ends, cries, lines = c("ends") / n, c("cries") / n, c("n_dup_lines") / (c("breaks") + 1)
    never = F.lit(False)
    return [
        ("few_symbols", band(symbols, symbols < 0.05, symbols > 0.3)),
        ("few_repeats", band(repeats, never, repeats > 0.35)),
        ("few_same_lines", band(lines, never, lines > 0.4)),
        ("word_length", band(length, length.between(3, 9), ~length.between(2, 14))),
        ("mostly_letters", band(letters, letters > 0.9, letters < 0.65)),
        ("few_capitals", band(capitals, never, capitals > 0.5)),
        ("sentences", band(ends, ends.between(0.02, 0.35), ends > 0.7)),
        ("calm", band(cries, never, cries > 0.3)),
    ]


def estimate(patterns: list[tuple[list[int], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """The prior log-odds of good, and for each rule the log-odds that each vote adds.

    Expectation-maximisation of a two-class model with independent rules: a text of the good class gets a bad vote
    from a rule at one rate, a text of the bad class at another, and likewise good votes. It starts from rules that
    rarely vote bad on good texts, and a share of pseudo-votes with those rates stays in each round, so the classes
    keep their meaning and the estimate is alike at every size. A good vote never counts against a text.
    """
    start = {True: {GOOD: 0.70, BAD: 0.01}, False: {GOOD: 0.50, BAD: 0.30}}
    total = sum(n for _, n in patterns)
    mass = {True: 0.02 * total + 10, False: 0.002 * total + 1}
    rates = {c: [dict(start[c]) for _ in range(n_rules)] for c in (True, False)}
    prior = math.log(9)
    weigh = lambda k: [min(0.0, math.log(rates[True][k][BAD] / rates[False][k][BAD])), max(0.0, math.log(rates[True][k][GOOD] / rates[False][k][GOOD])), 0.0]
    weights = [weigh(k) for k in range(n_rules)]
    for _ in range(rounds if total else 0):
        size = {True: 0.0, False: 0.0}
        cast = {c: [[0.0, 0.0, 0.0] for _ in range(n_rules)] for c in size}
        for votes_, n in patterns:
            odds = prior + sum(w[v] for w, v in zip(weights, votes_, strict=True))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for c, part in ((True, n * p), (False, n * (1 - p))):
                size[c] += part
                for k, v in enumerate(votes_):
                    cast[c][k][v] += part
        for c in size:
            rates[c] = [{v: (cast[c][k][v] + mass[c] * start[c][v]) / (size[c] + mass[c]) for v in (GOOD, BAD)} for k in range(n_rules)]
        prior = math.log((size[True] + mass[True]) / (size[False] + mass[False]))
        weights = [weigh(k) for k in range(n_rules)]
    return prior, weights


def quality_rules(docs: DataFrame, *, keep_at: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    spark = docs.sparkSession
    rules = votes()
    code = sum((v * 3**k for k, (_, v) in enumerate(rules)), F.lit(0)).cast("int")
    counts = Scratch(spark, "quality-rules").save(measured(docs).withColumn("votes", code), "measured")
    found = counts.groupBy("votes").count().collect()  # at most 3**len(rules) rows
    split = lambda c: [c // 3**k % 3 for k in range(len(rules))]
    prior, weights = estimate([(split(r["votes"]), r["count"]) for r in sorted(found)], len(rules))
    odds = F.lit(prior)
    for k, w in enumerate(weights):
        vote = F.floor(F.col("votes") / 3**k) % 3
        odds = odds + F.when(vote == GOOD, w[GOOD]).when(vote == BAD, w[BAD]).otherwise(0.0)
    n = F.col("n_words")
    return (
        counts.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), "posterior")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express: all but the method's verdict."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM doc),
win AS (SELECT r, i, ws[i:i+2] AS w FROM split, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) WHERE len(ws) >= 3),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice WHERE n > 1) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(ws) AS base_failed
FROM split LEFT JOIN hit USING (r)
"""
