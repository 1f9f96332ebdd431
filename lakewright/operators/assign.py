"""Each row of either side once: greedy matching, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.sources.scratch import Steps

c = F.col
ROUNDS = 60


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: list[str], *, rounds: int = ROUNDS) -> DataFrame:
    """The pairs that a loop over `pairs` in their order keeps, if it takes each whose two sides are both still free.

    A round takes every pair that comes first for both of its sides: no earlier pair can touch it, so the loop takes it
    too. What shares a side with it is dropped, and the rest goes on. Ties in the order go by left, then right. Random orders
    need few rounds; a chain in which each pair waits for the one before needs as many as it is long, so such input
    ends in an error after `rounds`, never in a part of the result.
    """
    steps = Steps(pairs.sparkSession, "greedy")
    names = list(dict.fromkeys([*order, left, right]))
    rest = steps.save(pairs.where(c(left).isNotNull() & c(right).isNotNull()).select(F.struct(*names).alias("_p"), c(left).alias("_l"), c(right).alias("_r")))
    taken = []
    while not rest.isEmpty():
        if len(taken) == rounds:
            raise RuntimeError(f"pairs are left after {rounds} rounds")
        of_left = rest.groupBy("_l").agg(F.min("_p").alias("_p"))
        of_right = rest.groupBy("_r").agg(F.min("_p").alias("_p"))
        hit = steps.save(of_left.join(of_right, "_p").select("_p", "_l", "_r"))
        taken.append(hit)
        rest = steps.save(rest.join(hit.select("_l"), "_l", "left_anti").join(hit.select("_r"), "_r", "left_anti"))
    every = taken[0] if taken else rest
    for more in taken[1:]:
        every = every.unionByName(more)
    return every.select(*(c("_p")[n].alias(n) for n in names))


def cards_once(prints: DataFrame, cards: DataFrame) -> DataFrame:
    """print_id, card_id, rule: each card for one print at most.

    prints: print_id, number, name, has_picture; cards: card_id, number, name; numbers and names as keys. By number and
    name: the only card of both, for the first print (by id) without a picture. Then by name: a name that one print
    without a match and one unused card have, where no print has the card's number; prints with a picture take part in the
    counts only.
    """
    todo = prints.where(~c("has_picture"))
    sole = cards.where(c("number").isNotNull() & c("name").isNotNull()).groupBy("number", "name").agg(F.min("card_id").alias("card_id"), F.count("*").alias("_n")).where("_n = 1")
    exact = todo.join(sole, ["number", "name"]).groupBy("card_id").agg(F.min("print_id").alias("print_id"))
    rest_cards = cards.join(exact, "card_id", "left_anti").join(prints.select("number").distinct(), "number", "left_anti")
    open_prints = prints.join(exact.select("print_id"), "print_id", "left_anti")
    alone = lambda df, key: df.where("name IS NOT NULL").groupBy("name").agg(F.min(key).alias(key), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    by_name = alone(open_prints, "print_id").join(alone(rest_cards, "card_id"), "name").join(todo.select("print_id"), "print_id", "left_semi")
    shape = lambda df, rule: df.select("print_id", "card_id", F.lit(rule).alias("rule"))
    return shape(exact, "number").unionByName(shape(by_name, "name"))


def match_sets(ours: DataFrame, theirs: DataFrame, aliases: DataFrame) -> DataFrame:
    """code, set_id, rule: which of their sets is each of ours.

    ours: code, codes, name, released_on; theirs: set_id, code, name, released_on; aliases: code, set_id; names as keys. A set
    with an alias has that or none. Else the only one of theirs that shares a code and the name; else the only one with
    a code of ours that no other of ours has; else the only one of the same name and day.
    """
    said = aliases.join(theirs.select("set_id"), "set_id", "left_semi").join(ours.select("code"), "code").select("code", "set_id", F.lit(0).alias("_k"), F.lit("alias").alias("rule"))
    rest = ours.join(aliases.select("code"), "code", "left_anti")
    # Theirs are reduced to the least and the last set of a key first: many sets of one key make no pairs.
    ends = lambda df, *keys: df.groupBy(*keys).agg(F.min("set_id").alias("_least"), F.max("set_id").alias("_last"))
    one = lambda df: df.groupBy("code").agg(F.min("_least").alias("set_id"), F.max("_last").alias("_last"), F.min("_c").alias("_c")).where("set_id = _last")
    mine = rest.select("code", "name", F.explode(F.array_distinct("codes")).alias("_c"))
    coded = theirs.where("code IS NOT NULL").select("set_id", c("code").alias("_c"), "name")
    holders = ours.select("code", F.explode(F.array_distinct("codes")).alias("_c")).groupBy("_c").agg(F.count("*").alias("_holders"))
    by_name = one(mine.join(ends(coded, "_c", "name"), ["_c", "name"]))
    alone = one(mine.join(ends(coded, "_c"), "_c")).join(holders.where("_holders = 1"), "_c")
    dated = one(rest.join(ends(theirs, "name", "released_on"), ["name", "released_on"]).withColumn("_c", F.lit(None)))
    found = [said, *(df.select("code", "set_id", F.lit(k).alias("_k"), F.lit(rule).alias("rule")) for k, rule, df in ((1, "code and name", by_name), (2, "code", alone), (3, "name and day", dated)))]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("code").agg(F.min_by(F.struct("set_id", "rule"), "_k").alias("_m")).select("code", "_m.*")
