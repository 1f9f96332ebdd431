"""Entity resolution: rules with priorities, uniqueness and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_rules(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: list[tuple[str, Column, Column]], unique: bool = False) -> DataFrame:
    """left_id, right_id, rule: for each left row, what the first rule that hits gives; the least id of several.

    A rule is (name, key of the left, key of the right); each is an equi-join. unique: a key that several right rows
    have doesn't match.
    """
    found = []
    for k, (name, a, b) in enumerate(rules):
        keyed = right.select(b.alias("_key"), F.col(right_id)).where("_key IS NOT NULL")
        one = keyed.groupBy("_key").agg(F.min(right_id).alias(right_id), F.max(right_id).alias("_max"))
        one = one.where(F.col(right_id) == F.col("_max")).drop("_max") if unique else one.drop("_max")
        found.append(left.select(F.col(left_id), a.alias("_key")).join(one, "_key").select(left_id, right_id, F.lit(k).alias("_k"), F.lit(name).alias("rule")))
    hits = reduce(DataFrame.unionAll, found)
    return hits.groupBy(left_id).agg(F.min_by(F.struct(right_id, "rule"), F.struct("_k", right_id)).alias("_m")).select(left_id, F.col("_m")[right_id].alias(right_id), F.col("_m.rule").alias("rule"))


def best_unambiguous(matches: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """The most confident match of each key; a key whose best is shared has none."""
    w = Window.partitionBy(*keys)
    best = matches.withColumn("_best", F.max(confidence).over(w)).where(F.col(confidence) == F.col("_best"))
    return best.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_best", "_n")


def sole_holder(df: DataFrame, values: Column, key: list[str], name: str) -> DataFrame:
    """Rows exploded by an array, where only one row of the key has that value."""
    one = df.withColumn(name, F.explode(values))
    return one.withColumn("_n", F.count("*").over(Window.partitionBy(*key, name))).where("_n = 1").drop("_n")


def unclaimed(rows: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(claimed.select(*keys).distinct(), keys, "left_anti")


def passes(rows: DataFrame, matchers: list, key: str) -> DataFrame:
    """Matches of several passes; each sees the rows that earlier ones left."""
    out, rest = None, rows
    for k, match in enumerate(matchers):
        hit = match(rest).withColumn("pass", F.lit(k))
        out = hit if out is None else out.unionByName(hit)
        rest = unclaimed(rest, hit, [key])
    return out


def prefix_splits(queries: DataFrame, text: str, least: int = 1) -> DataFrame:
    """Each query at every split of its text: head, rest."""
    n = F.length(text)
    return queries.withColumn("cut", F.explode(F.sequence(F.lit(least), F.greatest(n, F.lit(least))))).select("*", F.left(text, F.col("cut")).alias("head"), F.substr(F.col(text), F.col("cut") + 1).alias("rest"))


def split_join(queries: DataFrame, text: str, table: DataFrame, head: str, tail: str) -> DataFrame:
    """Queries spelt as a table's head and the beginning of its tail: an equi-join on the head, then the rest."""
    return prefix_splits(queries, text).join(table, F.col("head") == table[head]).where(table[tail].startswith(F.col("rest")))


def reprint_families(groups: DataFrame, family: str, group: str, priced: Column, mapped: Column) -> DataFrame:
    """Of each family the group to use: priced counts 2, mapped 1; the lowest on a tie."""
    rank = priced.cast("int") * 2 + mapped.cast("int")
    return groups.groupBy(family).agg(F.min_by(group, F.struct(-rank, F.col(group))).alias(group))


def set_completion(owned: DataFrame, sets: DataFrame, key: str, count: str) -> DataFrame:
    have = owned.groupBy(key).agg(F.count_distinct("card_id").alias("have"))
    ratio = F.least(F.lit(1.0), F.coalesce("have", F.lit(0)) / F.nullif(F.col(count), F.lit(0)))
    return sets.join(have, key, "left").select(key, ratio.alias("completion"))


def paired_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Rows of a key paired in order of their ids, so that each row of either side is used once at most."""
    nth = lambda df, i: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(i)))
    return nth(left.select(*keys, left_id), left_id).join(nth(right.select(*keys, right_id), right_id), [*keys, "_nth"]).drop("_nth")
