"""Best rows of groups, facets, pages and joins with a choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: list, order: list[Column], n: int, rank: str = "_rank", keep_rank: bool = False) -> DataFrame:
    """The first n rows of each group. Spark drops rows beyond n before the shuffle."""
    top = _ranked(df, keys, order, rank).where(F.col(rank) <= n)
    return top if keep_rank else top.drop(rank)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ordinals over a page; for few rows only, as they meet in one partition."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def distinct_on(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    return top_n(df, keys, order, 1)


def lateral_best(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], how: str = "left") -> DataFrame:
    """Each left row with the first of its right rows. The right side is reduced before the join."""
    return left.join(distinct_on(right, on, order), on, how)


def best_by(df: DataFrame, keys: list, value: Column, order: Column, name: str) -> DataFrame:
    """The value of the row with the least order; a plain aggregate, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def max_where(df: DataFrame, keys: list, value: Column, condition: Column, name: str) -> DataFrame:
    """A column with the greatest value among the group's rows that meet a condition."""
    return df.withColumn(name, F.max(F.when(condition, value)).over(Window.partitionBy(*keys)))


def first_of_all(df: DataFrame, keys: list, value: Column, order: list[Column], name: str) -> DataFrame:
    """A column with the value of the group's first row, over the whole group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.first(value).over(w))


def facet(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def exploded_facet(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, quantity: Column, labels: list[str], first: int) -> DataFrame:
    """Counts by label, in order; values outside go to the first or last label, empty ones are there with 0."""
    at = F.least(F.greatest(F.floor(value) - first, F.lit(0)), F.lit(len(labels) - 1))
    counts = df.where(value.isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(F.sum(quantity).cast("long").alias("n"))
    spine = df.sparkSession.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return spine.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows after a key. The filter reaches the scan, so earlier rows aren't sorted."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def within_budget(df: DataFrame, keys: list, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order until their sizes exceed the budget; a group's first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_sum", so_far).withColumn("_nth", F.row_number().over(w)).where((F.col("_sum") <= budget) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def optional_filters(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    wanted = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def skip_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """A column `reason`: the name of the first condition that a row meets, else null."""
    return df.withColumn("reason", F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons.items())))


def with_count(left: DataFrame, right: DataFrame, on: list[str], name: str = "n") -> DataFrame:
    """Left rows with the number of their right rows, 0 included; the right side is counted before the join."""
    counts = right.groupBy(*on).agg(F.count("*").alias(name))
    return left.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def exists_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """Left rows and whether the right side has their key."""
    keys = right.select(*on).distinct().withColumn(name, F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_nonempty(branches: list[DataFrame]) -> DataFrame:
    """The first branch that has a row; a later one is read only if the earlier ones are empty."""
    for df in branches[:-1]:
        if not df.isEmpty():
            return df
    return branches[-1]


def page_with_total(df: DataFrame, order: list[Column], size: int, number: int = 1, name: str = "total") -> DataFrame:
    """A page, with the number of all rows as a column; the count is one job of its own."""
    return page(df, order, size, number).withColumn(name, F.lit(df.count()))


def unique_lookup(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows with the value of their key, if the right side has only one value for it."""
    sole = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")
    return left.join(sole, key, "left")


def localized(base: DataFrame, names: DataFrame, key: str, wanted: str, fallback: str = "en", name: str = "name") -> DataFrame:
    """The wanted language's name, else the fallback language's, else the row's own."""
    def of(lang: str, alias: str) -> DataFrame:
        return names.where(F.col("lang") == lang).select(key, F.col(name).alias(alias))

    out = base.join(of(wanted, "_wanted"), key, "left").join(of(fallback, "_fallback"), key, "left")
    return out.withColumn(name, F.coalesce("_wanted", "_fallback", name)).drop("_wanted", "_fallback")


def kind_join(rows: DataFrame, sources: dict[str, DataFrame], kind: str = "kind", key: str = "id") -> DataFrame:
    """Rows of several kinds, each with the columns of its own kind's table (they share one schema)."""
    tagged = reduce(DataFrame.unionByName, (df.withColumn(kind, F.lit(k)) for k, df in sources.items()))
    return rows.join(tagged, [kind, key], "left")


def greedy_chunks(df: DataFrame, keys: list, order: list[Column], size: Column, limit: int, name: str = "chunk") -> DataFrame:
    """A chunk number by the running sum of sizes, so that chunks hold about `limit`; a row is never split."""
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - size
    return df.withColumn(name, F.floor(before / limit).cast("long"))


def own_or_sibling(df: DataFrame, keys: list[str], own: str, name: str) -> DataFrame:
    """A column with the row's own value, else the greatest of its siblings'; the siblings are combined before the join."""
    best = df.groupBy(*keys).agg(F.max(own).alias("_sibling"))
    return df.join(best, keys, "left").withColumn(name, F.coalesce(own, "_sibling")).drop("_sibling")


def by_year(sets: DataFrame, date: str, item: str) -> DataFrame:
    """year ('' without a date), items: the items of each year, newest first; a year has a bounded number of sets."""
    year = F.coalesce(F.year(date).cast("string"), F.lit(""))
    row = F.struct((-F.unix_date(F.to_date(date))).alias("at"), F.col(item).alias("item"))
    return sets.groupBy(year.alias("year")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["item"]).alias("items"))
