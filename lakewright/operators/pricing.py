"""Prices: which to show, what a collection is worth, how a history is thinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.values import SOURCE_ORDER, condition_factor, finish_rank, language_rank, preference, round_half_up, share, week_number

from .pick import distinct_on


def display_price(prices: DataFrame, keys: list[str], *, currency: str, lang: Column | str, finishes: Column, asked: Column | None = None) -> DataFrame:
    """The price to show of each key: by finish, then language, then the currency's sources, then language code."""
    order = [
        finish_rank(F.col("finish"), finishes, asked).asc(),
        F.col("finish").asc(),
        language_rank(F.col("lang"), lang).asc(),
        preference(F.col("source"), SOURCE_ORDER[currency]).asc(),
        F.col("lang").asc(),
    ]
    return distinct_on(prices, keys, order)


def entry_price(entries: DataFrame, prices: DataFrame, keys: list[str], currency: str) -> DataFrame:
    """Entries (finish, lang, condition, finishes) with the factor and price of one copy; null without a price.

    The price is picked once for each print, finish and language that some entry has, however many entries share them.
    """
    what = [*keys, "finish", "lang", "finishes"]
    wanted = entries.select(*what).distinct().withColumnRenamed("finish", "_finish").withColumnRenamed("lang", "_lang")
    # Sorted rows take twenty times their shuffled bytes, so these parts keep the session's number and are never packed together by bytes.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = display_price(wanted.repartition(parts, *keys).join(prices.repartition(parts, *keys), keys), [*keys, "_finish", "_lang", "finishes"], currency=currency, lang=F.col("_lang"), finishes=F.col("finishes"), asked=F.col("_finish"))
    shown = best.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, "_finish", "_lang", "finishes"])), F.col("source"), F.col("currency"), F.col("market").alias("market_cents"), "observed_at")
    same = [entries[c].eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(what)]
    priced = entries.join(shown, same, "left").drop(*(f"_k{n}" for n in range(len(what))))
    factor = condition_factor(F.col("condition"))
    return priced.withColumn("factor", F.when(F.col("market_cents").isNotNull(), factor)).withColumn("unit_cents", round_half_up(F.col("market_cents") * F.col("factor")))


def totals(priced: DataFrame, keys: list[str], source: str = "source", currency: str = "currency") -> DataFrame:
    """Sums of quantity x unit_cents by source and currency, never converted, and the oldest observation in each."""
    return priced.where("unit_cents IS NOT NULL").groupBy(*keys, source, currency).agg(F.sum(F.col("unit_cents") * F.col("quantity")).cast("long").alias("cents"), F.min("observed_at").alias("as_of"))


def summary(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Copies, entries and copies without a price."""
    return priced.groupBy(*keys).agg(F.sum("quantity").cast("long").alias("cards"), F.count("*").alias("entries"), F.coalesce(F.sum(F.when(F.col("unit_cents").isNull(), F.col("quantity"))), F.lit(0)).cast("long").alias("unpriced"))


def in_budget(limit: Column, limit_currency: Column, cents: Column, currency: Column) -> Column:
    """Null where there is no limit, no price, or another currency."""
    return F.when(limit.isNotNull() & cents.isNotNull() & (limit_currency.isNull() | (limit_currency == currency)), cents <= limit)


def thin_history(points: DataFrame, series: list[str], day: str, today, daily_days: int = 180) -> DataFrame:
    """Daily points for the last days; before, the last point of each week (from Monday)."""
    d, now = F.col(day), F.lit(today).cast("date")
    recent = F.datediff(now, d) <= daily_days
    slot = F.when(recent, F.struct(F.lit(1).alias("recent"), F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long").alias("at"))).otherwise(F.struct(F.lit(0).alias("recent"), week_number(d).alias("at")))
    w = Window.partitionBy(*series, slot).orderBy(d.desc())
    return points.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def freshness(prints: DataFrame, mapped: DataFrame, prices: DataFrame, key: str, group: list[str], since: Column, time: str = "observed_at") -> DataFrame:
    """By group: prints, mapped, priced and fresh ones, and the fresh share of the priced."""
    # Both kinds of rows are combined to one for each key, so a key meets its print once.
    rows = mapped.select(key, F.lit(1).alias("_mapped"), F.lit(None).cast(prices.schema[time].dataType).alias("_last")).unionAll(prices.select(key, F.lit(None).cast("int"), time))
    one = prints.join(rows.groupBy(key).agg(F.max("_mapped").alias("_mapped"), F.max("_last").alias("_last")), key, "left")
    fresh = F.count_if(F.col("_last") >= since)
    priced = F.count("_last")
    return one.groupBy(*group).agg(F.count("*").alias("prints"), F.count("_mapped").alias("mapped"), (F.count("*") - F.count("_mapped")).alias("unmapped"), priced.alias("priced"), fresh.alias("fresh"), (priced - fresh).alias("stale"), share(fresh, priced).alias("share"))


def roll_up_freshness(by_set: DataFrame, keys: list[str]) -> DataFrame:
    sums = by_set.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("prints", "mapped", "unmapped", "priced", "fresh", "stale")))
    return sums.withColumn("share", share(F.col("fresh"), F.col("priced")))


def cheapest(prices: DataFrame, keys: list[str], currency: str) -> DataFrame:
    """The cheapest price in the currency of each key; ties go to the least print."""
    return prices.where(F.col("currency") == currency).groupBy(*keys).agg(F.min_by(F.struct("print_id", "market"), F.struct("market", "print_id")).alias("b")).select(*keys, F.col("b.print_id").alias("print_id"), F.col("b.market").alias("market"))


def coverage_gaps(groups: DataFrame, sets: DataFrame, match: list[str], prints: DataFrame, prices: DataFrame, key: list[str]) -> DataFrame:
    """kind, id: groups that match no set, and prints without a price."""
    unmatched = groups.join(sets.select(*match).distinct(), match, "left_anti").select(F.lit("unmatched").alias("kind"), "id")
    return unmatched.unionByName(prints.join(prices.select(*key).distinct(), key, "left_anti").select(F.lit("unpriced").alias("kind"), "id"))


def finish_totals(owned: DataFrame, keys: list[str]) -> DataFrame:
    return owned.groupBy(*keys, "finish").agg(F.sum("quantity").cast("long").alias("n"))


def set_value(prices: DataFrame, owned: DataFrame, keys: list[str], print_id: str, currency: str) -> DataFrame:
    """keys, owned and missing value and number, as_of: what the owned copies of a group's prints are worth, and one copy of each missing one.

    Prices in another currency don't count.
    """
    have = owned.groupBy(print_id).agg(F.sum("quantity").cast("long").alias("_have"))
    one = prices.where(F.col("currency") == currency).join(have, print_id, "left").withColumn("_n", F.coalesce("_have", F.lit(0)))
    held = F.col("_n") > 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return one.groupBy(*keys).agg(
        total(F.col("cents") * F.col("_n")).alias("owned_cents"),
        total(F.when(~held, F.col("cents"))).alias("missing_cents"),
        total(F.col("_n")).alias("owned"),
        F.count_if(~held).alias("missing"),
        F.max("observed_at").alias("as_of"),
    )
