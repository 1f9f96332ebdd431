"""Deck rules, ban lists, health: rule checks over lists of cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pick import top_n


def zone_counts(cards: DataFrame, keys: list[str]) -> DataFrame:
    return cards.groupBy(*keys, "zone").agg(F.sum("quantity").cast("long").alias("n"))


def size_problems(cards: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zone, code, n: zones (zone, least, most) whose count is outside; empty zones count 0."""
    lists = cards.select(*keys).distinct()
    n = F.coalesce("n", F.lit(0))
    code = F.when(F.col("least") == F.col("most"), F.when(n != F.col("least"), "wrong_size")).when(n < F.col("least"), "too_few").when(n > F.col("most"), "too_many")
    # A format has a handful of zones, so every list meets them all.
    every = lists.withColumn("_z", F.explode(F.lit([r.asDict()["zone"] for r in zones.collect()]))).withColumnRenamed("_z", "zone").join(zones, "zone")
    return every.join(zone_counts(cards, keys), [*keys, "zone"], "left").withColumn("code", code).where("code IS NOT NULL").select(*keys, "zone", "code", n.alias("n"))


def zone_problems(cards: DataFrame, zones: DataFrame) -> DataFrame:
    """Cards in a zone that the format hasn't got."""
    return cards.join(zones.select("zone"), "zone", "left_anti")


def copy_problems(cards: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """keys, name, n, most: names with more copies over all zones than allowed; a null limit allows any number."""
    n = cards.withColumn("_limit", limit).groupBy(*keys, "name").agg(F.sum("quantity").cast("long").alias("n"), F.min("_limit").alias("most"))
    return n.where(F.col("n") > F.col("most"))


def deck_problems(cards: DataFrame, zones: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """keys, code, zone, name, n: all that is wrong with lists: sizes of zones, cards in zones that the format hasn't got, too many copies."""
    none = F.lit(None).cast("string")
    sizes = size_problems(cards, zones, keys).select(*keys, "code", "zone", none.alias("name"), "n")
    strays = zone_problems(cards, zones).groupBy(*keys, "zone", "name").agg(F.sum("quantity").cast("long").alias("n")).select(*keys, F.lit("wrong_zone").alias("code"), "zone", "name", "n")
    copies = copy_problems(cards, keys, limit).select(*keys, F.lit("too_many_copies").alias("code"), none.alias("zone"), "name", "n")
    return sizes.unionByName(strays).unionByName(copies)


def missing_cards(needed: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """Needed copies beyond the owned ones, by name."""
    need = needed.groupBy(*keys, "name").agg(F.sum("quantity").cast("long").alias("needed"))
    have = owned.groupBy("name").agg(F.sum("quantity").cast("long").alias("owned"))
    out = need.join(have, "name", "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    return out.withColumn("missing", F.col("needed") - F.col("owned")).where("missing > 0")


def any_print_legal(prints: DataFrame, keys: list[str], statuses: str = "legalities") -> DataFrame:
    """keys, format, legal: a card is legal in a format if any print of it is."""
    one = prints.select(*keys, F.explode(statuses).alias("format", "status"))
    return one.groupBy(*keys, "format").agg(F.bool_or(F.col("status") == "legal").alias("legal"))


def banned_impact(statuses: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Copies of restricted cards in entries, by format and status."""
    return entries.join(statuses, key).groupBy("format", "status").agg(F.sum("quantity").cast("long").alias("copies"), F.count_distinct(key).alias("cards"))


def run_overview(runs: DataFrame, key: str = "source", started: str = "started_at", ok: Column | None = None, keep: int = 30) -> DataFrame:
    """The latest runs of each source, with the last success and the last error over all of its runs."""
    ok = F.col("status") == "done" if ok is None else ok
    failed = F.when(~ok & F.col("error").isNotNull(), F.struct(started, "id"))
    # Over all runs plain aggregates are combined before the shuffle; the window keeps a source's latest rows only.
    over_all = runs.groupBy(key).agg(F.max(F.when(ok, F.col(started))).alias("last_ok"), F.max_by("error", failed).alias("last_error"))
    return top_n(runs, [key], [F.col(started).desc(), F.col("id").desc()], keep, rank="nth", keep_rank=True).join(over_all, key)


def earlier_run(runs: DataFrame, key: str, started: str, hours: int = 20) -> DataFrame:
    """Of each key, the newest run at least some hours before the newest."""
    newest = F.max(started).over(Window.partitionBy(key))
    old = runs.withColumn("_newest", newest).where(F.col(started) <= F.col("_newest") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return old.groupBy(key).agg(F.max_by(F.struct("id", started), F.struct(started, "id")).alias("b")).select(key, "b.*")


def problems_text(problems: DataFrame, keys: list[str]) -> DataFrame:
    """One message for each key, in order."""
    return problems.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("message"))


def recent(rows: DataFrame, owner: str, item: str, at: str, most: int = 10) -> DataFrame:
    """The latest items of each owner, each once."""
    once = rows.groupBy(owner, item).agg(F.max(at).alias(at))
    w = Window.partitionBy(owner).orderBy(F.col(at).desc(), F.col(item))
    return once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def curve(cards: DataFrame, keys: list[str], cost: Column, top: int) -> DataFrame:
    """Copies by cost; the last bucket holds all from `top` on."""
    bucket = F.least(F.greatest(F.floor(cost), F.lit(0)), F.lit(top)).cast("int")
    return cards.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("quantity").cast("long").alias("n"))


def pending_jobs(sources: list[DataFrame], gone: DataFrame, key: str, why: str) -> DataFrame:
    """One job for each key that a source asks for and that isn't gone, with the reasons."""
    asked = reduce(DataFrame.unionByName, sources).join(gone.select(key).distinct(), key, "left_anti")
    return asked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(why)), ",").alias(why))


def first_per_name(cards: DataFrame, keys: list[str], order: list[Column], code: str) -> DataFrame:
    """keys, name, code: the problem of each name's first card, if it has one; a name in two zones is one card."""
    w = Window.partitionBy(*keys, "name").orderBy(*order)
    return cards.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).where(F.col(code).isNotNull()).select(*keys, "name", code)


def more_than_one(cards: DataFrame, keys: list[str], kind: Column, code: str) -> DataFrame:
    """keys, code, n: lists with more than one card of a kind."""
    return cards.where(kind).groupBy(*keys).agg(F.sum("quantity").cast("long").alias("n")).where("n > 1").select(*keys, F.lit(code).alias("code"), "n")


def without_any(cards: DataFrame, keys: list[str], kind: Column, code: str) -> DataFrame:
    """keys, code: lists that have no card of a kind."""
    return cards.groupBy(*keys).agg(F.bool_or(F.coalesce(kind, F.lit(False))).alias("_any")).where(~F.col("_any")).select(*keys, F.lit(code).alias("code"))


def outside_identity(cards: DataFrame, keys: list[str], zone: str, identity: str = "identity") -> DataFrame:
    """keys, name: cards with a colour that the list's only leader hasn't got; lists with several leaders are left alone."""
    leaders = cards.where(F.col("zone") == zone).groupBy(*keys).agg(F.count("*").alias("_n"), F.first(identity).alias("_allowed")).where("_n = 1 AND _allowed IS NOT NULL")
    rest = cards.where(F.col("zone") != zone).join(leaders, keys)
    return rest.where(F.size(F.array_except(identity, "_allowed")) > 0).select(*keys, "name").distinct()


#: The least share of prices refreshed in a day; the stale prices by which a day may grow.
FRESH_SHARE, STALE_LEAST, STALE_SHARE = 0.95, 25, 0.005


def freshness_problems(now: DataFrame, before: DataFrame) -> DataFrame:
    """source, game, problem: too few prices refreshed, or many more stale ones than the day before."""
    old = before.select("source", "game", F.col("stale").alias("_before"))
    name = F.concat_ws("/", "source", "game")
    few = F.when(F.col("share") < FRESH_SHARE, F.concat(name, F.format_string(" %.1f%% refreshed in 24 h", F.col("share") * 100)))
    grown = F.when(F.col("stale") - F.col("_before") > F.greatest(F.lit(STALE_LEAST), F.ceil(F.col("priced") * STALE_SHARE)), F.concat(name, F.format_string(" %d stale (was %d)", "stale", "_before")))
    out = now.join(old, ["source", "game"], "left").select("source", "game", F.explode(F.array(few, grown)).alias("problem"))
    return out.where("problem IS NOT NULL")


def run_problems(latest: DataFrame, now: str, hours: int) -> DataFrame:
    """source, problem: sources whose last success is too old (and no run is on its way), and those whose last run failed."""
    late = F.col("last_ok").isNull() | (F.col("last_ok") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    missing = F.when((F.col("status") != "running") & late, "missing")
    return latest.select("source", F.explode(F.array(missing, F.when(F.col("status") == "failed", "failed"))).alias("problem")).where("problem IS NOT NULL")
