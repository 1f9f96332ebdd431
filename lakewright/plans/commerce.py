"""Prices, collections, lists, health: the price feed is made of line items, copies are orders' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.values import cents, condition_factor, round_half_up, share
from lakewright.operators import feed, lists, pick, pricing
from lakewright.sources.tables import table

from .registry import query

c = F.col
NOW = "2001-08-01"

#: Observations: print, finish, source, lang, market cents.
_OBSERVED = """
observed AS (SELECT l_partkey AS print_id, CASE l_returnflag WHEN 'A' THEN 'foil' WHEN 'N' THEN 'normal' ELSE 'etched' END AS finish,
  CASE WHEN l_linenumber <= 2 THEN 'cardmarket' WHEN l_linenumber <= 4 THEN 'tcgplayer' ELSE 'tcgplayer_scryfall' END AS source,
  CASE WHEN l_tax < 0.03 THEN 'de' WHEN l_tax < 0.06 THEN 'en' ELSE 'fr' END AS lang,
  CASE WHEN l_linenumber <= 2 THEN 'EUR' ELSE 'USD' END AS currency,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS market, l_shipdate AS observed_at, l_orderkey, l_linenumber FROM lineitem),
prices AS (SELECT DISTINCT ON (print_id, finish, source, lang) print_id, finish, source, lang, currency, market, observed_at FROM observed
  ORDER BY print_id, finish, source, lang, observed_at DESC, l_orderkey DESC, l_linenumber DESC, market DESC)"""


def observed(spark: SparkSession, d: str) -> DataFrame:
    n = c("l_linenumber")
    return table(spark, d, "lineitem").select(
        c("l_partkey").alias("print_id"),
        F.when(c("l_returnflag") == "A", "foil").when(c("l_returnflag") == "N", "normal").otherwise("etched").alias("finish"),
        F.when(n <= 2, "cardmarket").when(n <= 4, "tcgplayer").otherwise("tcgplayer_scryfall").alias("source"),
        F.when(c("l_tax") < 0.03, "de").when(c("l_tax") < 0.06, "en").otherwise("fr").alias("lang"),
        F.when(n <= 2, "EUR").otherwise("USD").alias("currency"),
        cents(c("l_extendedprice")).alias("market"),
        c("l_shipdate").alias("observed_at"),
        "l_orderkey",
        "l_linenumber",
    )


def current_prices(spark: SparkSession, d: str) -> DataFrame:
    tie = F.struct("l_orderkey", "l_linenumber", "market")
    rows = observed(spark, d).withColumn("tie", tie).drop("l_orderkey", "l_linenumber")
    return feed.latest(rows, ["print_id", "finish", "source", "lang"], "observed_at", "tie").drop("tie")


#: Copies: an order's line is an entry; the condition is the priority, the wanted language the segment.
_ENTRIES = """
entries AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, o_custkey AS user_id, l_partkey AS print_id, 'foil' AS finish, 'en' AS lang,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'MT' WHEN '2' THEN 'NM' WHEN '3' THEN 'EX' WHEN '4' THEN 'GD' ELSE 'PO' END AS condition, CAST(l_quantity AS BIGINT) AS quantity
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) l JOIN orders ON o_orderkey = l_orderkey)"""
_DISPLAY = """
ranked AS (SELECT e.entry_id, p.*, row_number() OVER (PARTITION BY e.entry_id ORDER BY CASE p.finish WHEN e.finish THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, p.finish,
  CASE p.lang WHEN e.lang THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE p.source WHEN 'cardmarket' THEN 0 WHEN 'tcgplayer' THEN 1 ELSE 2 END, p.lang) AS nth
  FROM entries e JOIN prices p ON p.print_id = e.print_id),
priced AS (SELECT e.*, r.source, r.currency, r.market AS market_cents, r.observed_at,
  CAST(floor(r.market * CASE e.condition WHEN 'MT' THEN 1.05::DOUBLE WHEN 'NM' THEN 1.0::DOUBLE WHEN 'EX' THEN 0.85::DOUBLE WHEN 'GD' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END + 0.5) AS BIGINT) AS unit_cents
  FROM entries e LEFT JOIN ranked r ON r.entry_id = e.entry_id AND r.nth = 1)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    lines = pick.distinct_on(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [c(x).asc() for x in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")])
    grade = F.left("o_orderpriority", F.lit(1))
    condition = F.when(grade == "1", "MT").when(grade == "2", "NM").when(grade == "3", "EX").when(grade == "4", "GD").otherwise("PO")
    return lines.join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("entry_id"), c("o_custkey").alias("user_id"), c("l_partkey").alias("print_id"), F.lit("foil").alias("finish"), F.lit("en").alias("lang"),
        condition.alias("condition"), c("l_quantity").cast("long").alias("quantity"), F.array(F.lit("normal"), F.lit("foil")).alias("finishes"),
    )


def priced_entries(spark: SparkSession, d: str) -> DataFrame:
    return pricing.entry_price(entries(spark, d), current_prices(spark, d), ["print_id"], "EUR")


@query(f"WITH {_OBSERVED} SELECT print_id, finish, source, lang, market FROM prices")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """The current prices: the newest observation of each series."""
    return current_prices(spark, d).select("print_id", "finish", "source", "lang", "market")


@query(f"""
WITH {_OBSERVED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY print_id ORDER BY CASE finish WHEN 'normal' THEN 1 WHEN 'foil' THEN 3 ELSE 1001 END, finish,
  CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE source WHEN 'tcgplayer' THEN 0 WHEN 'tcgplayer_scryfall' THEN 1 ELSE 2 END, lang) AS nth FROM prices)
SELECT print_id, finish, source, lang, currency, market FROM ranked WHERE nth = 1""")
def display_price(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array(F.lit("normal"), F.lit("foil"))
    best = pricing.display_price(current_prices(spark, d), ["print_id"], currency="USD", lang="de", finishes=listed)
    return best.select("print_id", "finish", "source", "lang", "currency", "market")


@query(f"WITH {_OBSERVED}, {_ENTRIES}, {_DISPLAY} SELECT entry_id, source, unit_cents FROM priced")
def entry_price(spark: SparkSession, d: str) -> DataFrame:
    return priced_entries(spark, d).select("entry_id", "source", "unit_cents")


@query(f"""
WITH {_OBSERVED}, {_ENTRIES}, {_DISPLAY} SELECT user_id, source, currency, CAST(sum(unit_cents * quantity) AS BIGINT) AS cents, CAST(CAST(min(observed_at) AS DATE) AS VARCHAR) AS as_of
FROM priced WHERE unit_cents IS NOT NULL GROUP BY 1, 2, 3""")
def value_by_source(spark: SparkSession, d: str) -> DataFrame:
    """What each user's copies are worth, by source and currency, never converted."""
    return pricing.totals(priced_entries(spark, d), ["user_id"]).withColumn("as_of", F.to_date("as_of").cast("string"))


@query(f"""
WITH {_OBSERVED}, {_ENTRIES}, {_DISPLAY} SELECT user_id, CAST(sum(quantity) AS BIGINT) AS cards, count(*) AS entries, CAST(coalesce(sum(quantity) FILTER (WHERE unit_cents IS NULL), 0) AS BIGINT) AS unpriced
FROM priced GROUP BY 1""")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    return pricing.summary(priced_entries(spark, d), ["user_id"])


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS BIGINT) AS cents, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS as_of FROM lineitem GROUP BY 1, 2""")
def value_by_currency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", cents(c("l_extendedprice")).alias("unit_cents"), F.lit(1).alias("quantity"), c("l_shipdate").alias("observed_at"))
    return pricing.totals(rows, [], source="l_returnflag", currency="l_linestatus").withColumn("as_of", F.to_date("as_of").cast("string"))


@query(f"""
WITH {_OBSERVED}, {_ENTRIES}, {_DISPLAY} SELECT entry_id, CASE WHEN market_cents IS NOT NULL AND currency = 'EUR' THEN unit_cents <= 3000000 END AS in_budget FROM priced""")
def in_budget(spark: SparkSession, d: str) -> DataFrame:
    flag = pricing.in_budget(F.lit(3_000_000), F.lit("EUR"), c("unit_cents"), c("currency"))
    return priced_entries(spark, d).select("entry_id", flag.alias("in_budget"))


@query(f"WITH {_OBSERVED} SELECT p_name, min(market) AS market, min_by(print_id, (market, print_id)) AS print_id FROM (SELECT p_name, market, print_id FROM prices JOIN part ON p_partkey = print_id WHERE currency = 'EUR') GROUP BY 1".replace("min_by(print_id, (market, print_id))", "arg_min(print_id, (market, print_id))"))
def cheapest_print(spark: SparkSession, d: str) -> DataFrame:
    prices = current_prices(spark, d).join(table(spark, d, "part").select(c("p_partkey").alias("print_id"), "p_name"), "print_id")
    return pricing.cheapest(prices, ["p_name"], "EUR")


@query("""
SELECT s_suppkey, round(least(1.0, coalesce(n, 0) / nullif(s_nationkey, 0)), 6) AS completion FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_suppkey = s_suppkey""")
def set_completion(spark: SparkSession, d: str) -> DataFrame:
    from lakewright.operators.matching import set_completion as completion

    owned = table(spark, d, "lineitem").where("l_quantity > 48").select(c("l_suppkey").alias("s_suppkey"), c("l_partkey").alias("card_id"))
    return completion(owned, table(spark, d, "supplier"), "s_suppkey", "s_nationkey").withColumn("completion", F.round("completion", 6))


@query(f"""
WITH {_ENTRIES} SELECT print_id, CAST(sum(quantity) AS BIGINT) AS copies, CAST(coalesce(sum(quantity) FILTER (WHERE condition = 'NM'), 0) AS BIGINT) AS near_mint FROM entries GROUP BY 1""")
def owned_counts(spark: SparkSession, d: str) -> DataFrame:
    near_mint = F.coalesce(F.sum(F.when(c("condition") == "NM", c("quantity"))), F.lit(0)).cast("long")
    return entries(spark, d).groupBy("print_id").agg(F.sum("quantity").cast("long").alias("copies"), near_mint.alias("near_mint"))


@query("""
WITH n AS (SELECT l_orderkey, p_name, CAST(sum(l_quantity) AS BIGINT) AS needed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
o AS (SELECT p_name, CAST(sum(p_size) AS BIGINT) AS owned FROM part WHERE p_type = 'PROMO' GROUP BY 1)
SELECT l_orderkey, n.p_name AS name, needed, coalesce(owned, 0) AS owned, needed - coalesce(owned, 0) AS missing FROM n LEFT JOIN o ON o.p_name = n.p_name WHERE needed > coalesce(owned, 0)""")
def missing_cards(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    needed = table(spark, d, "lineitem").join(part, c("l_partkey") == c("p_partkey")).select("l_orderkey", c("p_name").alias("name"), c("l_quantity").alias("quantity"))
    owned = part.where("p_type = 'PROMO'").select(c("p_name").alias("name"), c("p_size").alias("quantity"))
    return lists.missing_cards(needed, owned, ["l_orderkey"])


def list_cards(spark: SparkSession, d: str) -> DataFrame:
    """Orders as card lists; the return flag is the zone."""
    zone = F.when(c("l_returnflag") == "A", "main").when(c("l_returnflag") == "N", "side").otherwise("extra")
    return table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("list_id"), zone.alias("zone"), c("p_name").alias("name"), c("l_quantity").cast("long").alias("quantity"), "p_type", "p_size")


_CARDS = """
cards AS (SELECT l_orderkey AS list_id, CASE l_returnflag WHEN 'A' THEN 'main' WHEN 'N' THEN 'side' ELSE 'extra' END AS zone, p_name AS name, CAST(l_quantity AS BIGINT) AS quantity, p_type, p_size
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"WITH {_CARDS} SELECT list_id, zone, CAST(sum(quantity) AS BIGINT) AS n FROM cards GROUP BY 1, 2")
def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    return lists.zone_counts(list_cards(spark, d), ["list_id"])


@query(f"""
WITH {_CARDS}, z(zone, least, most) AS (VALUES ('main', 60, 1000000), ('side', 0, 15)), l AS (SELECT DISTINCT list_id FROM cards),
n AS (SELECT l.list_id, z.zone, z.least, z.most, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS n FROM l CROSS JOIN z LEFT JOIN cards k ON k.list_id = l.list_id AND k.zone = z.zone GROUP BY ALL)
SELECT list_id, zone, CASE WHEN n < least THEN 'too_few' ELSE 'too_many' END AS code, n FROM n WHERE n < least OR n > most""")
def size_problems(spark: SparkSession, d: str) -> DataFrame:
    zones = spark.createDataFrame([("main", 60, 1_000_000), ("side", 0, 15)], "zone string, least int, most int")
    return lists.size_problems(list_cards(spark, d), zones, ["list_id"])


@query(f"""
WITH {_CARDS} SELECT list_id, name, CAST(sum(quantity) AS BIGINT) AS n, min(CASE p_type WHEN 'PROMO' THEN 20 WHEN 'ECONOMY' THEN NULL ELSE 40 END) AS most
FROM cards GROUP BY 1, 2 HAVING sum(quantity) > min(CASE p_type WHEN 'PROMO' THEN 20 WHEN 'ECONOMY' THEN NULL ELSE 40 END)""")
def copy_problems(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(c("p_type") == "PROMO", 20).when(c("p_type") == "ECONOMY", F.lit(None).cast("int")).otherwise(40)
    return lists.copy_problems(list_cards(spark, d), ["list_id"], limit)


@query(f"""
WITH {_CARDS}, z(zone, least, most) AS (VALUES ('main', 60, 1000000)), l AS (SELECT DISTINCT list_id FROM cards),
n AS (SELECT l.list_id, z.zone, z.least, z.most, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS n FROM l CROSS JOIN z LEFT JOIN cards k ON k.list_id = l.list_id AND k.zone = z.zone GROUP BY ALL)
SELECT list_id, CASE WHEN n < least THEN 'too_few' ELSE 'too_many' END AS code, zone, NULL AS name, n FROM n WHERE n < least OR n > most
UNION ALL SELECT list_id, 'wrong_zone', zone, name, CAST(sum(quantity) AS BIGINT) FROM cards WHERE zone NOT IN (SELECT zone FROM z) GROUP BY list_id, zone, name
UNION ALL SELECT list_id, 'too_many_copies', NULL, name, CAST(sum(quantity) AS BIGINT) FROM cards GROUP BY list_id, name HAVING sum(quantity) > 40""")
def deck_problems(spark: SparkSession, d: str) -> DataFrame:
    """Everything that a format's rules say against each list."""
    zones = spark.createDataFrame([("main", 60, 1_000_000)], "zone string, least int, most int")
    return lists.deck_problems(list_cards(spark, d), zones, ["list_id"], F.lit(40))


@query(f"""
WITH {_CARDS}, b AS (SELECT list_id, least(greatest(CAST(floor(p_size / 8) AS INTEGER), 0), 5) AS bucket, quantity FROM cards WHERE zone = 'main')
SELECT list_id, bucket, CAST(sum(quantity) AS BIGINT) AS n FROM b GROUP BY 1, 2""")
def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    return lists.curve(list_cards(spark, d).where("zone = 'main'"), ["list_id"], c("p_size") / 8, 5)


@query("""
WITH one AS (SELECT p_name, unnest(['x', 'y']) AS format, unnest([p_size > 40, p_type = 'PROMO']) AS ok FROM part)
SELECT p_name, format, bool_or(ok) AS legal FROM one GROUP BY 1, 2""")
def any_print_legal(spark: SparkSession, d: str) -> DataFrame:
    status = lambda ok: F.when(ok, "legal").otherwise("not_legal")
    prints = table(spark, d, "part").withColumn("legalities", F.create_map(F.lit("x"), status(c("p_size") > 40), F.lit("y"), status(c("p_type") == "PROMO")))
    return lists.any_print_legal(prints, ["p_name"])


@query("""
SELECT 'x' AS format, CASE WHEN p_size > 45 THEN 'banned' ELSE 'limited' END AS status, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS copies, count(DISTINCT l_partkey) AS cards
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY 1, 2""")
def banned_impact(spark: SparkSession, d: str) -> DataFrame:
    statuses = table(spark, d, "part").where("p_size > 40").select(c("p_partkey").alias("card_id"), F.lit("x").alias("format"), F.when(c("p_size") > 45, "banned").otherwise("limited").alias("status"))
    held = table(spark, d, "lineitem").select(c("l_partkey").alias("card_id"), c("l_quantity").cast("long").alias("quantity"))
    return lists.banned_impact(statuses, held, "card_id")


_FRESH = """
one AS (SELECT p_partkey, p_brand, p_type, m.k IS NOT NULL AS mapped, pr.last FROM part
  LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') m ON m.k = p_partkey
  LEFT JOIN (SELECT l_partkey AS k, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) pr ON pr.k = p_partkey),
f AS (SELECT {keys}, count(*) AS prints, count(*) FILTER (WHERE mapped) AS mapped, count(*) FILTER (WHERE NOT mapped) AS unmapped, count(last) AS priced,
  count(*) FILTER (WHERE last >= TIMESTAMP '2001-01-01') AS fresh FROM one GROUP BY {keys})
SELECT {keys}, prints, mapped, unmapped, priced, fresh, priced - fresh AS stale, round(fresh / nullif(priced, 0), 4) AS share FROM f"""


def freshness_by_type(spark: SparkSession, d: str) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    prices = lines.where("l_linenumber = 1").select(c("l_partkey").alias("p_partkey"), c("l_shipdate").alias("observed_at"))
    mapped = lines.where("l_returnflag = 'A'").select(c("l_partkey").alias("p_partkey"))
    return pricing.freshness(part, mapped, prices, "p_partkey", ["p_brand", "p_type"], F.to_timestamp(F.lit("2001-01-01")))


@query("WITH " + _FRESH.format(keys="p_brand, p_type"))
def freshness_filter_agg(spark: SparkSession, d: str) -> DataFrame:
    return freshness_by_type(spark, d)


@query("WITH " + _FRESH.format(keys="p_type"))
def freshness_rollup(spark: SparkSession, d: str) -> DataFrame:
    return pricing.roll_up_freshness(freshness_by_type(spark, d), ["p_type"])


@query("""
WITH g AS (SELECT s_suppkey, s_nationkey FROM supplier), m AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT 'unmatched' AS kind, s_suppkey AS id FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.nation = g.s_nationkey AND m.n > 3)
UNION ALL SELECT 'unpriced', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND l_linenumber = 1)""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Groups without a set, and sets without a price."""
    nations = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(c("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n")).where("n > 3")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'N' AND l_linenumber = 1").select(c("l_partkey").alias("p_partkey"))
    return pricing.coverage_gaps(table(spark, d, "supplier").withColumn("id", c("s_suppkey")), nations, ["s_nationkey"], table(spark, d, "part").withColumn("id", c("p_partkey")), lines, ["p_partkey"])


@query("""
WITH day AS (SELECT event_type, CAST(ts AS DATE) AS day, round(max(value), 2) AS high FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, CASE WHEN DATE '2024-01-31' - day <= 10 THEN 1000000 + (day - DATE '1970-01-01') ELSE CAST(floor((day - DATE '1970-01-01' + 3) / 7) AS BIGINT) END ORDER BY day DESC) AS nth FROM day)
SELECT event_type, CAST(day AS VARCHAR) AS day, high FROM r WHERE nth = 1""")
def history_weekly_thin(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.max("value"), 2).alias("high"))
    return pricing.thin_history(points, ["event_type"], "day", "2024-01-31", daily_days=10).select("event_type", c("day").cast("string").alias("day"), "high")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, round(l_quantity / nullif(l_tax * 100, 0), 4) AS share FROM lineitem")
def round_half_up_cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents(c("l_extendedprice")).alias("cents"), share(c("l_quantity"), c("l_tax") * 100).alias("share"))


@query("""
SELECT o_orderkey, CAST(floor(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * CASE left(o_orderpriority, 1) WHEN '1' THEN 1.05::DOUBLE WHEN '2' THEN 0.9::DOUBLE WHEN '3' THEN 0.85::DOUBLE WHEN '4' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS BIGINT) AS estimate FROM orders""")
def condition_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Mint's fixed factor, the game's own for near mint, else the defaults, else 1."""
    grade = F.left("o_orderpriority", F.lit(1))
    condition = F.when(grade == "1", "MT").when(grade == "2", "NM").when(grade == "3", "EX").when(grade == "4", "PO").otherwise("??")
    own = F.when(grade == "2", F.lit(0.9))
    return table(spark, d, "orders").select("o_orderkey", round_half_up(cents(c("o_totalprice")) * condition_factor(condition, own)).alias("estimate"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as a ledger of import runs."""
    status = F.when(c("event_type") == "error", "failed").otherwise("done")
    return table(spark, d, "events").select(c("event_type").alias("kind"), c("user_id").alias("source"), c("event_id").alias("id"), c("ts").alias("started_at"), status.alias("status"), F.when(status == "failed", c("props")).alias("error"))


@query("""
WITH r AS (SELECT user_id AS source, event_id AS id, ts, event_type = 'error' AS failed, props FROM events)
SELECT source, id, nth, last_ok, last_error FROM (SELECT source, id, CAST(row_number() OVER w AS INTEGER) AS nth,
  strftime(max(ts) FILTER (WHERE NOT failed) OVER (PARTITION BY source), '%Y-%m-%d %H:%M:%S') AS last_ok,
  max(props) FILTER (WHERE id = last_failed) OVER (PARTITION BY source) AS last_error
  FROM (SELECT *, arg_max(id, (ts, id)) FILTER (WHERE failed) OVER (PARTITION BY source) AS last_failed FROM r) WINDOW w AS (PARTITION BY source ORDER BY ts DESC, id DESC)) WHERE nth <= 3""")
def run_overview(spark: SparkSession, d: str) -> DataFrame:
    out = lists.run_overview(runs(spark, d), keep=3)
    return out.select("source", "id", "nth", F.date_format("last_ok", "yyyy-MM-dd HH:mm:ss").alias("last_ok"), "last_error")


@query("""
WITH n AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1) SELECT e.user_id AS source, arg_max(event_id, (ts, event_id)) AS id
FROM events e JOIN n ON n.user_id = e.user_id WHERE ts <= newest - INTERVAL 20 HOUR GROUP BY 1""")
def earlier_run(spark: SparkSession, d: str) -> DataFrame:
    return lists.earlier_run(runs(spark, d), "source", "started_at", 20).select("source", "id")


@query("""
WITH p AS (SELECT DISTINCT user_id AS source, event_type AS problem FROM events WHERE value > 60 OR event_type = 'error') SELECT source, string_agg(problem, '; ' ORDER BY problem) AS message FROM p GROUP BY 1""")
def problem_messages(spark: SparkSession, d: str) -> DataFrame:
    problems = table(spark, d, "events").where("value > 60 OR event_type = 'error'").select(c("user_id").alias("source"), c("event_type").alias("problem")).distinct()
    return lists.problems_text(problems, ["source"])


@query("""
WITH o AS (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type) AS nth FROM o) WHERE nth <= 3""")
def most_recent(spark: SparkSession, d: str) -> DataFrame:
    return lists.recent(table(spark, d, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", "nth")


@query("""
SELECT o_orderkey, coalesce(own, sibling) AS image FROM (SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS own,
  max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) OVER (PARTITION BY o_custkey) AS sibling FROM orders)""")
def own_or_sibling(spark: SparkSession, d: str) -> DataFrame:
    """A row's own picture, else one of a sibling's."""
    own = F.when(c("o_orderstatus") == "F", c("o_orderpriority"))
    return pick.own_or_sibling(table(spark, d, "orders").withColumn("own", own), ["o_custkey"], "own", "image").select("o_orderkey", "image")


@query("""
SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderdate = first) AS base, count(*) - 1 AS others FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders) GROUP BY 1""")
def earliest_edition(spark: SparkSession, d: str) -> DataFrame:
    """The earliest edition stands for the set, the others are counted."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("base"), (F.count("*") - 1).alias("others"))


@query("""
WITH a AS (SELECT l_partkey AS k, 'r' AS why FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 UNION ALL SELECT p_partkey, 'big' FROM part WHERE p_size > 40)
SELECT a.k, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = a.k AND l_linenumber = 7 AND l_returnflag = 'N') GROUP BY 1""")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Work from two sources, less what is known to be gone, one job for each key."""
    lines = table(spark, d, "lineitem")
    wanted = [lines.where("l_returnflag = 'R' AND l_quantity > 45").select(c("l_partkey").alias("k"), F.lit("r").alias("why")), table(spark, d, "part").where("p_size > 40").select(c("p_partkey").alias("k"), F.lit("big").alias("why"))]
    return lists.pending_jobs(wanted, lines.where("l_linenumber = 7 AND l_returnflag = 'N'").select(c("l_partkey").alias("k")), "k", "why")


@query(f"WITH {_ENTRIES} SELECT user_id, finish, CAST(sum(quantity) AS BIGINT) AS n FROM entries GROUP BY 1, 2")
def finish_totals(spark: SparkSession, d: str) -> DataFrame:
    return pricing.finish_totals(entries(spark, d), ["user_id"])


@query("""
WITH p AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part WHERE p_type <> 'PROMO'),
o AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS have FROM lineitem WHERE l_quantity > 47 AND l_returnflag = 'A' GROUP BY 1)
SELECT p_brand, CAST(sum(cents * coalesce(have, 0)) AS BIGINT) AS owned_cents, CAST(coalesce(sum(cents) FILTER (WHERE have IS NULL), 0) AS BIGINT) AS missing_cents,
  CAST(sum(coalesce(have, 0)) AS BIGINT) AS owned, count(*) FILTER (WHERE have IS NULL) AS missing FROM p LEFT JOIN o ON l_partkey = p_partkey GROUP BY 1""")
def set_value(spark: SparkSession, d: str) -> DataFrame:
    """What is owned and missing of each brand is worth, in one currency."""
    currency = F.when(c("p_type") == "PROMO", "USD").otherwise("EUR")
    prices = table(spark, d, "part").select("p_brand", c("p_partkey").alias("print_id"), cents(c("p_retailprice")).alias("cents"), currency.alias("currency"), F.lit(NOW).alias("observed_at"))
    owned = table(spark, d, "lineitem").where("l_quantity > 47 AND l_returnflag = 'A'").select(c("l_partkey").alias("print_id"), c("l_quantity").alias("quantity"))
    return pricing.set_value(prices, owned, ["p_brand"], "print_id", "EUR").drop("as_of")
