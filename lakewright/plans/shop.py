"""Questions about a catalog, asked of the driver's tables: nations are sets, parts are cards with two prints each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.sources import feeds
from lakewright.sources.scratch import scratch
from lakewright.sources.search_index import SearchIndex
from lakewright.sources.tables import dealt, table

from . import catalog as q
from .registry import query

c = F.col

_SETS = """
sets AS (SELECT n_nationkey AS id, n_regionkey AS game_id, left(n_name, 3) AS code, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN DATE '2001-01-01' + n_nationkey * 20 END AS released_on,
  TIMESTAMP '2001-02-01' + INTERVAL 1 DAY * n_nationkey AS created_at, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END AS localized_name FROM nation)"""
_PRINTS = """
prints AS (SELECT p_partkey * 2 + k AS id, p_partkey AS card_id, (p_partkey + k * 7) % 25 AS set_id, CAST(p_partkey % 100 AS VARCHAR) AS number, CASE p_size % 4 WHEN 0 THEN 'common' WHEN 1 THEN 'rare' WHEN 2 THEN 'promo' END AS rarity,
  CASE WHEN p_partkey % 3 = 0 THEN ['foil'] ELSE ['normal', 'foil'] END AS finishes, p_name AS card_name, p_size % 5 AS game_id FROM part, (VALUES (0), (1)) v(k))"""
_PRICES = """
prices AS (SELECT l_partkey * 2 + l_linenumber % 2 AS print_id, CASE l_returnflag WHEN 'A' THEN 'foil' ELSE 'normal' END AS finish, CASE WHEN l_linenumber <= 3 THEN 'cardmarket' ELSE 'tcgplayer' END AS source,
  CASE WHEN l_tax < 0.03 THEN 'de' WHEN l_tax < 0.06 THEN 'en' ELSE 'fr' END AS lang, CASE WHEN l_linenumber <= 3 THEN 'EUR' ELSE 'USD' END AS currency,
  CAST(max(floor(l_extendedprice * 100 + 0.5)) AS BIGINT) AS cents_market, max(l_shipdate) AS observed_at FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    n = c("l_linenumber")
    lang = F.when(c("l_tax") < 0.03, "de").when(c("l_tax") < 0.06, "en").otherwise("fr")
    keys = [
        (c("l_partkey") * 2 + n % 2).alias("print_id"), F.when(c("l_returnflag") == "A", "foil").otherwise("normal").alias("finish"),
        F.when(n <= 3, "cardmarket").otherwise("tcgplayer").alias("source"), lang.alias("lang"), F.when(n <= 3, "EUR").otherwise("USD").alias("currency"),
    ]
    return table(spark, d, "lineitem").groupBy(*keys).agg(F.max(F.floor(c("l_extendedprice") * 100 + 0.5)).cast("long").alias("cents_market"), F.max("l_shipdate").alias("observed_at"))


def shop(spark: SparkSession, d: str) -> q.Catalog:
    nation, part, k = table(spark, d, "nation"), table(spark, d, "part"), c("n_nationkey")
    region = table(spark, d, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name"), F.lit("standard").alias("card_format"), c("r_regionkey").alias("sort"))
    released = F.when(k % 4 != 0, F.date_add(F.lit("2001-01-01").cast("date"), k * 20))
    created = F.lit("2001-02-01").cast("timestamp") + F.make_dt_interval(k)
    sets = nation.select(k.alias("id"), c("n_regionkey").alias("game_id"), F.left("n_name", F.lit(3)).alias("code"), c("n_name").alias("name"), released.alias("released_on"), created.alias("created_at"))
    local = nation.where(k % 3 == 0).select(k.alias("set_id"), F.lit("de").alias("lang"), F.lower("n_name").alias("name"))
    status = F.when(c("p_size") % 4 == 0, "Forbidden").when(c("p_size") % 4 == 1, "Limited").when(c("p_size") % 4 == 2, "Legal")
    legal = F.when(status.isNotNull(), F.create_map(F.lit("goat"), status))
    cards = part.select(c("p_partkey").alias("id"), (c("p_size") % 5).alias("game_id"), c("p_name").alias("name"), c("p_type").alias("type_line"), c("p_brand").alias("text"), legal.alias("legalities"))
    rarity = F.when(c("p_size") % 4 == 0, "common").when(c("p_size") % 4 == 1, "rare").when(c("p_size") % 4 == 2, "promo")
    finishes = F.when(c("p_partkey") % 3 == 0, F.array(F.lit("foil"))).otherwise(F.array(F.lit("normal"), F.lit("foil")))
    prints = part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (c("p_partkey") * 2 + c("k")).alias("id"), c("p_partkey").alias("card_id"), ((c("p_partkey") + c("k") * 7) % 25).cast("int").alias("set_id"), (c("p_partkey") % 100).cast("string").alias("number"),
        F.lit("").alias("variant"), rarity.alias("rarity"), finishes.alias("finishes"), F.lit(None).cast("date").alias("released_on"), F.create_map(F.lit("id"), c("p_brand")).alias("external_ids"),
    )
    names = prints.where(c("id") % 3 == 0).join(dealt(cards.select(c("id").alias("card_id"), "name")), "card_id").select(c("id").alias("print_id"), F.lit("de").alias("lang"), F.reverse("name").alias("name"), F.lit(None).cast("string").alias("text"))
    return q.Catalog(region, sets, local, cards, prints, names, prices(spark, d))


@query("SELECT r_regionkey AS id, r_name AS name, 'standard' AS card_format, count(n_nationkey) AS set_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def catalog_games(spark: SparkSession, d: str) -> DataFrame:
    return q.list_games(shop(spark, d)).drop("sort")


@query(f"WITH {_SETS} SELECT id, code, name, localized_name, CAST(released_on AS VARCHAR) AS released_on FROM sets WHERE game_id = 2")
def catalog_sets(spark: SparkSession, d: str) -> DataFrame:
    return q.list_sets(shop(spark, d), 2, "de").select("id", "code", "name", "localized_name", c("released_on").cast("string").alias("released_on"))


@query(f"""
WITH {_SETS}, fresh AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY released_on DESC NULLS LAST, created_at DESC, code) AS nth FROM sets s WHERE released_on BETWEEN DATE '2001-03-01' AND DATE '2002-03-01'
  OR (released_on IS NULL AND created_at >= DATE '2001-02-05' AND created_at > (SELECT min(created_at) FROM sets o WHERE o.game_id = s.game_id) + INTERVAL 1 DAY AND created_at >= DATE '2001-03-01'))
SELECT game_id, id, code FROM fresh WHERE nth <= 3""")
def catalog_new_sets(spark: SparkSession, d: str) -> DataFrame:
    return q.new_sets(shop(spark, d), "de", "2001-03-01", "2002-03-01", 3).select("game_id", "id", "code")


@query(f"""
WITH {_PRINTS}, own AS (SELECT * FROM prints WHERE set_id = 7)
SELECT 'rarity' AS facet, rarity AS value, count(*) AS n FROM own WHERE rarity IS NOT NULL GROUP BY 2
UNION ALL SELECT 'finish', f, count(*) FROM (SELECT unnest(finishes) AS f FROM own) GROUP BY 2
UNION ALL SELECT DISTINCT 'language', 'de', CAST(1 AS BIGINT) FROM own WHERE id % 3 = 0""")
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return q.set_facets(shop(spark, d), 7)


@query(f"""
WITH {_PRINTS}, {_PRICES}, shown AS (SELECT DISTINCT ON (p.id) p.id, r.cents_market AS cents, r.currency, r.source FROM prints p JOIN prices r ON r.print_id = p.id WHERE p.set_id = 7
  ORDER BY p.id, CASE WHEN r.finish = CASE WHEN list_contains(p.finishes, 'normal') THEN 'normal' ELSE 'foil' END THEN 1 WHEN list_contains(p.finishes, r.finish) THEN 1 + list_position(p.finishes, r.finish) ELSE 1001 END, r.finish,
    CASE r.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE r.source WHEN 'cardmarket' THEN 0 WHEN 'tcgplayer' THEN 1 ELSE 2 END, r.lang)
SELECT p.id, CASE WHEN p.id % 3 = 0 THEN reverse(card_name) ELSE card_name END AS name, number, s.cents, s.currency, s.source FROM prints p LEFT JOIN shown s ON s.id = p.id WHERE set_id = 7
ORDER BY CAST(number AS INTEGER), number, p.id LIMIT 40""")
def catalog_set_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a set by number; numbers are unique on a page of small tables only, so the id breaks ties."""
    k = shop(spark, d)
    k.prints = k.prints.withColumn("variant", F.lpad(c("id").cast("string"), 12, "0"))
    page = q.set_page(k, 7, lang="de", currency="EUR", size=40)
    return page.select("id", "name", "number", *(c("market")[x].alias(x) for x in ("cents", "currency", "source")))


@query(f"WITH {_PRICES} SELECT DISTINCT ON (print_id, source, finish) print_id, source, finish, lang, cents_market FROM prices ORDER BY print_id, source, finish, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang")
def catalog_print_prices(spark: SparkSession, d: str) -> DataFrame:
    return q.print_prices(shop(spark, d), lang="de").select("print_id", "source", "finish", "lang", "cents_market")


@query("SELECT p_partkey AS id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'Forbidden' ELSE 'Limited' END AS status FROM part WHERE p_size % 4 IN (0, 1)")
def catalog_banlist(spark: SparkSession, d: str) -> DataFrame:
    return q.banlist(shop(spark, d).cards, "goat")


@query(f"""
WITH {_SETS}, {_PRINTS}, entries AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % (SELECT 2 * max(p_partkey) FROM part) + 2 AS print_id FROM orders)
SELECT e.id, e.print_id, p.card_id, s.code AS set_code FROM entries e JOIN prints p ON p.id = e.print_id JOIN sets s ON s.id = p.set_id
WHERE contains(lower(p.card_name), 'an') OR lower(s.code) = 'an' OR p.number = 'an' OR (p.id % 3 = 0 AND contains(lower(reverse(p.card_name)), 'an'))""")
def catalog_collection_rows(spark: SparkSession, d: str) -> DataFrame:
    most = table(spark, d, "part").agg(2 * F.max("p_partkey")).first()[0]
    entries = table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("user_id"), (c("o_orderkey") % most + 2).alias("print_id"))
    return q.collection_rows(shop(spark, d), entries, "an").select("id", "print_id", "card_id", "set_code")


@query("""
WITH spine AS (SELECT CAST(unnest(generate_series(DATE '1995-01-10', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
landed AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE NOT (l_shipdate >= DATE '2000-08-10' AND l_shipdate < DATE '2000-08-20')),
marked AS (SELECT s.day, l.day IS NOT NULL AS has, sum(CASE WHEN l.day IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY s.day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS gaps FROM spine s LEFT JOIN landed l USING (day))
SELECT CAST(day AS VARCHAR) AS day FROM marked m WHERE has AND date_part('day', day) > 2 AND day < (SELECT coalesce(min(day), DATE '9999-01-01') FROM marked WHERE gaps >= 6)""")
def backfill_days(spark: SparkSession, d: str) -> DataFrame:
    """The days that a backfill takes before six days in a row are missing; the first two of each month are there already."""
    spine = feeds.days(spark, "1995-01-10", "2001-12-31")
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    landed = days.where("NOT (day >= DATE'2000-08-10' AND day < DATE'2000-08-20')")
    done = spine.where(F.dayofmonth("day") <= 2)
    return feeds.backfill_days(spine, landed, done, 6).select(c("day").cast("string").alias("day"))


#: The price to show for a print, in German and euros, as the set page has it.
_SHOWN = """
shown AS (SELECT DISTINCT ON (p.id) p.id, r.cents_market AS cents, r.source FROM prints p JOIN prices r ON r.print_id = p.id
  ORDER BY p.id, CASE WHEN r.finish = CASE WHEN list_contains(p.finishes, 'normal') THEN 'normal' ELSE 'foil' END THEN 1 WHEN list_contains(p.finishes, r.finish) THEN 1 + list_position(p.finishes, r.finish) ELSE 1001 END, r.finish,
    CASE r.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE r.source WHEN 'cardmarket' THEN 0 WHEN 'tcgplayer' THEN 1 ELSE 2 END, r.lang)"""


@query(f"""
WITH {_SETS}, {_PRINTS}, {_PRICES}, {_SHOWN}
SELECT p.id, s.code AS set_code, s.name AS set_name, p.number, CASE WHEN p.id % 3 = 0 THEN reverse(p.card_name) END AS german, h.cents, h.source
FROM prints p JOIN sets s ON s.id = p.set_id LEFT JOIN shown h ON h.id = p.id WHERE p.card_id = 9""")
def catalog_card_prints(spark: SparkSession, d: str) -> DataFrame:
    """A card's prints with their sets, localizations and prices."""
    rows = q.card_prints(shop(spark, d), 9, lang="de", currency="EUR")
    german = F.get(F.filter("localizations", lambda x: x["lang"] == "de"), F.lit(0))["name"]
    return rows.select("id", "set_code", "set_name", "number", german.alias("german"), *(c("market")[x].alias(x) for x in ("cents", "source")))


@query(rf"""
WITH {_SETS}, {_PRINTS}, {_PRICES}, {_SHOWN},
texts AS (SELECT p.id, 'en' AS lang, p_name AS name, concat_ws(' ', p_name, p_type, p_brand) AS body FROM prints p JOIN part ON p_partkey = card_id
  UNION ALL SELECT p.id, 'de', reverse(card_name), reverse(card_name) FROM prints p WHERE p.id % 3 = 0),
words AS (SELECT id, lang, regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+') AS n, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM texts),
hits AS (SELECT id, lang, CASE WHEN (list_contains(n, 'red') AND len(list_filter(n, lambda x: starts_with(x, 'ri'))) > 0) OR list_contains(n, 'deeps') OR (list_contains(n, 'der') AND NOT list_contains(n, 'gnir')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + round(len(list_filter(w, lambda x: starts_with(x, 'red') OR starts_with(x, 'ri') OR starts_with(x, 'der') OR starts_with(x, 'deeps'))) / greatest(len(w), 1), 6) AS rank FROM words
  WHERE list_contains(w, 'deeps') OR (list_contains(w, 'der') AND NOT list_contains(w, 'gnir')) OR (list_contains(w, 'red') AND len(list_filter(w, lambda x: starts_with(x, 'ri'))) > 0)),
best AS (SELECT id, max(rank) AS rank FROM hits GROUP BY 1),
langs AS (SELECT h.id, list_sort(list(DISTINCT h.lang)) AS langs FROM hits h JOIN best b ON b.id = h.id AND b.rank = h.rank GROUP BY 1)
SELECT p.id, round(b.rank, 6) AS rank, s.code AS set_code, CASE WHEN list_contains(l.langs, 'de') THEN 'de' ELSE 'en' END AS lang, CASE WHEN list_contains(l.langs, 'de') AND p.id % 3 = 0 THEN reverse(p.card_name) ELSE p.card_name END AS name, h.cents, h.source
FROM best b JOIN langs l USING (id) JOIN prints p USING (id) JOIN sets s ON s.id = p.set_id LEFT JOIN shown h USING (id)
ORDER BY b.rank DESC, p.card_name, s.released_on DESC NULLS LAST, s.code, CAST(p.number AS INTEGER), p.number, p.id LIMIT 60""")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a search with alternatives, a negated word and a prefix, over names in two languages, types and texts."""
    k = shop(spark, d)
    k.prints = k.prints.withColumn("variant", F.lpad(c("id").cast("string"), 12, "0"))
    page = q.search_prints(k, "deeps or der -gnir or red ri", lang="de", currency="EUR")
    return page.select("id", F.round("rank", 6).alias("rank"), "set_code", "lang", "name", *(c("market")[x].alias(x) for x in ("cents", "source")))


@query(rf"""
WITH {_PRINTS}, words AS (SELECT p.id, regexp_extract_all(lower(concat_ws(' ', p_name, CASE WHEN p.id % 3 = 0 THEN reverse(p_name) END, p_type, p_brand)), '[\p{{L}}\p{{N}}]+') AS w FROM prints p JOIN part ON p_partkey = card_id WHERE p.set_id <> 4)
SELECT id FROM words WHERE list_contains(w, 'deeps') OR (list_contains(w, 'der') AND NOT list_contains(w, 'gnir')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' red ring ')""")
def catalog_index_search(spark: SparkSession, d: str) -> DataFrame:
    """A catalog's search index, set by set; one set goes, then a search from the lists of words and positions."""
    rows = q.index_rows(shop(spark, d))
    index = SearchIndex(spark, scratch(spark, "catalog-index"))
    index.refresh(rows)
    index.refresh(rows.where("group != '4'"))
    return index.search('deeps or der -gnir or "red ring"').select(c("key").alias("id"))


_DAILY = """
daily AS (SELECT l_partkey AS print_id, CASE l_returnflag WHEN 'A' THEN 'foil' ELSE 'normal' END AS finish, CASE WHEN l_linenumber <= 3 THEN 'cardmarket' ELSE 'tcgplayer' END AS source, CASE WHEN l_linenumber <= 3 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN l_tax < 0.03 THEN 'de' WHEN l_tax < 0.06 THEN 'en' ELSE 'fr' END AS lang, CAST(l_shipdate AS DATE) AS day, CAST(max(floor(l_extendedprice * 100 + 0.5)) AS BIGINT) AS market FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6)"""


@query(f"""
WITH {_DAILY}, one AS (SELECT DISTINCT ON (print_id, source, finish, day) * FROM daily WHERE day >= DATE '2001-06-30' - 900 ORDER BY print_id, source, finish, day, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang),
placed AS (SELECT *, row_number() OVER (PARTITION BY print_id, source, finish, currency, CASE WHEN DATE '2001-06-30' - day <= 180 THEN 'd' || (day - DATE '1970-01-01') ELSE 'w' || ((day - DATE '1970-01-01') + 3) // 7 END ORDER BY day DESC) AS nth FROM one)
SELECT print_id, source, finish, currency, lang, CAST(day AS VARCHAR) AS day, market FROM placed WHERE nth = 1""")
def catalog_price_history(spark: SparkSession, d: str) -> DataFrame:
    """Price series of all prints: daily for half a year, weekly before."""
    n = c("l_linenumber")
    lang = F.when(c("l_tax") < 0.03, "de").when(c("l_tax") < 0.06, "en").otherwise("fr")
    keys = [
        c("l_partkey").alias("print_id"), F.when(c("l_returnflag") == "A", "foil").otherwise("normal").alias("finish"), F.when(n <= 3, "cardmarket").otherwise("tcgplayer").alias("source"),
        F.when(n <= 3, "EUR").otherwise("USD").alias("currency"), lang.alias("lang"), c("l_shipdate").alias("observed_at"),
    ]
    daily = table(spark, d, "lineitem").groupBy(*keys).agg(F.max(F.floor(c("l_extendedprice") * 100 + 0.5)).cast("long").alias("market"))
    return q.price_history(daily, lang="de", today="2001-06-30", days=900).select("print_id", "source", "finish", "currency", "lang", c("day").cast("string").alias("day"), "market")


@query("""
WITH cards AS (SELECT p_partkey AS card_id, CASE p_size % 4 WHEN 0 THEN 'Forbidden' WHEN 1 THEN 'Limited' WHEN 2 THEN 'Legal' END AS status FROM part),
changes AS (SELECT l_partkey AS card_id, max(l_shipdate) AS changed FROM lineitem WHERE l_linenumber <= 2 AND l_shipdate >= TIMESTAMP '2000-06-01'
  AND coalesce(CASE l_returnflag WHEN 'A' THEN 'Limited' WHEN 'R' THEN NULL ELSE 'Forbidden' END, 'Unlimited') <> CASE l_linestatus WHEN 'O' THEN 'Limited' ELSE 'Unlimited' END GROUP BY 1),
held AS (SELECT o_custkey % 50 AS owner, p_partkey AS card_id, CAST(sum(1 + o_orderkey % 3) AS BIGINT) AS copies FROM orders JOIN part ON p_partkey = (o_orderkey % (SELECT 2 * max(p_partkey) FROM part) + 2) // 2 GROUP BY 1, 2),
used AS (SELECT l_suppkey AS owner, l_partkey AS card_id, CAST(sum(1 + l_linenumber % 3) AS BIGINT) AS copies FROM lineitem GROUP BY 1, 2),
allowed AS (SELECT card_id, CASE status WHEN 'Forbidden' THEN 0 WHEN 'Limited' THEN 1 WHEN 'Legal' THEN 3 END AS allowed FROM cards)
SELECT 'collection' AS kind, owner, card_id, copies, allowed, CAST(CAST(changed AS DATE) AS VARCHAR) AS changed FROM held JOIN changes USING (card_id) JOIN allowed USING (card_id)
UNION ALL SELECT 'deck', owner, card_id, copies, allowed, CAST(CAST(changed AS DATE) AS VARCHAR) FROM used JOIN allowed USING (card_id) LEFT JOIN changes USING (card_id) WHERE changed IS NOT NULL OR copies > allowed""")
def catalog_ban_impact(spark: SparkSession, d: str) -> DataFrame:
    """Owned cards with a change of their status, and deck cards with one or over the limit."""
    k, lines, n = shop(spark, d), table(spark, d, "lineitem"), c("l_linenumber")
    from_status = F.when(c("l_returnflag") == "A", "Limited").when(c("l_returnflag") != "R", "Forbidden")
    changes = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), c("l_partkey").alias("card_id"), F.when(n <= 2, "goat").otherwise("other").alias("format"), from_status.alias("from_status"),
        F.when(c("l_linestatus") == "O", "Limited").otherwise("Unlimited").alias("to_status"), c("l_shipdate").cast("timestamp").alias("seen_at"),
    )
    most = table(spark, d, "part").agg(2 * F.max("p_partkey")).first()[0]
    collection = table(spark, d, "orders").select((c("o_custkey") % 50).alias("user_id"), (c("o_orderkey") % most + 2).alias("print_id"), (1 + c("o_orderkey") % 3).alias("quantity"))
    decks = lines.select(c("l_suppkey").alias("deck_id"), c("l_partkey").alias("card_id"), (1 + n % 3).alias("quantity"))
    rows = q.banlist_impact(k.cards, changes, collection, k.prints, decks, "goat", "2000-06-01")
    return rows.select("kind", "owner", "card_id", "copies", "allowed", F.to_date("changed").cast("string").alias("changed"))


_DECKS = "decks AS (SELECT l_suppkey AS deck_id, l_partkey AS card_id, CASE l_returnflag WHEN 'A' THEN 'main' WHEN 'R' THEN 'side' ELSE 'attic' END AS zone, 1 + l_linenumber % 3 AS quantity FROM lineitem)"


@query(f"""
WITH {_DECKS}, cards AS (SELECT decks.*, p_name AS name FROM decks JOIN part ON p_partkey = card_id),
ids AS (SELECT DISTINCT deck_id FROM cards), zones(zone, least, most) AS (VALUES ('main', 60, 60), ('side', NULL, 15), ('extra', 1, NULL)),
counts AS (SELECT deck_id, zone, sum(quantity) AS n FROM cards GROUP BY 1, 2),
sizes AS (SELECT i.deck_id, z.zone AS name, coalesce(n, 0) AS n, least, most FROM ids i, zones z LEFT JOIN counts k ON k.deck_id = i.deck_id AND k.zone = z.zone)
SELECT deck_id, CASE WHEN least = most THEN 'wrong_size' WHEN n < least THEN 'too_few' ELSE 'too_many' END AS code, name, CAST(n AS BIGINT) AS n FROM sizes WHERE CASE WHEN least = most THEN n <> least WHEN n < least THEN true ELSE n > most END
UNION ALL SELECT deck_id, 'wrong_zone', name, CAST(sum(quantity) AS BIGINT) FROM cards WHERE zone = 'attic' GROUP BY 1, 3
UNION ALL SELECT deck_id, 'too_many_copies', name, CAST(sum(quantity) AS BIGINT) FROM cards GROUP BY 1, 3 HAVING sum(quantity) > 4""")
def catalog_deck_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with every deck: sizes of zones, strange zones, too many copies of a name."""
    k, zones = shop(spark, d), spark.createDataFrame([("main", 60, 60), ("side", None, 15), ("extra", 1, None)], "zone string, least int, most int")
    problems, _ = q.deck_analysis(k, decks(spark, d), entries(spark, d), zones, F.lit(4), "EUR")
    return problems.groupBy("deck_id", "code", "name").agg(F.sum("n").alias("n"))


def decks(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(c("l_returnflag") == "A", "main").when(c("l_returnflag") == "R", "side").otherwise("attic")
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("deck_id"), c("l_partkey").alias("card_id"), zone.alias("zone"), (1 + c("l_linenumber") % 3).alias("quantity"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    most = table(spark, d, "part").agg(2 * F.max("p_partkey")).first()[0]
    return table(spark, d, "orders").select((c("o_custkey") % 50).alias("user_id"), (c("o_orderkey") % most + 2).alias("print_id"), F.lit(1).alias("quantity"))


@query(f"""
WITH {_PRINTS}, {_PRICES}, {_DECKS}, need AS (SELECT deck_id, p_name AS name, sum(quantity) AS needed FROM decks JOIN part ON p_partkey = card_id GROUP BY 1, 2),
have AS (SELECT p_name AS name, count(*) AS owned FROM orders JOIN part ON p_partkey = (o_orderkey % (SELECT 2 * max(p_partkey) FROM part) + 2) // 2 WHERE o_custkey % 50 = 3 GROUP BY 1),
cheap AS (SELECT DISTINCT ON (card_name) card_name AS name, print_id, cents_market AS market FROM prices JOIN prints ON prints.id = print_id WHERE currency = 'EUR' AND cents_market IS NOT NULL ORDER BY card_name, cents_market, print_id)
SELECT deck_id, name, CAST(needed AS BIGINT) AS needed, coalesce(owned, 0) AS owned, CAST(needed - coalesce(owned, 0) AS BIGINT) AS missing, print_id, market FROM need LEFT JOIN have USING (name) LEFT JOIN cheap USING (name) WHERE needed > coalesce(owned, 0)""")
def catalog_deck_missing(spark: SparkSession, d: str) -> DataFrame:
    """Each deck's cards that one user's collection lacks, with the cheapest print."""
    k, zones = shop(spark, d), spark.createDataFrame([("main", 60, 60)], "zone string, least int, most int")
    few = entries(spark, d).where("user_id = 3")
    return q.deck_analysis(k, decks(spark, d), few, zones, F.lit(4), "EUR")[1].select("deck_id", "name", "needed", "owned", "missing", "print_id", "market")


@query(f"""
WITH {_PRINTS}, {_PRICES},
held AS (SELECT o_orderkey AS entry_id, o_custkey % 100 AS user_id, p.id AS print_id, p.finishes, CASE o_custkey % 2 WHEN 0 THEN 'de' ELSE 'fr' END AS lang, 1 + o_orderkey % 3 AS quantity,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 1.05::DOUBLE WHEN '2' THEN 1.0::DOUBLE WHEN '3' THEN 0.85::DOUBLE WHEN '4' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS factor
  FROM orders JOIN prints p ON p.id = o_orderkey % (SELECT 2 * max(p_partkey) FROM part) + 2),
ranked AS (SELECT e.*, r.source, r.currency, CAST(floor(r.cents_market * e.factor + 0.5) AS BIGINT) AS unit_cents, row_number() OVER (PARTITION BY e.entry_id ORDER BY
  CASE WHEN r.finish = 'foil' THEN 0 WHEN r.finish = CASE WHEN list_contains(e.finishes, 'normal') THEN 'normal' ELSE 'foil' END THEN 1 WHEN list_contains(e.finishes, r.finish) THEN 1 + list_position(e.finishes, r.finish) ELSE 1001 END, r.finish,
  CASE r.lang WHEN e.lang THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE r.source WHEN 'cardmarket' THEN 0 WHEN 'tcgplayer' THEN 1 ELSE 2 END, r.lang) AS nth FROM held e LEFT JOIN prices r USING (print_id)),
one AS (SELECT * FROM ranked WHERE nth = 1),
whole AS (SELECT user_id, CAST(sum(quantity) AS BIGINT) AS cards, count(*) AS entries, CAST(coalesce(sum(quantity) FILTER (WHERE unit_cents IS NULL), 0) AS BIGINT) AS unpriced FROM one GROUP BY 1)
SELECT user_id, source, currency, CAST(sum(unit_cents * quantity) AS BIGINT) AS cents, any_value(cards) AS cards, any_value(entries) AS entries, any_value(unpriced) AS unpriced FROM one JOIN whole USING (user_id) WHERE unit_cents IS NOT NULL GROUP BY 1, 2, 3""")
def catalog_collection_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each user's collection is worth by source and currency, with its copies, entries and unpriced copies."""
    most = table(spark, d, "part").agg(2 * F.max("p_partkey")).first()[0]
    grade = F.left("o_orderpriority", F.lit(1))
    condition = F.when(grade == "1", "MT").when(grade == "2", "NM").when(grade == "3", "EX").when(grade == "4", "GD").otherwise("PO")
    held = table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), (c("o_custkey") % 100).alias("user_id"), (c("o_orderkey") % most + 2).alias("print_id"), F.lit("foil").alias("finish"),
        F.when(c("o_custkey") % 2 == 0, "de").otherwise("fr").alias("language"), condition.alias("condition"), (1 + c("o_orderkey") % 3).alias("quantity"),
    )
    whole, worth = q.collection_summary(shop(spark, d), held, "EUR", ["user_id"])
    return worth.drop("as_of").join(whole, "user_id")
