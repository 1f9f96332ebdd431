"""Search, similarity, entity resolution, feeds and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.text import contains_phrase, english_code, like_literal, parse_cents, plain_wikitext, slug, tokens, url_component
from lakewright.functions.values import ban_limit, csv_line, rotates
from lakewright.operators import feed, matching, search
from lakewright.sources.tables import table

from .registry import query

c = F.col

#: Trigrams of a name: each word padded with two blanks before and one after.
_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIMILARITY = "CAST(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0) AS FLOAT)"


@query(f"""
WITH q(typed) AS (VALUES ('smal rnig'), ('red wdget'), ('blue')), g AS (SELECT typed, {_GRAMS.format("typed")} AS a FROM q),
p AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS b FROM part)
SELECT typed, p_partkey, round({_SIMILARITY.format(a="a", b="b")}, 5) AS similarity FROM g, p WHERE {_SIMILARITY.format(a="a", b="b")} >= 0.3""")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt names against all: an equi-join on shared trigrams, then the exact similarity."""
    typed = spark.createDataFrame([("smal rnig",), ("red wdget",), ("blue",)], "typed string")
    near = search.similar_pairs(typed, table(spark, d, "part"), "typed", "typed", "p_partkey", "p_name")
    return near.withColumn("similarity", F.round("similarity", 5))


@query(f"""
WITH g AS (SELECT {_GRAMS.format("'smal rnig'")} AS a), p AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS b FROM part),
hits AS (SELECT p_partkey, gram FROM (SELECT p_partkey, unnest(b) AS gram FROM p) WHERE gram IN (SELECT unnest(a) FROM g)),
informative AS (SELECT gram FROM hits GROUP BY 1 HAVING count(*) <= greatest(1, (SELECT floor(0.2 * count(*)) FROM part))),
top AS (SELECT p_partkey FROM hits WHERE gram IN (SELECT gram FROM informative) GROUP BY 1 ORDER BY count(*) DESC, p_partkey LIMIT 500)
SELECT p_partkey, round({_SIMILARITY.format(a="a", b="b")}, 5) AS similarity FROM top JOIN p USING (p_partkey), g WHERE {_SIMILARITY.format(a="a", b="b")} >= 0.3""")
def trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A typo search by a posting list: informative trigrams look for 500 candidates, which are then compared."""
    part = table(spark, d, "part")
    found = search.fuzzy_search(part, search.trigram_postings(part, "p_partkey", "p_name"), "p_partkey", "p_name", "smal rnig")
    return found.select("p_partkey", F.round("similarity", 5).alias("similarity"))


_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
WITH p AS (SELECT p_partkey, {_TOKENS.format("p_name")} AS n, {_TOKENS.format("concat_ws(' ', p_name, p_type, p_brand)")} AS w FROM part),
m AS (SELECT *, ((list_contains(w, 'red') OR list_contains(w, 'promo')) AND NOT list_contains(w, 'ring')) AS x FROM p)
SELECT p_partkey, CASE WHEN (list_contains(n, 'red') AND NOT list_contains(n, 'ring') AND len(list_filter(n, lambda t: starts_with(t, 'wid'))) > 0) OR
    (list_contains(n, 'promo') AND len(list_filter(n, lambda t: starts_with(t, 'wid'))) > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  + round(len(list_filter(w, lambda t: starts_with(t, 'red') OR starts_with(t, 'promo') OR starts_with(t, 'brand'))) / greatest(len(w), 1), 6) AS score
FROM p WHERE (list_contains(w, 'red') AND NOT list_contains(w, 'ring')) OR (list_contains(w, 'promo') AND len(list_filter(w, lambda t: starts_with(t, 'brand'))) > 0)""".replace(
    """CASE WHEN (list_contains(n, 'red') AND NOT list_contains(n, 'ring') AND len(list_filter(n, lambda t: starts_with(t, 'wid'))) > 0) OR
    (list_contains(n, 'promo') AND len(list_filter(n, lambda t: starts_with(t, 'wid'))) > 0) THEN""",
    """CASE WHEN (list_contains(n, 'red') AND NOT list_contains(n, 'ring')) OR (list_contains(n, 'promo') AND len(list_filter(n, lambda t: starts_with(t, 'brand'))) > 0) THEN""",
).replace(
    """,
m AS (SELECT *, ((list_contains(w, 'red') OR list_contains(w, 'promo')) AND NOT list_contains(w, 'ring')) AS x FROM p)""", ""))
def token_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """A typed query with a negated word, "or", and a prefix; names count more than other text."""
    name, every = tokens(c("p_name")), tokens(c("p_name"), c("p_type"), c("p_brand"))
    return search.token_search(table(spark, d, "part"), "red -ring or promo brand", name, every).select("p_partkey", "score")


@query(f"SELECT p_partkey FROM part WHERE contains(' ' || array_to_string({_TOKENS.format('p_name')}, ' ') || ' ', ' red widget ')")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(contains_phrase(tokens(c("p_name")), ["red", "widget"])).select("p_partkey")


@query("""
WITH t AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS label, 0 AS tier, p_partkey AS ord FROM part WHERE p_name = 'red ring'
  UNION ALL SELECT 'part', p_partkey, p_name, 1, p_partkey FROM part WHERE starts_with(p_name, 'red')
  UNION ALL SELECT 'customer', c_custkey, c_name, 2, c_custkey FROM customer WHERE c_acctbal > 9900)
SELECT kind, id, label, tier FROM (SELECT kind, id, arg_min(label, (tier, ord)) AS label, min(tier) AS tier, arg_min(ord, (tier, ord)) AS ord FROM t GROUP BY 1, 2) ORDER BY tier, ord, kind, id LIMIT 20""")
def typeahead_tiers(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), c("p_partkey").alias("id"), c("p_name").alias("label"), c("p_partkey").alias("ord"))
    rich = table(spark, d, "customer").where("c_acctbal > 9900").select(F.lit("customer").alias("kind"), c("c_custkey").alias("id"), c("c_name").alias("label"), c("c_custkey").alias("ord"))
    tiers = [part.where("label = 'red ring'"), part.where(c("label").startswith("red")), rich]
    return search.suggest(tiers, ["kind", "id"], 20).select("kind", "id", "label", "tier")


@query("""
SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' AND p_brand LIKE 'Brand#1%' AND lower(p_type) = 'promo' AND regexp_matches(p_name, '^[a-m]')""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    hits = part.where(c("p_name").ilike(f"%{like_literal('RING')}%") & c("p_brand").startswith("Brand#1"))
    return hits.where((F.lower("p_type") == "promo") & c("p_name").rlike("^[a-m]")).select("p_partkey")


@query("""
SELECT s_suppkey, c_custkey, rule FROM (SELECT s_suppkey, c_custkey, rule, row_number() OVER (PARTITION BY s_suppkey ORDER BY k, c_custkey) AS nth FROM (
  SELECT s_suppkey, c_custkey, 0 AS k, 'balance' AS rule FROM supplier JOIN customer ON round(s_acctbal) = round(c_acctbal)
  UNION ALL SELECT s_suppkey, c_custkey, 1, 'number' FROM supplier JOIN customer ON right(s_name, 9) = right(c_name, 9))) WHERE nth = 1""")
def er_priority_rules(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to customers: by balance, else by number; the rule that hit is kept."""
    number = lambda x: F.right(c(x), F.lit(9))
    balance = lambda x: F.round(c(x)).cast("string")
    rules = [("balance", balance("s_acctbal"), balance("c_acctbal")), ("number", number("s_name"), number("c_name"))]
    return matching.by_rules(table(spark, d, "supplier"), table(spark, d, "customer"), "s_suppkey", "c_custkey", rules)


@query("""
WITH u AS (SELECT right(c_name, 2) AS k, min(c_custkey) AS c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
SELECT s_suppkey, c_custkey, 'number' AS rule FROM supplier JOIN u ON u.k = right(s_name, 2)""")
def er_unique_rule(spark: SparkSession, d: str) -> DataFrame:
    """A key that several rows have doesn't match."""
    number = lambda x: F.right(c(x), F.lit(2))
    building = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return matching.by_rules(table(spark, d, "supplier"), building, "s_suppkey", "c_custkey", [("number", number("s_name"), number("c_name"))], unique=True)


_MATCHES = """
m AS (SELECT DISTINCT l_partkey AS print_id, l_returnflag AS finish, l_suppkey AS product, CASE WHEN l_quantity > 45 THEN 100 WHEN l_quantity > 30 THEN 70 ELSE 40 END AS confidence FROM lineitem)"""


@query(f"""
WITH {_MATCHES}, b AS (SELECT *, max(confidence) OVER (PARTITION BY print_id, finish) AS best FROM m)
SELECT print_id, finish, min(product) AS product, min(confidence) AS confidence FROM b WHERE confidence = best GROUP BY 1, 2 HAVING count(*) = 1""")
def er_best_unique(spark: SparkSession, d: str) -> DataFrame:
    """The most confident product of each print; a tie leaves the print without."""
    sure = F.when(c("l_quantity") > 45, 100).when(c("l_quantity") > 30, 70).otherwise(40)
    matches = table(spark, d, "lineitem").select(c("l_partkey").alias("print_id"), c("l_returnflag").alias("finish"), c("l_suppkey").alias("product"), sure.alias("confidence")).distinct()
    return matching.best_unambiguous(matches, ["print_id", "finish"])


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_size, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT p_partkey, p_brand, word FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size, word) AS n FROM w) WHERE n = 1""")
def er_sole_holder(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return matching.sole_holder(part, F.split("p_name", " "), ["p_brand", "p_size"], "word").select("p_partkey", "p_brand", "word")


@query("""
WITH a AS (SELECT s_suppkey, min(c_custkey) AS c_custkey, 0 AS pass FROM supplier JOIN customer ON round(s_acctbal) = round(c_acctbal) GROUP BY 1),
b AS (SELECT s_suppkey, min(c_custkey) AS c_custkey, 1 AS pass FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a) GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def er_passes(spark: SparkSession, d: str) -> DataFrame:
    """A second pass sees only what the first one left."""
    customers = table(spark, d, "customer")
    least = lambda left, right, on: left.join(right, on).groupBy("s_suppkey").agg(F.min("c_custkey").alias("c_custkey"))
    balance = lambda df: least(df.withColumn("k", F.round("s_acctbal")), customers.select("c_custkey", F.round("c_acctbal").alias("k")), "k")
    nation = lambda df: least(df, customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", c("c_nationkey").alias("s_nationkey")), "s_nationkey")
    return matching.passes(table(spark, d, "supplier"), [balance, nation], "s_suppkey")


@query("""
SELECT p_name, arg_min(p_partkey, (-((CASE WHEN p_size > 25 THEN 2 ELSE 0 END) + (CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END)), p_partkey)) AS p_partkey FROM part GROUP BY 1""")
def reprint_families(spark: SparkSession, d: str) -> DataFrame:
    return matching.reprint_families(table(spark, d, "part"), "p_name", "p_partkey", c("p_size") > 25, c("p_type") == "PROMO")


@query("""
WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part),
a AS (SELECT s_suppkey, 'Brand#' || (s_nationkey % 25 + 1) AS p_brand, 'PROMO' AS p_type, row_number() OVER (PARTITION BY s_nationkey % 25 ORDER BY s_suppkey) AS nth FROM supplier)
SELECT s_suppkey, p_partkey FROM a JOIN r USING (p_brand, p_type, nth)""")
def er_each_once(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key are paired in order, so each side is used once."""
    left = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (c("s_nationkey") % 25 + 1).cast("string")).alias("p_brand"), F.lit("PROMO").alias("p_type"))
    return matching.paired_in_order(left, table(spark, d, "part"), ["p_brand", "p_type"], "s_suppkey", "p_partkey").select("s_suppkey", "p_partkey")


@query("SELECT event_id FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 500")
def sync_cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return feed.pull(table(spark, d, "events"), 250, sequence="event_id").select("event_id")


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderdate AS edited, o_orderstatus = 'F' AS gone, o_orderpriority AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
p AS (SELECT o_orderkey AS id, o_orderdate + CASE WHEN o_orderpriority = '2-HIGH' THEN INTERVAL 1 DAY ELSE INTERVAL '-1' DAY END AS edited, o_orderpriority = '3-MEDIUM' AS gone,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS base, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderpriority ELSE 'new' END AS v FROM orders),
j AS (SELECT p.*, s.id IS NULL AS none, s.gone AS s_gone, s.edited AS s_edited, s.v = p.v AND NOT s.gone AND NOT p.gone AS same FROM p LEFT JOIN s ON s.id = p.id)
SELECT id, CASE WHEN none AND gone THEN 'skip' WHEN none AND base IS NOT NULL THEN 'conflict' WHEN none THEN 'insert'
  WHEN same OR (s_gone AND gone) THEN 'noop'
  WHEN NOT s_gone AND base IS NOT NULL AND s_edited <= base THEN 'apply'
  WHEN gone AND edited > s_edited THEN CASE WHEN s_gone THEN 'insert' ELSE 'apply' END
  WHEN s_gone AND NOT gone AND edited > s_edited THEN 'insert' ELSE 'conflict' END AS action FROM j""")
def lww_resolve(spark: SparkSession, d: str) -> DataFrame:
    """What each pushed row does to the stored one, by last writer wins."""
    orders = table(spark, d, "orders")
    at = c("o_orderdate")
    stored = orders.where("o_orderpriority != '5-LOW'").select(c("o_orderkey").alias("id"), at.alias("updated_at"), F.when(c("o_orderstatus") == "F", at).alias("deleted_at"), c("o_orderpriority").alias("v"))
    moved = F.when(c("o_orderpriority") == "2-HIGH", at + F.expr("INTERVAL 1 DAY")).otherwise(at - F.expr("INTERVAL 1 DAY"))
    value = F.when(c("o_orderpriority") == "4-NOT SPECIFIED", c("o_orderpriority")).otherwise("new")
    pushed = orders.select(c("o_orderkey").alias("id"), moved.alias("updated_at"), F.when(c("o_orderpriority") == "3-MEDIUM", moved).alias("deleted_at"), F.when(c("o_orderstatus") == "O", at).alias("base_updated_at"), value.alias("v"))
    same = (c("s.v") == c("p.v")) & c("s.deleted_at").isNull() & c("p.deleted_at").isNull()
    return feed.resolve(stored, pushed, "id", same).select("id", "action")


@query("""
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2""")
def latest_per_day(spark: SparkSession, d: str) -> DataFrame:
    """At most one row for each user and day: the newest."""
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "ts", "event_id")
    return feed.latest(rows, ["user_id", "day"], "ts", "event_id").select("user_id", "day", "event_type")


@query("""
SELECT p_partkey, concat_ws(',', CAST(p_partkey AS VARCHAR), CASE WHEN regexp_matches(p_name || ', ' || p_type, '[",\\r\\n]') THEN '"' || replace(p_name || ', ' || p_type, '"', '""') || '"' ELSE p_name END, p_brand) AS line FROM part""")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """A line of a CSV file for each part; fields are quoted only where they must be."""
    return table(spark, d, "part").select("p_partkey", csv_line(c("p_partkey"), F.concat(c("p_name"), F.lit(", "), c("p_type")), c("p_brand")).alias("line"))


@query("SELECT s_suppkey, 'https://shop.invalid/?q=' || replace(replace(s_name, '#', '%23'), ' ', '%20') AS link, lower(replace(s_name, '#', '-')) AS slug FROM supplier")
def links_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://shop.invalid/?q="), url_component(c("s_name"))).alias("link"), slug(c("s_name")).alias("slug"))


@query("""
SELECT p_partkey, CAST(p_retailprice * 100 AS BIGINT) AS typed, CASE WHEN p_size < 20 THEN 'en' ELSE 'it' END || p_size AS code FROM part""".replace("CAST(p_retailprice * 100 AS BIGINT)", "CAST(round(round(p_retailprice, 2) * 100) AS BIGINT)").replace("CASE WHEN p_size < 20 THEN 'en' ELSE 'it' END || p_size", "CASE WHEN p_size < 20 THEN 'en' || p_size ELSE 'itx' || p_size END"))
def typed_forms(spark: SparkSession, d: str) -> DataFrame:
    """Typed prices ("1.234,50 EUR") in cents, and codes with their language token made English."""
    shown = F.concat(F.format_number(F.round("p_retailprice", 2), 2), F.lit(" EUR"))
    swapped = F.translate(shown, ".,", ",.")
    code = F.concat(F.when(c("p_size") < 20, "de").otherwise("itx"), c("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", parse_cents(swapped).alias("typed"), english_code(code).alias("code"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 END AS ban FROM orders")
def ban_limits(spark: SparkSession, d: str) -> DataFrame:
    p = c("o_orderpriority")
    status = F.when(p == "1-URGENT", "forbidden").when(p == "2-HIGH", "limited").when(p == "3-MEDIUM", "semi-limited").when(p == "4-NOT SPECIFIED", "watched")
    return table(spark, d, "orders").select("o_orderkey", ban_limit(status).alias("ban"))


@query("SELECT p_partkey, p_type || chr(10) || p_name || ' & co' AS plain FROM part")
def wikitext_plain(spark: SparkSession, d: str) -> DataFrame:
    wiki = F.concat(F.lit("''"), c("p_type"), F.lit("''<br/>[[Part:"), c("p_partkey").cast("string"), F.lit("|"), c("p_name"), F.lit("]] <i>&amp;</i> co "))
    return table(spark, d, "part").select("p_partkey", plain_wikitext(wiki).alias("plain"))


@query("""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
hashed AS (SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM customer)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM hashed, days WHERE h % 30 = (day - DATE '1970-01-01') % 30 GROUP BY 1""")
def fnv_rotation(spark: SparkSession, d: str) -> DataFrame:
    """How many customers' turns come on each of 30 days; tested against a brute-force hash."""
    day = F.explode(F.sequence(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30")))).alias("day")
    keys = table(spark, d, "customer").select("c_name", day)
    return keys.where(rotates(c("c_name"), c("day"))).groupBy(c("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2 FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(square, 4).alias("norm2"))
