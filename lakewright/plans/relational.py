"""Best rows, aggregates, windows, joins, sets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.text import code_key, number_key
from lakewright.functions.values import position, preference
from lakewright.operators import feed, matching, pick, snapshot
from lakewright.sources.tables import table

from .registry import query

c = F.col
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def long_count(name: str = "n"):
    return F.count("*").alias(name)


def best_first() -> list:
    return [(c("o_orderstatus") != "F").asc(), preference(c("o_orderpriority"), PRIORITIES).asc(), c("o_totalprice").desc_nulls_last(), c("o_orderkey").asc()]


@query("""
SELECT c.c_custkey, n.n_name, o.o_orderkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN LATERAL (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey
  ORDER BY o_orderstatus = 'F' DESC, o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1) o ON true""")
def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    """The order to show of each customer: settled ones first, then by priority and price."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").drop("o_orderdate")
    best = pick.lateral_best(table(spark, d, "customer"), orders, ["c_custkey"], best_first())
    named = best.join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return named.select("c_custkey", "n_name", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("""
SELECT n.n_nationkey, o.o_orderkey FROM nation n CROSS JOIN LATERAL (
  SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey = n.n_nationkey AND o_totalprice > 1000 * n.n_nationkey
  ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o""")
def cross_lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each nation that meets the nation's own bound."""
    sold = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
    fits = sold.join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).where(c("o_totalprice") > 1000 * c("n_nationkey"))
    return pick.distinct_on(fits, ["n_nationkey"], [c("o_orderdate").desc(), c("o_orderkey").asc()]).select("n_nationkey", "o_orderkey")


@query("SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderdate, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return pick.distinct_on(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [c("o_orderdate").asc(), c("o_orderkey").asc()]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT o_custkey, (array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS best_order FROM orders GROUP BY o_custkey")
def argbest_array_agg(spark: SparkSession, d: str) -> DataFrame:
    return pick.best_by(table(spark, d, "orders"), ["o_custkey"], c("o_orderkey"), F.struct(-c("o_totalprice"), c("o_orderkey")), "best_order")


@query("SELECT o_orderkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS best_settled FROM orders")
def window_max_filter(spark: SparkSession, d: str) -> DataFrame:
    return pick.max_where(table(spark, d, "orders"), ["o_custkey"], c("o_totalprice"), c("o_orderstatus") == "F", "best_settled").select("o_orderkey", "best_settled")


@query("""
SELECT o_orderkey, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderdate DESC, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_closed FROM orders""")
def first_value_full_frame(spark: SparkSession, d: str) -> DataFrame:
    order = [(c("o_orderstatus") == "O").asc(), c("o_orderdate").desc(), c("o_orderkey").asc()]
    return pick.first_of_all(table(spark, d, "orders"), ["o_custkey"], c("o_orderstatus"), order, "last_closed").select("o_orderkey", "last_closed")


@query("""
SELECT c_mktsegment, o_orderkey FROM (SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) AS nth
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE nth <= 8""")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    return pick.top_n(sold, ["c_mktsegment"], [c("o_orderdate").desc(), c("o_orderkey").asc()], 8).select("c_mktsegment", "o_orderkey")


@query("""
SELECT large, o_orderkey, nth FROM (SELECT o_totalprice > 100000 AS large, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_totalprice > 100000 ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS nth FROM orders) WHERE nth <= 20""")
def row_number_by_condition(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn("large", c("o_totalprice") > 100000)
    return pick.top_n(df, ["large"], [c("o_totalprice").asc(), c("o_orderkey").asc()], 20, rank="nth", keep_rank=True).select("large", "o_orderkey", "nth")


@query("""
SELECT o_orderkey, ord FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS ord FROM orders) WHERE ord <= 25""")
def ordinal_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 with their ordinals; the cut comes before the numbering, so one partition numbers 25 rows."""
    return pick.numbered(pick.page(table(spark, d, "orders"), [c("o_totalprice").desc(), c("o_orderkey").asc()], 25), [c("o_totalprice").desc(), c("o_orderkey").asc()], "ord").select("o_orderkey", "ord")


@query("""
SELECT o_custkey, orders, ord FROM (SELECT o_custkey, count(*) AS orders, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(o_totalprice) DESC, o_custkey) AS INTEGER) AS ord
  FROM orders GROUP BY o_custkey) WHERE ord <= 15""")
def rank_by_aggregate(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(long_count("orders"), F.sum(F.round(c("o_totalprice") * 100).cast("long")).alias("sum"))
    order = [c("orders").desc(), c("sum").desc(), c("o_custkey").asc()]
    return pick.numbered(pick.page(per, order, 15), order, "ord").select("o_custkey", "orders", "ord")


@query("""
WITH page AS (SELECT event_id, length(props) + length(event_type) AS size FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500),
run AS (SELECT *, sum(size) OVER (ORDER BY event_id) AS so_far, row_number() OVER (ORDER BY event_id) AS nth FROM page)
SELECT event_id, CAST(size AS INTEGER) AS size FROM run WHERE so_far <= 2000 OR nth = 1""")
def budget_page(spark: SparkSession, d: str) -> DataFrame:
    """The next page of a change feed, cut where its size exceeds a budget."""
    size = F.length("props") + F.length("event_type")
    return feed.pull(table(spark, d, "events"), 100, sequence="event_id", most=500, budget=2000, size=size).select("event_id", size.alias("size"))


@query("""
WITH run AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity
  ROWS UNBOUNDED PRECEDING) - l_quantity AS before FROM lineitem)
SELECT l_orderkey, CAST(floor(before / 40) AS BIGINT) AS chunk, count(*) AS lines, sum(l_quantity) AS quantity FROM run GROUP BY 1, 2""")
def chunks_by_size(spark: SparkSession, d: str) -> DataFrame:
    order = [c(x).asc() for x in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")]
    chunks = pick.greedy_chunks(table(spark, d, "lineitem"), ["l_orderkey"], order, c("l_quantity"), 40)
    return chunks.groupBy("l_orderkey", "chunk").agg(long_count("lines"), F.sum("l_quantity").alias("quantity"))


@query("SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    one = lambda name, column: pick.facet(part, c(column)).select(F.lit(name).alias("facet"), "value", "n")
    return one("brand", "p_brand").unionByName(one("type", "p_type"))


@query("SELECT word AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def facet_exploded(spark: SparkSession, d: str) -> DataFrame:
    return pick.exploded_facet(table(spark, d, "part"), F.split("p_name", " "))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def facet_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("""
WITH labels(bucket, label) AS (VALUES (0, '1-10'), (1, '11-20'), (2, '21-30'), (3, '31+')),
n AS (SELECT CAST(least(greatest(floor((p_size - 1) / 10), 0), 3) AS INTEGER) AS bucket, sum(p_size) AS n FROM part GROUP BY 1)
SELECT l.bucket, l.label, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM labels l LEFT JOIN n ON n.bucket = l.bucket""")
def histogram_clamped(spark: SparkSession, d: str) -> DataFrame:
    return pick.histogram(table(spark, d, "part"), (c("p_size") - 1) / 10, c("p_size"), ["1-10", "11-20", "21-30", "31+"], 0)


@query("""
WITH r AS (SELECT c_nationkey, c_custkey % 64 AS bucket, c_custkey, md5(concat_ws('|', c_custkey, c_name, c_mktsegment)) AS h FROM customer),
b AS (SELECT c_nationkey, bucket, md5(string_agg(h, ',' ORDER BY c_custkey)) AS h FROM r GROUP BY 1, 2)
SELECT c_nationkey, md5(string_agg(h, ',' ORDER BY bucket)) AS hash FROM b GROUP BY 1""")
def group_hash(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.group_hash(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], buckets=64)


@query("SELECT p_name, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_size HAVING count(*) = 1")
def having_single(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("p_partkey"), long_count()).where("n = 1").drop("n")


@query("""
WITH one AS (SELECT p_name, min(p_partkey) AS sole FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1)
SELECT p.p_partkey, one.sole FROM part p LEFT JOIN one ON one.p_name = p.p_name""")
def unique_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return pick.unique_lookup(part.select("p_partkey", "p_name"), part.select("p_name", c("p_partkey").alias("sole")), "p_name", "sole").select("p_partkey", "sole")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(large, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(large, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def not_in(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").where("l_quantity >= 49")
    return table(spark, d, "part").join(sold, c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 490000)")
def row_value_in(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    top = orders.where("o_totalprice > 490000").select("o_custkey", "o_orderstatus")
    return orders.join(top, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 8")
def corr_count(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return pick.with_count(table(spark, d, "customer"), orders, ["c_custkey"]).where("n < 8").select("c_custkey", "n")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return pick.exists_flag(table(spark, d, "customer"), keys, ["c_custkey"], "pending").select("c_custkey", "pending")


@query("SELECT r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 3 GROUP BY r_name")
def count_with_empty_groups(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").where("n_nationkey > 3").select(c("n_regionkey").alias("r_regionkey"))
    return pick.with_count(table(spark, d, "region"), nations, ["r_regionkey"], "nations").select("r_name", "nations")


@query("""
WITH exact AS (SELECT p_partkey FROM part WHERE p_name = 'no such part'), loose AS (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
SELECT p_partkey FROM exact UNION ALL SELECT p_partkey FROM loose WHERE NOT EXISTS (SELECT 1 FROM exact)""")
def fallback_branch(spark: SparkSession, d: str) -> DataFrame:
    """A looser search that runs only if the exact one finds nothing."""
    part = table(spark, d, "part")
    return pick.first_nonempty([part.where("p_name = 'no such part'"), part.where(c("p_name").startswith("red"))]).select("p_partkey")


@query("""
WITH q AS (SELECT c_custkey, substr(c_name, 10) AS typed FROM customer), cuts AS (SELECT c_custkey, typed, unnest(range(1, length(typed) + 1)) AS cut FROM q)
SELECT c_custkey, s_suppkey FROM cuts JOIN supplier ON substr(s_name, 10, 6) = substr(typed, 1, cut) AND starts_with(substr(s_name, 16), substr(typed, cut + 1))""")
def prefix_split_join(spark: SparkSession, d: str) -> DataFrame:
    """Typed codes against heads and tails: each query is split everywhere, then an equi-join on the head."""
    asked = table(spark, d, "customer").select("c_custkey", F.substring("c_name", 10, 99).alias("typed"))
    codes = table(spark, d, "supplier").select("s_suppkey", F.substring("s_name", 10, 6).alias("code"), F.substring("s_name", 16, 99).alias("number"))
    return matching.split_join(asked, "typed", codes, "code", "number").select("c_custkey", "s_suppkey")


_KEY = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


@query(f"""
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, replace({_KEY.format("c_name")}, 'customer', '') AS k FROM customer) c
JOIN (SELECT s_suppkey, replace({_KEY.format("s_name")}, 'supplier', '') AS k FROM supplier) s ON c.k = s.k""")
def functional_key_join(spark: SparkSession, d: str) -> DataFrame:
    key = lambda x, word: F.replace(code_key(c(x)), F.lit(word), F.lit(""))
    a = table(spark, d, "customer").select("c_custkey", key("c_name", "customer").alias("k"))
    return a.join(table(spark, d, "supplier").select("s_suppkey", key("s_name", "supplier").alias("k")), "k").select("c_custkey", "s_suppkey")


@query(f"""
SELECT c_custkey, {_KEY.format("c_name")} AS code_key,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(right(c_name, 9)), '[^a-z0-9]+', '', 'g'), '^[a-z]{{1,2}}([0-9])', '\\1'), '^0+([0-9a-z])', '\\1'), '') AS number_key FROM customer""")
def code_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", code_key(c("c_name")).alias("code_key"), number_key(F.right(c("c_name"), F.lit(9))).alias("number_key"))


@query("""
SELECT e.event_id, e.kind, o.name FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'customer' ELSE 'supplier' END AS kind, user_id AS id FROM events) e
LEFT JOIN (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) o ON o.kind = e.kind AND o.id = e.id""")
def polymorphic_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(c("event_type") == "purchase", "customer").otherwise("supplier").alias("kind"), c("user_id").alias("id"))
    named = {"customer": table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))}
    return pick.kind_join(rows, named).select("event_id", "kind", "name")


@query("""
SELECT DISTINCT b.source, coalesce(w.n, f.n, 0) AS n FROM documents b
LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source) w ON w.source = b.source
LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source) f ON f.source = b.source WHERE b.source IS NOT NULL""")
def lang_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The wanted language's value, else English, else the row's own."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    names = docs.where(c("lang").isin("de", "en")).groupBy("source", "lang").agg(long_count())
    return pick.localized(docs.select("source").distinct().withColumn("n", F.lit(0).cast("long")), names, "source", "de", name="n")


@query("SELECT a.o_orderkey, b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey")
def sibling_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the others of their customer and priority."""
    a = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return a.join(a.withColumnRenamed("o_orderkey", "sibling"), ["o_custkey", "o_orderpriority"]).where("o_orderkey != sibling").select("o_orderkey", "sibling")


@query("SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    df = df.join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return df.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT r_name, v.condition, v.factor FROM region CROSS JOIN (VALUES ('NM', 1.0::DOUBLE), ('EX', 0.85::DOUBLE)) v(condition, factor)")
def values_relation(spark: SparkSession, d: str) -> DataFrame:
    """A dimension of five rows against an inline relation of two, by an array of structs instead of a join."""
    inline = F.array(*(F.struct(F.lit(k).alias("condition"), F.lit(v).alias("factor")) for k, v in (("NM", 1.0), ("EX", 0.85))))
    return table(spark, d, "region").select("r_name", F.inline(inline))


@query("SELECT o_orderkey, k, CASE k WHEN 'status' THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, (VALUES ('status'), ('priority')) t(k)")
def object_keys_relation(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("status"), c("o_orderstatus"), F.lit("priority"), c("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(m).alias("k", "v"))


@query("""
SELECT CAST(s.day AS VARCHAR) AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day) s
LEFT JOIN events ON CAST(ts AS DATE) = s.day GROUP BY 1""")
def day_spine(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2023-12-30")), F.to_date(F.lit("2024-02-02")))).alias("day"))
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"))
    return pick.with_count(days, events, ["day"]).select(c("day").cast("string").alias("day"), "n")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(c("n_nationkey").alias("k")).unionByName(table(spark, d, "region").select(c("r_regionkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return union_all(spark, d).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(c("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return pick.page(table(spark, d, "orders"), [c("o_totalprice").desc_nulls_last(), c("o_orderkey").asc()], 20, 3).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    return pick.keyset_page(table(spark, d, "orders"), "o_orderkey", 500, 50).select("o_orderkey", "o_totalprice")


@query("SELECT p.p_partkey, (SELECT count(*) FROM part WHERE p_size > 25) AS total FROM part p WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    return pick.page_with_total(table(spark, d, "part").where("p_size > 25"), [c("p_retailprice").desc(), c("p_partkey").asc()], 30).select("p_partkey", "total")


@query("""
(SELECT 'part' AS kind, p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL
(SELECT 'customer', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7)""")
def limit_in_branches(spark: SparkSession, d: str) -> DataFrame:
    parts = pick.page(table(spark, d, "part"), [c("p_retailprice").desc(), c("p_partkey").asc()], 5).select(F.lit("part").alias("kind"), c("p_partkey").alias("id"))
    return parts.unionByName(pick.page(table(spark, d, "customer"), [c("c_acctbal").desc(), c("c_custkey").asc()], 7).select(F.lit("customer").alias("kind"), c("c_custkey").alias("id")))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
  CAST(min(l_shipdate) AS VARCHAR) AS first_day, CAST(max(l_shipdate) AS VARCHAR) AS last_day, bool_or(l_tax > 0.07) AS any_taxed,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2""")
def aggregates(spark: SparkSession, d: str) -> DataFrame:
    day = "yyyy-MM-dd HH:mm:ss"
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        long_count("lines"),
        F.sum("l_quantity").cast("long").alias("quantity"),
        F.count_if(c("l_discount") > 0.05).alias("discounted"),
        F.date_format(F.min("l_shipdate"), day).alias("first_day"),
        F.date_format(F.max("l_shipdate"), day).alias("last_day"),
        F.bool_or(c("l_tax") > 0.07).alias("any_taxed"),
        F.sum(F.round(c("l_extendedprice") * 100).cast("long")).alias("cents"),
    )


@query("""
SELECT c_nationkey, array_to_string(list_sort(array_agg(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal > 5000)), ',') AS rich_segments,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sets of few values by group: combined before the shuffle, sorted after it."""
    rich = F.collect_set(F.when(c("c_acctbal") > 5000, c("c_mktsegment")))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(rich.alias("r"), F.collect_set("c_mktsegment").alias("s")).select("c_nationkey", F.when(F.size("r") > 0, joined("r")).alias("rich_segments"), joined("s").alias("segments"))


@query("""
SELECT o_custkey, coalesce(max(n) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, coalesce(max(n) FILTER (WHERE o_orderstatus = 'O'), 0) AS o
FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def object_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status as a map for each customer, and two of its entries."""
    maps = snapshot.count_maps(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "counts")
    return maps.select("o_custkey", *(F.coalesce(F.try_element_at("counts", F.lit(s)), F.lit(0)).cast("long").alias(s.lower()) for s in "FO"))


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS rarity_rank,
  CAST(nullif(list_position(string_split(p_name, ' '), 'ring'), 0) AS BIGINT) AS ring_at, TRY_CAST(nullif(regexp_replace(substr(p_brand, 7), '[^0-9].*$', ''), '') AS INTEGER) AS brand_number
FROM part""")
def rank_expressions(spark: SparkSession, d: str) -> DataFrame:
    from lakewright.functions.text import numeric_part

    return table(spark, d, "part").select(
        "p_partkey", preference(c("p_type"), ["ECONOMY", "STANDARD", "PROMO"]).alias("rarity_rank"), position(F.split("p_name", " "), F.lit("ring")).cast("long").alias("ring_at"), numeric_part(F.substring("p_brand", 7, 9)).alias("brand_number")
    )


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS reason
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IS DISTINCT FROM 'F'""")
def filters_and_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Filters put together at run time, then the first reason to skip each row."""
    wanted = [c("o_orderdate").between(F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1997-12-31"))), c("o_orderpriority").isin("1-URGENT", "5-LOW"), None, ~c("o_orderstatus").eqNullSafe("F")]
    rows = pick.optional_filters(table(spark, d, "orders"), wanted)
    return pick.skip_reasons(rows, {"small": c("o_totalprice") < 50000, "pending": c("o_orderstatus") == "P", "low": c("o_orderpriority") == "5-LOW"}).select("o_orderkey", "reason")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'few' WHEN l_discount > 0.08 THEN 'cheap' ELSE 'kept' END AS reason FROM lineitem) GROUP BY reason")
def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = pick.skip_reasons(table(spark, d, "lineitem"), {"few": c("l_quantity") < 5, "cheap": c("l_discount") > 0.08})
    return pick.facet(rows, F.coalesce("reason", F.lit("kept")), "reason")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_map_access(spark: SparkSession, d: str) -> DataFrame:
    """Known keys as a typed struct; an absent key is null."""
    return table(spark, d, "events").withColumn("j", F.from_json("props", "k long, none string")).where("j.k >= 50").select("event_id", c("j.k").alias("k"), c("j.none").alias("missing"))
