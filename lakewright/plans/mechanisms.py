"""Maintained indexes, hash trees, strict chunks, committed backfills and keyed streams on the driver's tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions import sql, variants
from lakewright.functions.text import collated
from lakewright.operators import assign, chunks, feed, hashtree, merge
from lakewright.sources import feeds, paged
from lakewright.sources.backfill import DayTable
from lakewright.sources.scratch import scratch
from lakewright.sources.search_index import SearchIndex
from lakewright.sources.tables import table
from lakewright.streaming import state

from .registry import query
from .streams import events
from .textual import _GRAMS, _SIMILARITY, _TOKENS

c = F.col


def part_index(spark: SparkSession, d: str) -> SearchIndex:
    """An index of part names by brand, built, then brought to a version in which two brands' promotions have another name and one brand is gone."""
    part = table(spark, d, "part")
    rows = part.select(c("p_brand").alias("group"), c("p_partkey").alias("key"), c("p_name").alias("name"), c("p_type").alias("text"))
    brand = c("group")
    index = SearchIndex(spark, scratch(spark, "part-index"))
    index.refresh(rows)
    changed = rows.where(brand != "Brand#25").withColumn("name", F.when(brand.isin("Brand#11", "Brand#12") & (c("text") == "PROMO"), F.concat(F.lit("small ring "), "name")).otherwise(c("name")))
    index.refresh(changed)
    return index


_INDEXED = """
v AS (SELECT p_partkey AS key, p_type, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') AND p_type = 'PROMO' THEN 'small ring ' || p_name ELSE p_name END AS name FROM part WHERE p_brand <> 'Brand#25')"""
_WORDS = f"{_INDEXED}, t AS (SELECT key, {_TOKENS.format("concat_ws(' ', name, p_type)")} AS w FROM v)"


@query(f"""
WITH {_INDEXED}, g AS (SELECT {_GRAMS.format("'smal rnig'")} AS a), p AS (SELECT key, {_GRAMS.format("name")} AS b FROM v)
SELECT key, round({_SIMILARITY.format(a="a", b="b")}, 5) AS similarity FROM p, g WHERE {_SIMILARITY.format(a="a", b="b")} >= 0.3""")
def index_typos(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt names looked up in the index after a refresh."""
    return part_index(spark, d).similar("smal rnig").select("key", F.round("similarity", 5).alias("similarity"))


@query(f"""
WITH {_WORDS}, s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM t),
q(word) AS (VALUES ('small'), ('ring'), ('promo')),
tf AS (SELECT key, word, len(list_filter(w, lambda x: x = word)) AS f, len(w) AS dl FROM t, q WHERE list_contains(w, word)),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 4) AS score FROM tf JOIN df USING (word), s GROUP BY key""")
def index_ranked(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the whole index, of every document with a typed word."""
    return part_index(spark, d).ranked("small ring promo").select("key", F.round("score", 4).alias("score"))


@query(f"""
WITH {_WORDS}
SELECT 'phrase' AS typed, key FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' small ring ')
UNION ALL SELECT 'without', key FROM t WHERE list_contains(w, 'red') AND NOT list_contains(w, 'ring')
UNION ALL SELECT 'or', key FROM t WHERE (list_contains(w, 'small') AND NOT list_contains(w, 'red')) OR (list_contains(w, 'promo') AND len(list_filter(w, lambda x: starts_with(x, 'wid'))) > 0)
UNION ALL SELECT 'none', key FROM t WHERE NOT contains(' ' || array_to_string(w, ' ') || ' ', ' small ring ')""")
def index_searches(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, negation, alternatives and a prefix, from the lists of positions."""
    index = part_index(spark, d)
    typed = {"phrase": '"small ring"', "without": "red -ring", "or": "small -red or promo wid", "none": '-"small ring"'}
    out = [index.search(t).select(F.lit(name).alias("typed"), "key") for name, t in typed.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(r"""
WITH t AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE source IS NOT NULL AND source <> '' AND text IS NOT NULL)
SELECT key FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' the by ') OR (list_contains(w, 'worthless') AND len(list_filter(w, lambda x: starts_with(x, 'in'))) > 0)""")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """An index of positions over whole texts, a group for each source; a phrase, or a word and a prefix."""
    docs = table(spark, d, "documents")
    index = SearchIndex(spark, scratch(spark, "document-index"))
    index.refresh(docs.select(c("source").alias("group"), c("doc_id").alias("key"), F.lit("").alias("name"), "text"))
    return index.search('"the by" or worthless in')


@query(f"""
WITH {_INDEXED}, q AS (SELECT unnest({_GRAMS.format("'smal rnig'")}) AS gram), p AS (SELECT key, {_GRAMS.format("name")} AS b FROM v),
n AS (SELECT count(*) AS docs, sum(len(b)) / count(*) AS mean FROM p), hits AS (SELECT key, gram, len(b) AS size FROM (SELECT key, b, unnest(b) AS gram FROM p) WHERE gram IN (SELECT gram FROM q)),
rare AS (SELECT gram, count(*) AS df FROM hits GROUP BY 1 HAVING count(*) <= greatest(1, (SELECT floor(0.95 * docs) FROM n))),
top AS (SELECT key FROM (SELECT key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS s FROM hits JOIN rare USING (gram), n GROUP BY 1) ORDER BY s DESC, key LIMIT 500),
g AS (SELECT {_GRAMS.format("'smal rnig'")} AS a)
SELECT key, round({_SIMILARITY.format(a="a", b="b")}, 5) AS similarity FROM top JOIN p USING (key), g WHERE {_SIMILARITY.format(a="a", b="b")} >= 0.3 ORDER BY {_SIMILARITY.format(a="a", b="b")} DESC, key LIMIT 10""")
def index_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for a misspelt name: candidates by BM25 of informative trigrams, then the most similar ones."""
    return part_index(spark, d).suggestions("smal rnig", share=0.95).select("key", F.round("similarity", 5).alias("similarity"))


_ORDERS = """
old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 3),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 5)"""


@query(f"""
WITH {_ORDERS}
SELECT 'delete' AS op, o_orderkey, NULL::BIGINT AS o_custkey, NULL::VARCHAR AS status, NULL::VARCHAR AS priority FROM (SELECT o_orderkey FROM old EXCEPT SELECT o_orderkey FROM new)
UNION ALL SELECT 'upsert', * FROM (SELECT * FROM new EXCEPT SELECT * FROM old)""")
def tree_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two stored versions of a table with a map, compared through their hash trees; only leaves that differ are read."""
    orders = table(spark, d, "orders")
    status = F.when(c("o_custkey") % 50 == 7, F.lit("X")).otherwise(c("o_orderstatus"))
    pack = lambda df, s, order: df.select("o_orderkey", "o_custkey", F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*({"status": s, "priority": c("o_orderpriority")}[x] for x in order))).alias("attributes"))
    # The entries' order differs between the versions and means nothing.
    old = pack(orders.where("o_orderkey % 11 != 3"), c("o_orderstatus"), ["status", "priority"])
    new = pack(orders.where("o_orderkey % 97 != 5"), status, ["priority", "status"])
    root, stored, depth = scratch(spark, "tree-delta"), [], hashtree.depth_for(orders.count())
    for name, df in (("old", old), ("new", new)):
        df.withColumn("leaf", hashtree.leaf(["o_orderkey"], depth)).repartition("leaf").write.partitionBy("leaf").parquet(f"{root}/{name}")
        hashtree.tree(df, ["o_orderkey"], depth).write.parquet(f"{root}/{name}-tree")
        stored.append((spark.read.parquet(f"{root}/{name}"), spark.read.parquet(f"{root}/{name}-tree")))
    (a, a_tree), (b, b_tree) = stored
    change = hashtree.tree_delta(a, b, a_tree, b_tree, ["o_orderkey"], depth=depth)
    return change.select("op", "o_orderkey", "o_custkey", *(c("attributes")[x].alias(x) for x in ("status", "priority")))


@query("""
WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem),
w AS (SELECT l_orderkey, n, q AS total, 0::BIGINT AS chunk FROM r WHERE n = 1
  UNION ALL SELECT r.l_orderkey, r.n, CASE WHEN total + q > 60 THEN q ELSE total + q END, CASE WHEN total + q > 60 THEN chunk + 1 ELSE chunk END FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.n = w.n + 1)
SELECT l_orderkey, chunk, count(*) AS lines, max(total) AS quantity FROM w GROUP BY 1, 2""")
def strict_chunks(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines packed in turn, up to 60 pieces a parcel."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    cut = chunks.greedy_chunks(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], c("l_quantity"), 60)
    return cut.groupBy("l_orderkey", "chunk").agg(F.count("*").alias("lines"), F.sum(c("l_quantity").cast("long")).alias("quantity"))


_CARDS = """
prints AS (SELECT p_partkey AS print_id, p_size::VARCHAR AS number, p_name AS name, p_type = 'PROMO' AS has_picture FROM part),
cards AS (SELECT p_partkey + 7 AS card_id, CASE WHEN p_partkey % 5 = 0 THEN 'CC' || p_size ELSE p_size::VARCHAR END AS number, p_name AS name FROM part WHERE p_partkey % 3 <> 0)"""


@query(f"""
WITH {_CARDS},
sole AS (SELECT number, name, min(card_id) AS card_id FROM cards GROUP BY 1, 2 HAVING count(*) = 1),
exact AS (SELECT min(print_id) AS print_id, card_id FROM prints JOIN sole USING (number, name) WHERE NOT has_picture GROUP BY card_id),
theirs AS (SELECT name, min(card_id) AS card_id FROM cards WHERE card_id NOT IN (SELECT card_id FROM exact) AND number NOT IN (SELECT number FROM prints) GROUP BY 1 HAVING count(*) = 1),
ours AS (SELECT name, min(print_id) AS print_id FROM prints WHERE print_id NOT IN (SELECT print_id FROM exact) GROUP BY 1 HAVING count(*) = 1)
SELECT print_id, card_id, 'number' AS rule FROM exact UNION ALL SELECT print_id, card_id, 'name' FROM ours JOIN theirs USING (name) WHERE print_id IN (SELECT print_id FROM prints WHERE NOT has_picture)""")
def cards_once(spark: SparkSession, d: str) -> DataFrame:
    """Pictures for prints: by number and name, then by names that occur once; no card is used twice."""
    part = table(spark, d, "part")
    prints = part.select(c("p_partkey").alias("print_id"), c("p_size").cast("string").alias("number"), c("p_name").alias("name"), (c("p_type") == "PROMO").alias("has_picture"))
    number = F.when(c("p_partkey") % 5 == 0, F.concat(F.lit("CC"), c("p_size").cast("string"))).otherwise(c("p_size").cast("string"))
    cards = part.where("p_partkey % 3 != 0").select((c("p_partkey") + 7).alias("card_id"), number.alias("number"), c("p_name").alias("name"))
    return assign.cards_once(prints, cards)


@query()
def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers paired off by the largest deliveries, each once; a loop in order gives the same (tests)."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg((-F.max("l_extendedprice")).alias("price"))
    return assign.greedy_pairs(lines, "l_partkey", "l_suppkey", ["price"]).select("l_partkey", "l_suppkey")


_DELIVERED = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE NOT (l_shipdate >= DATE '2000-08-10' AND l_shipdate < DATE '2000-08-20')"


@query(f"""
WITH spine AS (SELECT CAST(unnest(generate_series(DATE '1995-01-10', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day), landed AS ({_DELIVERED}),
marked AS (SELECT s.day, l.day IS NOT NULL AS has, sum(CASE WHEN l.day IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY s.day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS gaps FROM spine s LEFT JOIN landed l USING (day)),
taken AS (SELECT day FROM marked m WHERE has AND day < (SELECT coalesce(min(day), DATE '9999-01-01') FROM marked WHERE gaps >= 6))
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, sum(l_quantity::BIGINT) AS quantity FROM lineitem JOIN taken ON day = CAST(l_shipdate AS DATE) GROUP BY 1""")
def backfill_table(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by day, backfilled by a run that is stopped and one that goes on, until six days in a row are missing."""
    lines = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_orderkey", c("l_quantity").cast("long").alias("quantity"))
    lines = lines.where("NOT (day >= DATE'2000-08-10' AND day < DATE'2000-08-20')")
    spine = feeds.days(spark, "1995-01-10", "2001-12-31")
    days = DayTable(spark, scratch(spark, "backfill"), lines.schema)
    commits = []

    def stop(part: list) -> None:
        commits.append(part)
        if len(commits) == 2:
            raise InterruptedError

    try:
        days.backfill(spine, lines, lines, gaps=6, at_a_time=730, before_commit=stop)
    except InterruptedError:
        days.backfill(spine, lines, lines, gaps=6, at_a_time=730)
    return days.rows().groupBy(c("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
SELECT o_orderkey AS id, o_orderpriority || ' two' AS v, nth + 1000 AS seq, 'apply' AS action FROM n UNION ALL SELECT o_orderkey, o_orderpriority || ' two', nth + 1000, 'superseded' FROM n""")
def push_twice(spark: SparkSession, d: str) -> DataFrame:
    """A push in which every key comes twice: its last row counts, and there is one row for it."""
    orders = table(spark, d, "orders").select(c("o_custkey").alias("owner"), c("o_orderkey").alias("id"), c("o_orderpriority").alias("v"), c("o_orderdate").cast("timestamp").alias("at"))
    none = F.lit(None).cast("timestamp")
    stored = orders.select("owner", "id", "v", c("at").alias("updated_at"), none.alias("deleted_at"), F.lit(1000).cast("long").alias("seq"))
    later = lambda n, text: orders.select("owner", "id", F.concat("v", F.lit(text)).alias("v"), (c("at") + F.expr(f"INTERVAL {n} DAY")).alias("updated_at"), none.alias("deleted_at"), c("at").alias("base_updated_at"))
    after, done = feed.push(stored, later(2, " two").unionByName(later(1, " one")), "owner", "id", ["v"])
    return after.join(done, ["owner", "id"]).select("id", "v", "seq", "action")


@query("""
WITH m AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer)
SELECT 'delete' AS op, c_custkey, NULL::VARCHAR AS segment FROM m WHERE c_custkey % 9 <> 2 AND c_custkey % 13 = 4
UNION ALL SELECT 'upsert', c_custkey, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END FROM m WHERE c_custkey % 13 <> 4 AND (c_custkey % 9 = 2 OR c_nationkey = 3)""")
def map_delta(spark: SparkSession, d: str) -> DataFrame:
    """What turns one version of a table with maps into another; the order of entries is no difference."""
    customer = table(spark, d, "customer")
    pack = lambda df, s, turn: df.select("c_custkey", F.map_from_entries((F.reverse if turn else lambda x: x)(F.array(F.struct(F.lit("segment").alias("k"), s.alias("v")), F.struct(F.lit("nation").alias("k"), c("c_nationkey").cast("string").alias("v"))))).alias("m"))
    old = pack(customer.where("c_custkey % 9 != 2"), c("c_mktsegment"), False)
    new = pack(customer.where("c_custkey % 13 != 4"), F.when(c("c_nationkey") == 3, "moved").otherwise(c("c_mktsegment")), True)
    return merge.delta(old, new, ["c_custkey"]).select("op", "c_custkey", c("m")["segment"].alias("segment"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def state_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, kept in keyed state; the table is read from the state."""
    root = scratch(spark, "state-newest")
    state.run(state.newest(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id"), f"{root}/rows", f"{root}/checkpoint")
    return state.held(spark, f"{root}/checkpoint", "newest").select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def state_once_per_day(spark: SparkSession, d: str) -> DataFrame:
    """One event of each user and day, by days kept in keyed state until the watermark has passed them."""
    root = scratch(spark, "state-daily")
    state.run(state.once_per_day(events(spark, d).select("user_id", "ts"), ["user_id"], "ts").select("user_id", "day"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema("user_id long, day date").parquet(f"{root}/rows").select("user_id", c("day").cast("string").alias("day"))


_NUMBERED = "e AS (SELECT user_id, ts, event_type = 'error' AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query(f"""
WITH {_NUMBERED}
SELECT user_id, max(seq) AS seq, coalesce(max(seq) FILTER (WHERE deleted AND ts + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)), 0) AS horizon, count(*) AS n FROM e GROUP BY 1""")
def state_feed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's numbered changes, let through once; deletions are forgotten after a week and leave a horizon."""
    root = scratch(spark, "state-feed")
    w = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    numbered = table(spark, d, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), (c("event_type") == "error").alias("deleted"), F.expr(w).cast("long").alias("seq"))
    numbered.write.parquet(f"{root}/in")
    twice = spark.readStream.schema(numbered.schema).parquet(f"{root}/in").withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    state.run(state.change_feed(twice, "user_id", "seq", "ts", keep=timedelta(days=7)), f"{root}/rows", f"{root}/checkpoint")
    passed = spark.read.schema(numbered.schema).parquet(f"{root}/rows").groupBy("user_id").agg(F.count("*").alias("n"))
    return state.held(spark, f"{root}/checkpoint", "last").join(passed, "user_id").select("user_id", "seq", "horizon", "n")


@query("""
SELECT o_orderkey AS id, 1::BIGINT AS nth, 'insert' AS action FROM orders
UNION ALL SELECT o_orderkey, 2, CASE
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'noop'
  WHEN o_orderstatus = 'O' THEN 'apply'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'apply' ELSE 'conflict' END FROM orders""")
def state_pushes(spark: SparkSession, d: str) -> DataFrame:
    """Two pushes of each key resolved in turn against keyed state."""
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("v"), c("o_orderstatus").alias("s"), c("o_orderdate").cast("timestamp").alias("at"))
    none, day = F.lit(None).cast("timestamp"), F.expr("INTERVAL 1 DAY")
    first = orders.select("id", F.lit(1).cast("long").alias("nth"), "v", c("at").alias("updated_at"), none.alias("deleted_at"), none.alias("base_updated_at"))
    same = c("v") == "4-NOT SPECIFIED"
    second = orders.select("id", F.lit(2).cast("long").alias("nth"), F.when(same, c("v")).otherwise("new").alias("v"), (c("at") + day).alias("updated_at"), F.when(c("v") == "3-MEDIUM", c("at") + day).alias("deleted_at"), F.when(c("s") == "O", c("at")).alias("base_updated_at"))
    root = scratch(spark, "state-pushes")
    # The second pushes come first: a key's pushes are taken by their numbers.
    second.unionByName(first).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(first.schema).parquet(f"{root}/in")
    state.run(state.pushes(stream, ["id"], ["v"], "nth"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema("id long, nth long, action string").parquet(f"{root}/rows")


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower('OP-0' || p_size || 'b ' || p_brand), '[^a-z0-9]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS code,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower('EN-00' || p_size), '[^a-z0-9]+', '', 'g'), '^[a-z]{1,2}([0-9])', '\1'), '^0+([0-9a-z])', '\1'), '') AS number, p_size::INTEGER AS part
FROM part WHERE regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g') <> 'brand11'""")
def sql_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key functions from SQL."""
    sql.register(spark)
    table(spark, d, "part").createOrReplaceTempView("parts_of_keys")
    return spark.sql("""
        SELECT p_partkey, code_key('OP-0' || p_size || 'b ' || p_brand) AS code, number_key('EN-00' || p_size) AS number, numeric_part(p_size || 'a7') AS part
        FROM parts_of_keys WHERE code_key(p_brand) <> code_key('Brand-0011')""")


@query("SELECT p_partkey, i::INTEGER AS call, p_name AS name, [p_brand, p_type] AS lines FROM part, (SELECT unnest([0, 1]) AS i)")
def sql_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of a text by a table function."""
    sql.register(spark)
    call = F.concat(F.lit("{{Set list|Name="), "p_name", F.lit("|"), "p_brand", F.lit("|"), "p_type", F.lit("}} "))
    table(spark, d, "part").select("p_partkey", F.concat(call, F.lit("and {{Other|x}} "), call).alias("body")).createOrReplaceTempView("pages_of_templates")
    return spark.sql("SELECT p_partkey, call, named['name'] AS name, lines FROM pages_of_templates, LATERAL template_calls(body, 'set list')")


_RAGGED = """
j AS (SELECT p_partkey, p_size, CASE p_partkey % 5
  WHEN 0 THEN '{"ids": {"tcg": ' || p_size || ', "alt": null}, "name": "' || p_name || '", "tags": ["x", "' || p_type || '"]}'
  WHEN 1 THEN '{"ids": [' || p_size || ', 7], "name": 5}'
  WHEN 2 THEN '["' || p_name || '"]'
  WHEN 3 THEN '{"ids": {"tcg": "' || p_brand || '"}, "own": {"k": {"z": true}}}'
  ELSE '{"broken": ' END AS body FROM part)"""


@query(f"""
WITH {_RAGGED}, v AS (SELECT p_partkey, p_size, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM j)
SELECT p_partkey, v->>'$.ids.tcg' AS tcg, CASE WHEN p_partkey % 5 = 0 THEN p_size::BIGINT END AS tcg_number, coalesce(json_exists(v, '$.ids.alt'), false) AS has_alt, v->>'$.tags[1]' AS tag,
  coalesce(CAST(v->>'$.own.k.z' AS BOOLEAN), false) AS z,
  CASE WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(list_distinct(list_concat(json_keys(v), ['name', 'seen']))), ',') ELSE 'name,seen' END AS keys, p_size::BIGINT AS seen, 'new' AS name
FROM v""")
def variant_paths(spark: SparkSession, d: str) -> DataFrame:
    """JSON of several shapes, some of it broken: existence, nested paths, types, and a merge."""
    part, i = table(spark, d, "part"), c("p_partkey") % 5
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    size, name = c("p_size").cast("string"), c("p_name")
    body = (
        F.when(i == 0, text('{"ids": {"tcg": ', size, ', "alt": null}, "name": "', name, '", "tags": ["x", "', c("p_type"), '"]}'))
        .when(i == 1, text('{"ids": [', size, ', 7], "name": 5}')).when(i == 2, text('["', name, '"]'))
        .when(i == 3, text('{"ids": {"tcg": "', c("p_brand"), '"}, "own": {"k": {"z": true}}}')).otherwise('{"broken": ')
    )
    rows = part.select("p_partkey", variants.parsed(body).alias("v"), variants.parsed(text('{"name": "new", "seen": ', size, "}")).alias("more"))
    root = scratch(spark, "variants")
    # Written with its paths beside it, and read again.
    variants.shredded(rows, "v", {"tcg": ("$.ids.tcg", "string"), "tag": ("$.tags[1]", "string")}).write.parquet(f"{root}/rows")
    held = spark.read.parquet(f"{root}/rows")
    v, m = c("v"), variants.merged(c("v"), c("more"))
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.ids.tcg", "variant")) == "BIGINT", variants.at(v, "$.ids.tcg", "long"))
    return held.select(
        "p_partkey", "tcg", number.alias("tcg_number"), variants.has(v, "$.ids.alt").alias("has_alt"), "tag", F.coalesce(variants.at(v, "$.own.k.z", "boolean"), F.lit(False)).alias("z"),
        F.array_join(F.array_sort(F.map_keys(variants.entries(m))), ",").alias("keys"), variants.at(m, "$.seen", "long").alias("seen"), variants.at(m, "$.name").alias("name"),
    )


_SPELT = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(p_name, 'aeo', 'áêö') ELSE p_name END"


@query(f"""
WITH n AS (SELECT p_partkey, {_SPELT} AS name, lower(strip_accents(p_name)) AS plain FROM part),
g AS (SELECT plain, count(*) AS n, min(name) AS first_by_bytes FROM n GROUP BY 1)
SELECT first_by_bytes, n, dense_rank() OVER (ORDER BY plain)::INTEGER AS place FROM g""")
def locale_order(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in case and accents alone are one group, in a locale's order; within it bytes decide."""
    i = c("p_partkey") % 3
    spelt = F.when(i == 0, F.upper("p_name")).when(i == 1, F.translate("p_name", "aeo", "áêö")).otherwise(c("p_name"))
    names = table(spark, d, "part").select(spelt.alias("name"))
    groups = names.groupBy(collated(c("name")).alias("key")).agg(F.count("*").alias("n"), F.min("name").alias("first_by_bytes"))
    # Groups are the different names of a catalog; their places need one order.
    return groups.select("first_by_bytes", "n", F.dense_rank().over(Window.orderBy("key")).alias("place"))


@query("SELECT c_custkey, c_name, (c_custkey // 50)::BIGINT AS place FROM customer")
def paged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Customers landed as pages that name each other, read in the order of their links."""
    customer = table(spark, d, "customer")
    last = customer.agg(F.max(F.floor(c("c_custkey") / 50))).first()[0]
    page = F.floor(c("c_custkey") / 50)
    # Tokens that sort otherwise than the chain goes.
    token = lambda p: F.concat(F.lit("t"), ((p * 7919) % 100003).cast("string"), F.lit("-"), p.cast("string"))
    root = f"{scratch(spark, 'paged')}/pages"
    paged.land(customer, root, F.struct("c_custkey", "c_name"), token(page), F.when(page < last, token(page + 1)))
    spark.dataSource.register(paged.PagedAnswers)
    found = spark.read.format("paged").option("path", root).option("first", "t0-0").load()
    return found.select(F.from_json("record", "c_custkey long, c_name string").alias("r"), "place").select("r.c_custkey", "r.c_name", "place")
