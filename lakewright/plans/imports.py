"""The daily import, pushes of a device, and values of feeds, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.text import joined_faces, rules_text
from lakewright.functions.values import first_keyword, least_cost, offset_time, only_keys, records, stable_id, without_nulls
from lakewright.operators import feed, imports
from lakewright.sources.tables import table

from .registry import query

c = F.col

#: Parts are products, two in three also prints, of which one in five knows its product; an order's first line is a price.
_IMPORT = """
products AS (SELECT p_partkey AS product_id, p_brand AS set_id, p_size AS number, p_type AS rarity, p_name AS name FROM part),
prints AS (SELECT p_partkey AS print_id, p_brand AS set_id, p_size AS number, p_type AS rarity, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS external_id FROM part WHERE p_partkey % 3 <> 0),
lines AS (SELECT l_partkey AS product_id, CASE l_returnflag WHEN 'A' THEN 'foil' ELSE 'normal' END AS finish, CASE WHEN l_discount >= 0.02 THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS market, l_shipdate AS observed_at FROM lineitem WHERE l_linenumber = 1),
feed AS (SELECT product_id, finish, max(market) AS market, max(observed_at) AS observed_at FROM lines GROUP BY 1, 2),
held_mappings AS (SELECT print_id, (print_id * 7) % 400 + 1 AS product_id, 'foil' AS finish, CASE WHEN print_id % 20 = 1 THEN 'manual' ELSE 'number' END AS method, 70 AS confidence FROM prints WHERE print_id % 10 = 1),
held_prices AS (SELECT print_id, 'normal' AS finish, CAST(number AS BIGINT) AS market, CASE WHEN print_id % 2 = 0 THEN TIMESTAMP '1990-01-01' ELSE TIMESTAMP '2030-01-01' END AS observed_at FROM prints WHERE print_id % 4 = 0),
hits AS (
  SELECT product_id, print_id, 'id' AS method, 100 AS confidence, 0 AS rule FROM products JOIN (SELECT external_id, min(print_id) AS print_id FROM prints WHERE external_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT print_id) = 1) ON external_id = product_id
  UNION ALL SELECT product_id, print_id, 'number', 70, 1 FROM products JOIN (SELECT set_id, number, min(print_id) AS print_id FROM prints GROUP BY 1, 2 HAVING count(*) = 1) USING (set_id, number)
  UNION ALL SELECT product_id, print_id, 'number', 70, 2 FROM products JOIN (SELECT set_id, number, rarity, min(print_id) AS print_id FROM prints GROUP BY 1, 2, 3 HAVING count(*) = 1) USING (set_id, number, rarity)
  UNION ALL SELECT product_id, print_id, 'name', 40, 3 FROM products JOIN (SELECT set_id, name, min(print_id) AS print_id FROM prints GROUP BY 1, 2 HAVING count(*) = 1) USING (set_id, name)),
firsts AS (SELECT * FROM hits h WHERE rule = (SELECT min(rule) FROM hits o WHERE o.product_id = h.product_id)),
best AS (SELECT * FROM firsts f WHERE confidence = (SELECT max(confidence) FROM firsts o WHERE o.print_id = f.print_id)),
matches AS (SELECT * FROM best b WHERE (SELECT count(*) FROM best o WHERE o.print_id = b.print_id) = 1),
automatic AS (SELECT print_id, product_id, finish, method, confidence FROM matches JOIN feed USING (product_id)
  UNION ALL SELECT print_id, product_id, finish, method, confidence FROM held_mappings WHERE method <> 'manual' AND product_id NOT IN (SELECT product_id FROM products)),
mappings AS (SELECT * FROM automatic a WHERE NOT EXISTS (SELECT 1 FROM held_mappings m WHERE m.method = 'manual' AND m.product_id = a.product_id AND m.finish = a.finish)
  UNION ALL SELECT print_id, product_id, finish, method, confidence FROM held_mappings WHERE method = 'manual'),
resolved AS (SELECT f.*, m.print_id FROM feed f JOIN mappings m USING (product_id, finish)),
fresh AS (SELECT DISTINCT ON (print_id, finish) print_id, finish, market, observed_at FROM resolved WHERE market IS NOT NULL ORDER BY print_id, finish, product_id)"""


def imported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, d, "part")
    of = [c("p_brand").alias("set_id"), c("p_size").alias("number"), c("p_type").alias("rarity"), c("p_name").alias("name")]
    products = part.select(c("p_partkey").alias("product_id"), *of)
    prints = part.where(c("p_partkey") % 3 != 0).select(c("p_partkey").alias("print_id"), *of, F.when(c("p_partkey") % 5 == 0, c("p_partkey")).alias("external_id"))
    market = F.when(c("l_discount") >= 0.02, F.floor(c("l_extendedprice") * 100 + 0.5).cast("long"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select(c("l_partkey").alias("product_id"), F.when(c("l_returnflag") == "A", "foil").otherwise("normal").alias("finish"), market.alias("market"), c("l_shipdate").alias("observed_at"))
    prices = lines.groupBy("product_id", "finish").agg(F.max("market").alias("market"), F.max("observed_at").alias("observed_at"))
    i = c("print_id")
    held_mappings = prints.where(i % 10 == 1).select(i, ((i * 7) % 400 + 1).alias("product_id"), F.lit("foil").alias("finish"), F.when(i % 20 == 1, "manual").otherwise("number").alias("method"), F.lit(70).alias("confidence"))
    at = F.when(i % 2 == 0, F.lit("1990-01-01")).otherwise(F.lit("2030-01-01"))
    held_prices = prints.where(i % 4 == 0).select(i, F.lit("normal").alias("finish"), c("number").cast("long").alias("market"), at.cast(lines.schema["observed_at"].dataType).alias("observed_at"))
    return imports.import_prices(products, prices, prints, held_mappings, held_prices)


@query(f"WITH {_IMPORT} SELECT print_id, product_id, finish, method, confidence FROM mappings")
def import_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Which product prices which print: today's matches below manual mappings."""
    return imported(spark, d)[0]


@query(f"""
WITH {_IMPORT} SELECT coalesce(f.print_id, h.print_id) AS print_id, coalesce(f.finish, h.finish) AS finish,
  CASE WHEN h.print_id IS NULL OR f.observed_at >= h.observed_at THEN f.market ELSE h.market END AS market
FROM fresh f FULL JOIN held_prices h ON f.print_id = h.print_id AND f.finish = h.finish""")
def import_prices(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d)[1].select("print_id", "finish", "market")


@query(f"""
WITH {_IMPORT}, of AS (SELECT product_id, count(market) AS prices, count(DISTINCT CASE WHEN market IS NULL THEN finish END) AS no_market FROM resolved GROUP BY 1)
SELECT set_id, count(*) AS cards, count(prices) AS mapped, count(*) - count(prices) AS unmapped, CAST(coalesce(sum(prices), 0) AS BIGINT) AS prices, CAST(coalesce(sum(no_market), 0) AS BIGINT) AS no_market
FROM products LEFT JOIN of USING (product_id) GROUP BY 1""")
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d)[2]


#: Orders are rows of a user; a device pushes those of the first day of a month, some as deletions, some never seen.
_PUSH = """
stored AS (SELECT o_custkey AS user_id, o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS name, o_orderdate AS updated_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS deleted_at,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderkey % 13 <> 0),
pushed AS (SELECT o_custkey AS user_id, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE 'changed' END AS name, o_orderdate + INTERVAL 1 DAY AS updated_at,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS deleted_at, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS base FROM orders WHERE day(o_orderdate) = 1),
paired AS (SELECT p.*, s.id IS NULL AS none, s.updated_at AS s_at, s.deleted_at AS s_gone, s.name IS NOT DISTINCT FROM p.name AND s.id IS NOT NULL AND s.deleted_at IS NULL AND p.deleted_at IS NULL AS same
  FROM pushed p LEFT JOIN stored s ON s.user_id = p.user_id AND s.id = p.id),
acted AS (SELECT *, CASE WHEN none AND deleted_at IS NOT NULL THEN 'skip' WHEN none AND base IS NOT NULL THEN 'conflict' WHEN none THEN 'insert'
  WHEN same OR (s_gone IS NOT NULL AND deleted_at IS NOT NULL) THEN 'noop'
  WHEN (s_gone IS NULL AND base IS NOT NULL AND s_at <= base) OR coalesce(deleted_at > s_at, false) OR coalesce(s_gone IS NOT NULL AND deleted_at IS NULL AND updated_at > s_gone, false) THEN CASE WHEN s_gone IS NOT NULL THEN 'insert' ELSE 'apply' END
  ELSE 'conflict' END AS action FROM paired),
changed AS (SELECT user_id, id, CASE WHEN deleted_at IS NULL THEN name END AS name, deleted_at IS NOT NULL AS gone,
  coalesce((SELECT max(seq) FROM stored s WHERE s.user_id = a.user_id), 0) + row_number() OVER (PARTITION BY user_id ORDER BY id) AS seq FROM acted a WHERE action IN ('insert', 'apply'))"""


def pushed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    k, day = c("o_orderkey"), F.expr("INTERVAL 1 DAY")
    orders = table(spark, d, "orders")
    who = [c("o_custkey").alias("user_id"), k.alias("id")]
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    stored = orders.where(k % 13 != 0).select(*who, F.when(k % 11 != 0, c("o_orderpriority")).alias("name"), c("o_orderdate").alias("updated_at"), F.when(k % 11 == 0, c("o_orderdate")).alias("deleted_at"), nth.alias("seq"))
    base = F.when(k % 4 == 1, c("o_orderdate") - day).when(k % 4 > 1, c("o_orderdate"))
    rows = orders.where(F.dayofmonth("o_orderdate") == 1).select(*who, F.when(k % 3 == 0, c("o_orderpriority")).otherwise("changed").alias("name"), (c("o_orderdate") + day).alias("updated_at"), F.when(k % 7 == 0, c("o_orderdate") + day).alias("deleted_at"), base.alias("base_updated_at"))
    return feed.push(stored, rows, "user_id", "id", ["name"])


@query(f"""
WITH {_PUSH} SELECT user_id, id, name, deleted_at IS NOT NULL AS gone, seq FROM stored s WHERE NOT EXISTS (SELECT 1 FROM changed x WHERE x.user_id = s.user_id AND x.id = s.id)
UNION ALL SELECT user_id, id, name, gone, CAST(seq AS BIGINT) FROM changed""")
def sync_push(spark: SparkSession, d: str) -> DataFrame:
    """What is stored after a device's push."""
    return pushed(spark, d)[0].select("user_id", "id", "name", c("deleted_at").isNotNull().alias("gone"), "seq")


@query(f"WITH {_PUSH} SELECT action, count(*) AS n FROM acted GROUP BY 1")
def sync_push_actions(spark: SparkSession, d: str) -> DataFrame:
    return pushed(spark, d)[1].groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey, t.label FROM customer c JOIN (VALUES (0, 'zero'), (3, 'three'), (7, 'seven')) t(n, label) ON c.c_nationkey = t.n")
def json_recordset(spark: SparkSession, d: str) -> DataFrame:
    """A JSON parameter as a relation."""
    rows = spark.range(1).select(F.inline(records(F.lit('[{"n":0,"label":"zero"},{"n":3,"label":"three"},{"n":7,"label":"seven"}]'), "n int, label string")))
    return table(spark, d, "customer").join(rows, c("c_nationkey") == c("n")).select("c_custkey", "label")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 5, 9)")
def json_array_relation(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of values as a relation."""
    keys = spark.range(1).select(F.explode(F.from_json(F.lit("[1,5,9]"), "array<int>")).alias("n_nationkey"))
    return table(spark, d, "nation").join(keys, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' // ' || p_type WHEN p_size % 5 <> 0 THEN p_name END AS faces FROM part")
def face_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text of a card's faces."""
    face = lambda x: F.struct(x.alias("text"))
    some = F.when(c("p_size") % 5 != 0, c("p_name"))
    faces = F.when(c("p_size") % 2 == 0, F.array(face(c("p_name")), face(c("p_type")))).otherwise(F.array(face(some), face(F.lit(None).cast("string"))))
    return table(spark, d, "part").select("p_partkey", joined_faces(faces, "text", " // ").alias("faces"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Ability ' || p_name || ': ' || p_type || chr(10) || p_brand || ' ' || p_size || chr(10) || p_type WHEN 1 THEN p_brand || ': ' || p_type END AS rules FROM part""")
def rules_texts(spark: SparkSession, d: str) -> DataFrame:
    """Abilities, attacks and effects as lines."""
    k, none = c("p_size") % 3, F.lit(None).cast("string")
    abilities = F.when(k == 0, F.array(F.struct(F.lit("Ability").alias("type"), c("p_name").alias("name"), c("p_type").alias("effect"))))
    attack = lambda damage, effect: F.array(F.struct(c("p_brand").alias("name"), damage.cast("string").alias("damage"), effect.alias("effect")))
    attacks = F.when(k == 0, attack(c("p_size"), none)).when(k == 1, attack(none, c("p_type")))
    return table(spark, d, "part").select("p_partkey", rules_text(abilities, attacks, F.when(k == 0, c("p_type")).otherwise("")).alias("rules"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def offset_times(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps written with +0000."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))
    return table(spark, d, "events").select("event_id", F.date_format(offset_time(written), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
WITH h AS (SELECT o_orderkey, md5('["' || o_custkey || '","' || o_orderkey || '"]') AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM h""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", stable_id(c("o_custkey"), c("o_orderkey")).alias("id"))


@query("""
SELECT p_partkey, 'brand' AS picked, CASE WHEN p_size % 2 = 0 THEN 'brand,size' ELSE 'brand' END AS filled, CASE WHEN p_size % 3 <> 0 THEN p_size % 3 END AS cost,
  CASE WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%brass%' THEN 'brass' ELSE 'other' END AS kind FROM part""")
def picked_values(spark: SparkSession, d: str) -> DataFrame:
    """Keys picked from maps, null entries dropped, least costs, first keywords."""
    m = F.create_map(F.lit("brand"), c("p_brand"), F.lit("size"), F.when(c("p_size") % 2 == 0, c("p_size").cast("string")))
    keys = lambda x: F.array_join(F.array_sort(F.map_keys(x)), ",")
    attack = lambda n: F.struct(F.array_repeat(F.lit("x"), n).alias("cost"))
    attacks = F.when(c("p_size") % 3 != 0, F.array(attack(c("p_size") % 3), attack(F.lit(4))))
    return table(spark, d, "part").select("p_partkey", keys(only_keys(m, ["brand"])).alias("picked"), keys(without_nulls(m)).alias("filled"), least_cost(attacks).alias("cost"), first_keyword(c("p_type"), ["steel", "brass"], "other").alias("kind"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS json FROM (SELECT n_regionkey, n_name FROM nation UNION ALL SELECT n_regionkey, lower(n_name) FROM nation) GROUP BY 1")
def byte_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in byte order: capitals before small letters; and as a JSON array."""
    nation = table(spark, d, "nation")
    names = nation.select("n_regionkey", "n_name").union(nation.select("n_regionkey", F.lower("n_name")))
    packed = names.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("all"))
    return packed.select("n_regionkey", F.array_join("all", ",").alias("names"), F.to_json("all").alias("json"))


@query("SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n_faces FROM lineitem ORDER BY l_orderkey, CAST(l_quantity AS INTEGER) DESC, l_linenumber")
def most_faces(spark: SparkSession, d: str) -> DataFrame:
    """Of several versions the one with the most faces, the first of ties."""
    n = c("l_quantity").cast("int")
    best = F.max_by(F.struct("l_linenumber", n.alias("n_faces")), F.struct(n, -c("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.*")


#: Parts as products and prints of regional sets; artworks, misprinted names and other regions' numbers among them.
_GROUP = """
products AS (SELECT p_partkey AS product_id, p_brand AS set_id, 'B-EN' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS number, CASE WHEN p_partkey % 11 = 0 THEN 'Common' ELSE p_type END AS rarity,
  p_name || CASE p_partkey % 13 WHEN 1 THEN ' (Original Artwork)' WHEN 2 THEN ' (New Artwork)' ELSE '' END AS name FROM part WHERE p_partkey % 6 <> 5),
prints AS (SELECT p_partkey AS print_id, p_brand AS set_id, 'B-' || CASE p_partkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN '' ELSE 'EN' END || lpad(CAST(CASE WHEN p_partkey % 4 < 2 THEN (p_size + 3) % 50 ELSE p_size END AS VARCHAR), 3, '0') AS number,
  p_type AS rarity, CASE WHEN p_partkey % 9 = 4 THEN p_name || ' x' ELSE p_name END AS name, p_partkey % 5 = 0 AS alt_art FROM part WHERE p_partkey % 7 <> 6),
pr AS (SELECT *, split_part(number, '-', 2) AS own, regexp_replace(regexp_replace(lower(split_part(number, '-', 2)), '^[a-z]{1,2}([0-9])', '\\1'), '^0+([0-9a-z])', '\\1') AS nkey, lower(regexp_replace(rarity, ' ', '')) AS rkey,
  regexp_replace(lower(regexp_replace(name, ' \\((Original|New) Artwork\\)$', '')), '[^a-z0-9]', '', 'g') AS nname FROM products),
pt AS (SELECT *, split_part(number, '-', 2) AS own, regexp_replace(regexp_replace(lower(split_part(number, '-', 2)), '^[a-z]{1,2}([0-9])', '\\1'), '^0+([0-9a-z])', '\\1') AS nkey, lower(regexp_replace(rarity, ' ', '')) AS rkey, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nname FROM prints),
c0 AS (SELECT product_id, print_id, pt.own, pr.own = pt.own AS exact, pr.rkey = pt.rkey AS alike FROM pr JOIN pt USING (set_id, nkey)),
c1 AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE exact) OVER w AS k FROM c0 WINDOW w AS (PARTITION BY product_id)) WHERE n = 1 OR k = 0 OR exact),
c2 AS (SELECT * EXCLUDE (n, k) FROM (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY product_id) AS n FROM c1) WHERE n = 1 OR alike),
hits AS (SELECT product_id, print_id FROM (SELECT *, count(*) OVER w AS n, min(own) OVER w AS lo, max(own) OVER w AS hi FROM c2 WINDOW w AS (PARTITION BY product_id)) WHERE n = 1 OR lo = hi),
kin AS (SELECT *, count(*) OVER (PARTITION BY set_id, number, rkey) AS size FROM pr),
claimed AS (SELECT h.product_id, h.print_id, k.set_id, k.number, k.rkey, k.size, k.name AS pname, k.nname = t.nname AS named, t.alt_art FROM hits h JOIN kin k USING (product_id) JOIN pt t USING (print_id)),
many AS (SELECT *, count(*) FILTER (WHERE named) OVER (PARTITION BY set_id, number, rkey, print_id) AS n FROM claimed WHERE size > 1),
art_in AS (SELECT 'f' AS kind, print_id, product_id, pname, alt_art FROM many WHERE n <> 1),
numbers0 AS (SELECT product_id, print_id FROM claimed WHERE size = 1 UNION ALL SELECT product_id, print_id FROM many WHERE named AND n = 1),
%ART(art_in, drawn)%,
numbers AS (SELECT * FROM numbers0 UNION ALL SELECT product_id, print_id FROM drawn),
by_name AS (SELECT product_id, o.print_id FROM pr JOIN (SELECT set_id, nname, min(print_id) AS print_id FROM pt GROUP BY 1, 2 HAVING count(*) = 1) o USING (set_id, nname) WHERE product_id NOT IN (SELECT product_id FROM hits)),
rest AS (SELECT * FROM pt WHERE regexp_matches(own, '^(A|E|AE)?[0-9]') AND print_id NOT IN (SELECT print_id FROM numbers)),
f0 AS (SELECT rest.print_id, pr.product_id, pr.name AS pname, rest.alt_art, pr.own AS theirs, rest.own, count(*) OVER (PARTITION BY print_id) AS n FROM rest JOIN pr ON pr.set_id = rest.set_id AND pr.nname = rest.nname AND pr.rkey = rest.rkey),
f1 AS (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY print_id) AS n FROM f0 WHERE n = 1 OR starts_with(theirs, 'EN')),
f2 AS (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY print_id) AS n FROM f1 WHERE n = 1 OR regexp_replace(theirs, '[^0-9]', '', 'g') = regexp_replace(own, '[^0-9]', '', 'g')),
art_region AS (SELECT 'r' AS kind, print_id, product_id, pname, alt_art FROM f2 WHERE n > 1),
%ART(art_region, drawn_region)%,
sibling AS (SELECT set_id, nname, rkey, min(numbers0.product_id) AS product_id FROM numbers0 JOIN pt USING (print_id) WHERE starts_with(own, 'EN') GROUP BY 1, 2, 3 HAVING count(DISTINCT numbers0.product_id) = 1),
region AS (SELECT product_id, print_id FROM f2 WHERE n = 1 UNION ALL SELECT product_id, print_id FROM drawn_region
  UNION ALL SELECT product_id, print_id FROM rest JOIN sibling USING (set_id, nname, rkey) WHERE print_id NOT IN (SELECT print_id FROM f2)),
claims AS (SELECT product_id, print_id, 'number' AS method, 70 AS confidence FROM numbers0 UNION ALL SELECT product_id, print_id, 'artwork', 65 FROM drawn UNION ALL SELECT product_id, print_id, 'region', 60 FROM region UNION ALL SELECT product_id, print_id, 'name', 40 FROM by_name),
best AS (SELECT *, max(confidence) OVER (PARTITION BY print_id) AS top FROM claims),
sole AS (SELECT *, count(*) OVER (PARTITION BY print_id) AS n FROM best WHERE confidence = top)"""


def _picked(source: str, name: str) -> str:
    """The artwork rule in SQL, over rows of kind, print_id, product_id, pname, alt_art."""
    suffix, original = "regexp_matches(pname, ' \\((Original|New) Artwork\\)$')", "pname LIKE '% (Original Artwork)'"
    return f"""{name} AS (SELECT print_id, product_id FROM (
  SELECT print_id, CASE WHEN bool_or(alt_art) AND count(*) FILTER (WHERE {suffix} AND NOT {original}) > 0
    THEN CASE WHEN count(*) FILTER (WHERE {suffix} AND NOT {original}) = 1 THEN min(product_id) FILTER (WHERE {suffix} AND NOT {original}) END
    ELSE arg_min(product_id, (CASE WHEN {original} THEN 0 WHEN NOT {suffix} THEN 1 ELSE 2 END, product_id)) END AS product_id
  FROM {source} GROUP BY print_id
  HAVING count(*) > 1 AND count(*) FILTER (WHERE NOT {suffix}) < 2 AND count(DISTINCT lower(regexp_replace(pname, ' \\((Original|New) Artwork\\)$', ''))) = 1) WHERE product_id IS NOT NULL)"""


_GROUP = _GROUP.replace("%ART(art_in, drawn)%", _picked("art_in", "drawn")).replace("%ART(art_region, drawn_region)%", _picked("art_region", "drawn_region"))


@query(f"WITH {_GROUP} SELECT product_id, print_id, method, confidence FROM sole WHERE n = 1")
def import_group(spark: SparkSession, d: str) -> DataFrame:
    """Products of regional sets matched by number, name, artwork and region, with the confidence of each."""
    i, three = c("p_partkey"), lambda x: F.lpad(x.cast("string"), 3, "0")
    part = table(spark, d, "part")
    suffix = F.when(i % 13 == 1, " (Original Artwork)").when(i % 13 == 2, " (New Artwork)").otherwise("")
    products = part.where(i % 6 != 5).select(i.alias("product_id"), c("p_brand").alias("set_id"), F.concat(F.lit("B-EN"), three(c("p_size"))).alias("number"), F.when(i % 11 == 0, "Common").otherwise(c("p_type")).alias("rarity"), F.concat("p_name", suffix).alias("name"))
    region = F.when(i % 4 == 0, "E").when(i % 4 == 1, "").otherwise("EN")
    number = F.concat(F.lit("B-"), region, three(F.when(i % 4 < 2, (c("p_size") + 3) % 50).otherwise(c("p_size"))))
    name = F.when(i % 9 == 4, F.concat("p_name", F.lit(" x"))).otherwise(c("p_name"))
    prints = part.where(i % 7 != 6).select(i.alias("print_id"), c("p_brand").alias("set_id"), number.alias("number"), c("p_type").alias("rarity"), name.alias("name"), (i % 5 == 0).alias("alt_art"))
    return imports.match_group(products, prints, regional=True)


@query("""
WITH prints AS (SELECT p_partkey AS print_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey // 2 END AS external_id, CASE WHEN p_partkey % 10 = 1 THEN p_partkey // 2 + 5 END AS etched_id,
  CASE p_partkey % 4 WHEN 0 THEN ['nonfoil'] WHEN 1 THEN ['foil'] WHEN 2 THEN ['nonfoil', 'foil'] ELSE ['foil', 'etched'] END AS finishes FROM part),
named AS (SELECT product_id, print_id, max(printing) AS printing FROM (SELECT external_id AS product_id, print_id, NULL AS printing FROM prints WHERE external_id IS NOT NULL UNION ALL SELECT etched_id, print_id, 'etched' FROM prints WHERE etched_id IS NOT NULL) GROUP BY 1, 2),
holders AS (SELECT product_id, count(*) AS n, min(print_id) AS print_id, max(printing) AS printing FROM named GROUP BY 1),
split AS (SELECT external_id AS product_id, printing, min(print_id) AS print_id FROM (SELECT external_id, print_id, unnest(finishes) AS printing FROM prints) WHERE external_id IN (SELECT product_id FROM holders WHERE n > 1 AND printing IS NULL) GROUP BY 1, 2 HAVING count(*) = 1),
claims AS (SELECT product_id, print_id, printing FROM holders WHERE n = 1 UNION ALL SELECT product_id, print_id, printing FROM split)
SELECT min(product_id) AS product_id, print_id, printing, 100 AS confidence FROM claims WHERE product_id IN (SELECT p_partkey FROM part) GROUP BY print_id, printing HAVING count(*) = 1""")
def import_by_printing(spark: SparkSession, d: str) -> DataFrame:
    """Products that several prints name go by the finishes that only one of them has."""
    i, part = c("p_partkey"), table(spark, d, "part")
    half = F.floor(i / 2).cast("long")
    finishes = F.when(i % 4 == 0, F.array(F.lit("nonfoil"))).when(i % 4 == 1, F.array(F.lit("foil"))).when(i % 4 == 2, F.array(F.lit("nonfoil"), F.lit("foil"))).otherwise(F.array(F.lit("foil"), F.lit("etched")))
    prints = part.select(i.alias("print_id"), F.when(i % 3 != 0, half).alias("external_id"), F.when(i % 10 == 1, half + 5).alias("etched_id"), finishes.alias("finishes"))
    return imports.by_printing(part.select(i.alias("product_id")), prints).drop("method")
