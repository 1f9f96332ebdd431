"""Merges and change logs over two versions of a table.

The old version of orders lacks the pending ones, the new one lacks the settled ones, and urgent orders have changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.cards import key_rank
from lakewright.functions.values import later_than, stable_hash
from lakewright.operators import assign, merge, snapshot
from lakewright.sources.tables import table

from .registry import query

c = F.col
SHOWN = ["o_orderkey", "o_totalprice", "action"]


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    urgent = c("o_orderpriority") == "1-URGENT"
    new = orders.where("o_orderstatus != 'F'").withColumn("o_totalprice", F.when(urgent, c("o_totalprice") + 10).otherwise(c("o_totalprice")))
    hashed = lambda df: df.withColumn("source_hash", F.md5(F.concat_ws("|", "o_orderkey", "o_orderpriority", F.round(c("o_totalprice") * 100).cast("long").cast("string")).cast("binary")))
    return hashed(orders.where("o_orderstatus != 'P'")), hashed(new)


_VERSIONS = """
old AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderstatus <> 'F')"""
_UPSERT = f"""
WITH {_VERSIONS}
SELECT coalesce(new.o_orderkey, old.o_orderkey) AS o_orderkey,
  CASE WHEN new.o_orderkey IS NULL THEN old.o_totalprice WHEN old.o_orderkey IS NULL OR {{changed}} THEN new.o_totalprice ELSE old.o_totalprice END AS o_totalprice,
  CASE WHEN old.o_orderkey IS NULL THEN 'inserted' WHEN new.o_orderkey IS NULL THEN 'kept' WHEN {{changed}} THEN 'updated' ELSE 'unchanged' END AS action
FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey"""


@query(_UPSERT.format(changed="(new.o_totalprice <> old.o_totalprice)"))
def upsert_hash_guard(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return merge.upsert_by_hash(old, new, ["o_orderkey"], "source_hash", "action").select(*SHOWN)


@query(_UPSERT.format(changed="((new.o_totalprice, new.o_orderpriority) IS DISTINCT FROM (old.o_totalprice, old.o_orderpriority))"))
def upsert_distinct_guard(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return merge.upsert_if_different(old, new, ["o_orderkey"], ["o_totalprice", "o_orderpriority"], "action").select(*SHOWN)


@query(_UPSERT.format(changed="(new.o_orderdate >= old.o_orderdate + CASE WHEN new.o_orderpriority = '2-HIGH' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)"))
def upsert_time_guard(spark: SparkSession, d: str) -> DataFrame:
    """New observations of high priority come a day late and don't replace the stored ones."""
    old, new = versions(spark, d)
    late = F.when(c("o_orderpriority") == "2-HIGH", c("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(c("o_orderdate"))
    return merge.upsert_if_newer(old, new.withColumn("o_orderdate", late), ["o_orderkey"], "o_orderdate", "action").select(*SHOWN)


@query(_UPSERT.format(changed="(length(new.o_orderpriority) - CASE WHEN new.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END >= length(old.o_orderpriority))"))
def upsert_richer_guard(spark: SparkSession, d: str) -> DataFrame:
    """The version with more parts wins; the new one has lost one part of urgent orders."""
    old, new = versions(spark, d)
    old = old.withColumn("parts", F.split("o_orderpriority", ""))
    lost = F.when(c("o_orderpriority") == "1-URGENT", F.slice("parts", 1, F.size("parts") - 1)).otherwise(c("parts"))
    new = new.withColumn("parts", F.split("o_orderpriority", "")).withColumn("parts", lost)
    return merge.upsert_if_richer(old, new, ["o_orderkey"], "parts", "action").select(*SHOWN)


@query(f"""
WITH {_VERSIONS}
SELECT 'conflict' AS kind, count(*) AS n FROM old JOIN new USING (o_orderkey) WHERE new.o_orderpriority = '3-MEDIUM'
UNION ALL SELECT 'rows', count(*) FROM old FULL JOIN new USING (o_orderkey)
UNION ALL SELECT 'taken', count(*) FROM new LEFT JOIN old USING (o_orderkey) WHERE old.o_custkey IS NULL OR new.o_orderpriority <> '3-MEDIUM'""")
def upsert_same_owner(spark: SparkSession, d: str) -> DataFrame:
    """Keys keep their owner; orders of medium priority try to change it and are counted as conflicts."""
    old, new = versions(spark, d)
    moved = new.withColumn("o_custkey", F.when(c("o_orderpriority") == "3-MEDIUM", c("o_custkey") + 1_000_000).otherwise(c("o_custkey"))).withColumn("o_orderdate", F.lit(None).cast("timestamp"))
    merged, conflicts = merge.upsert_same_owner(old, moved, ["o_orderkey"], "o_custkey")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(conflicts, "conflict").unionByName(n(merged, "rows")).unionByName(n(merged.where("o_orderdate IS NULL"), "taken"))


@query(f"WITH {_VERSIONS} SELECT o_orderkey, o_totalprice FROM old UNION ALL SELECT o_orderkey, o_totalprice FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.o_orderkey = new.o_orderkey)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return merge.insert_missing(old, new, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(f"""
WITH {_VERSIONS}
SELECT count(*) FILTER (WHERE old.o_custkey IS NULL) AS inserted, count(*) FILTER (WHERE old.o_totalprice <> new.o_totalprice) AS updated,
  count(*) FILTER (WHERE old.o_totalprice = new.o_totalprice) AS unchanged FROM new LEFT JOIN old USING (o_orderkey)""")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return merge.merge_counts(merge.upsert_by_hash(old, new, ["o_orderkey"], "source_hash", "action"), "action")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem) WHERE nth = 1""")
def last_of_key(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_of_key(table(spark, d, "lineitem"), ["l_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth = 1""")
def first_of_key(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_of_key(table(spark, d, "lineitem"), ["l_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""
SELECT c_custkey FROM customer old WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT s_nationkey, 'BUILDING' AS seg FROM supplier WHERE s_acctbal > 5000) k WHERE k.s_nationkey = old.c_nationkey AND old.c_mktsegment <> k.seg)""")
def drop_siblings(spark: SparkSession, d: str) -> DataFrame:
    """In nations of rich suppliers, only one segment's rows stay."""
    kept = table(spark, d, "supplier").where("s_acctbal > 5000").select(c("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return merge.drop_siblings(table(spark, d, "customer"), kept, ["c_nationkey"], "c_mktsegment").select("c_custkey")


@query("""
SELECT c_custkey, coalesce(l.total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) l ON o_custkey = c_custkey""")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return merge.update_from(table(spark, d, "customer"), changes, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query(_UPSERT.format(changed="(CASE WHEN new.o_orderstatus = 'O' THEN CAST(left(new.o_orderpriority, 1) AS INTEGER) ELSE 0 END <= 3)"))
def replace_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """A picture of the same or a better kind replaces the stored one: rank 3 is stored, the new rank is the priority."""
    old, new = versions(spark, d)
    old, new = old.withColumn("kind", F.lit(3)), new.withColumn("kind", F.left("o_orderpriority", F.lit(1)).cast("int"))
    return merge.replace_by_rank(old, new, ["o_orderkey"], lambda row: row["kind"], "action").select(*SHOWN)


def status_maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """By customer: priority -> latest status, over old and new orders."""
    one = lambda df: df.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "s"))).alias("m"))
    return tuple(map(one, versions(spark, d)))


_MAPS = """
o AS (SELECT o_custkey, o_orderpriority AS entry, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
n AS (SELECT o_custkey, o_orderpriority AS entry, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)"""


@query(f"""
WITH {_MAPS} SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.entry, n.entry) AS entry, o.s AS from_value, n.s AS to_value
FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.entry = n.entry
WHERE o.s IS DISTINCT FROM n.s AND coalesce(o.o_custkey, n.o_custkey) IN (SELECT o_custkey FROM o) AND coalesce(o.o_custkey, n.o_custkey) IN (SELECT o_custkey FROM n)""")
def cdc_map_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = status_maps(spark, d)
    return merge.map_changes(old, new, ["o_custkey"], "m")


@query(f"WITH {_MAPS} SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.entry, n.entry) AS entry, coalesce(n.s, o.s) AS status FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.entry = n.entry")
def merge_maps(spark: SparkSession, d: str) -> DataFrame:
    old, new = status_maps(spark, d)
    return merge.merge_maps(old, new, ["o_custkey"], "m").select("o_custkey", F.explode("m").alias("entry", "status"))


_PARTS = """
old AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 5),
new AS (SELECT p_partkey, p_name, CASE WHEN p_type = 'PROMO' THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_size < 45)"""


def part_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    new = part.where("p_size < 45").withColumn("p_size", F.when(c("p_type") == "PROMO", c("p_size") + 100).otherwise(c("p_size")))
    return tuple(df.select("p_partkey", "p_name", "p_size") for df in (part.where("p_size > 5"), new))


@query(f"""
WITH {_PARTS}
SELECT 'delete' AS op, p_partkey, NULL::VARCHAR AS p_name, NULL::INTEGER AS p_size FROM (SELECT p_partkey FROM old EXCEPT SELECT p_partkey FROM new)
UNION ALL SELECT 'upsert', * FROM (SELECT * FROM new EXCEPT SELECT * FROM old)""")
def except_delta(spark: SparkSession, d: str) -> DataFrame:
    return merge.delta(*part_versions(spark, d), ["p_partkey"])


@query(f"WITH {_PARTS} SELECT * FROM new")
def delta_applied(spark: SparkSession, d: str) -> DataFrame:
    """The old version with the delta is the new version."""
    old, new = part_versions(spark, d)
    return merge.apply_delta(old, merge.delta(old, new, ["p_partkey"]), ["p_partkey"])


@query("""
WITH h AS (SELECT c_nationkey, md5(string_agg(md5(concat_ws('|', c_custkey, c_mktsegment)), ',' ORDER BY c_custkey)) AS h FROM customer GROUP BY 1),
g AS (SELECT c_nationkey, md5(string_agg(md5(concat_ws('|', c_custkey, c_mktsegment)), ',' ORDER BY c_custkey)) AS h FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT coalesce(h.c_nationkey, g.c_nationkey) AS c_nationkey, CASE WHEN g.h IS NULL THEN 'delete' ELSE 'write' END AS op FROM h FULL JOIN g ON h.c_nationkey = g.c_nationkey WHERE h.h IS DISTINCT FROM g.h""")
def changed_groups(spark: SparkSession, d: str) -> DataFrame:
    """The nations whose rows a derived index must write anew, by group hashes."""
    hashed = lambda df: snapshot.group_hash(df, ["c_nationkey"], "c_custkey", ["c_custkey", "c_mktsegment"])
    customer = table(spark, d, "customer")
    return snapshot.changed_groups(hashed(customer), hashed(customer.where("c_acctbal > 0")), ["c_nationkey"])


@query("""
WITH auto AS (SELECT DISTINCT l_partkey, l_suppkey, 'auto' AS method FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')),
manual AS (SELECT p_partkey AS l_partkey, -1 AS l_suppkey, 'manual' AS method FROM part WHERE p_type = 'PROMO'),
new AS (SELECT DISTINCT l_partkey, l_suppkey, 'auto' AS method FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)
SELECT * FROM manual UNION ALL SELECT * FROM auto WHERE l_partkey NOT IN (SELECT l_partkey FROM new) UNION ALL SELECT * FROM new WHERE l_partkey NOT IN (SELECT l_partkey FROM manual)""")
def stale_mappings(spark: SparkSession, d: str) -> DataFrame:
    """New mappings replace the automatic ones of their parts; manual ones stand and displace automatic ones."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    pairs = lambda df: df.select("l_partkey", "l_suppkey").distinct().withColumn("method", F.lit("auto"))
    manual = part.where("p_type = 'PROMO'").select(c("p_partkey").alias("l_partkey"), F.lit(-1).cast("long").alias("l_suppkey"), F.lit("manual").alias("method"))
    auto = pairs(lines.where("l_returnflag = 'R'")).join(manual, "l_partkey", "left_anti")
    return merge.stale_removed(auto.unionByName(manual), pairs(lines.where("l_returnflag = 'A' AND l_quantity > 40")), ["l_partkey"], ["l_partkey"], c("method") == "manual")


@query("""
WITH held AS (SELECT DISTINCT l_suppkey AS holder, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT s_suppkey AS holder, min(p_partkey) AS item FROM supplier JOIN part ON p_size = s_suppkey GROUP BY 1)
SELECT holder, item, false AS manual FROM held WHERE holder NOT IN (SELECT holder FROM m) UNION ALL SELECT holder, item, true FROM m""")
def manual_override(spark: SparkSession, d: str) -> DataFrame:
    """A manual item takes the place of what its holder had."""
    held = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_suppkey").alias("holder"), c("l_partkey").alias("item")).distinct()
    m = table(spark, d, "supplier").join(table(spark, d, "part"), c("p_size") == c("s_suppkey")).groupBy(c("s_suppkey").alias("holder")).agg(F.min("p_partkey").alias("item"))
    return merge.override(held, m, ["holder"], "manual")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey IN (7, 3, 11) THEN list_position([7, 3, 11], n_nationkey) - 1 ELSE n_regionkey END AS position FROM nation""")
def reordered(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumn("position", c("n_regionkey").cast("long"))
    return merge.reordered(nation, "n_nationkey", [7, 3, 11]).select("n_nationkey", c("position").cast("int").alias("position"))


@query("SELECT c_mktsegment, coalesce(max(c_nationkey) + 1, 0) AS next_position FROM customer GROUP BY 1")
def next_position(spark: SparkSession, d: str) -> DataFrame:
    return merge.next_position(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey")


@query("""
SELECT 'kept' AS kind, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'horizon', max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-15'""")
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    kept, horizon = merge.swept(table(spark, d, "events"), F.to_timestamp(F.lit("2024-01-15")), "ts", "event_id")
    return kept.agg(F.lit("kept").alias("kind"), F.count("*").alias("n")).unionByName(horizon.select(F.lit("horizon").alias("kind"), c("horizon").alias("n")))


@query("""
SELECT event_type, count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS removed FROM (SELECT event_type,
  (event_type = 'signup' AND ts < TIMESTAMP '2024-01-20') OR (event_type = 'error' AND ts < TIMESTAMP '2024-01-10') AS gone FROM events) GROUP BY 1""")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of rows with a cut-off each."""
    marked = merge.purge_marks(table(spark, d, "events"), "event_type", "ts", {"signup": "2024-01-20", "error": "2024-01-10"})
    return marked.groupBy("event_type").agg(F.count_if(~c("expired")).alias("kept"), F.count_if("expired").alias("removed"))


@query("""
SELECT event_id, strftime(greatest(date_trunc('millisecond', ts - INTERVAL 1 HOUR), date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND), '%Y-%m-%d %H:%M:%S.%g') AS stamp FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, strftime(greatest(date_trunc('millisecond', ts + INTERVAL 1 HOUR), date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND), '%Y-%m-%d %H:%M:%S.%g') FROM events WHERE event_type = 'view'""")
def monotonic_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps that never go back, whatever the clock says."""
    events = table(spark, d, "events").where(c("event_type").isin("click", "view"))
    clock = F.when(c("event_type") == "click", c("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(c("ts") + F.expr("INTERVAL 1 HOUR"))
    return events.select("event_id", F.date_format(later_than(clock, c("ts")), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"))


@query("""
WITH one AS (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, coalesce(one.flag, '') AS lang FROM orders LEFT JOIN one ON l_orderkey = o_orderkey""")
def backfill_single(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a single detail row take its value; the others stay without."""
    return merge.backfill_single(table(spark, d, "orders"), table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_returnflag"), ["o_orderkey"], "l_returnflag", "lang").select("o_orderkey", F.coalesce("lang", F.lit("")).alias("lang"))


@query("SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) AS hashes, true AS order_free FROM orders")
def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of maps don't depend on the order of their entries."""
    a = F.create_map(F.lit("s"), c("o_orderstatus"), F.lit("p"), c("o_orderpriority"))
    b = F.create_map(F.lit("p"), c("o_orderpriority"), F.lit("s"), c("o_orderstatus"))
    kinds = table(spark, d, "orders").groupBy(stable_hash(a).alias("a"), stable_hash(b).alias("b")).count()
    return kinds.agg(F.count("*").alias("hashes"), F.bool_and(c("a") == c("b")).alias("order_free"))


_OURS = """
ours AS (SELECT 'S' || c_custkey AS code, ['S' || c_custkey, 'K' || c_custkey % 97] AS codes, c_mktsegment || c_custkey % 60 AS name, DATE '2001-01-01' + CAST(c_custkey % 40 AS INTEGER) AS released_on FROM customer),
theirs AS (SELECT c_custkey AS set_id, CASE c_custkey % 5 WHEN 0 THEN 'S' || c_custkey WHEN 1 THEN CASE WHEN c_custkey % 97 < 20 THEN 'K' || c_custkey % 97 END WHEN 2 THEN 'S' || (c_custkey + 1) END AS code,
  CASE WHEN c_custkey % 7 = 1 THEN 'other' ELSE c_mktsegment || c_custkey % 60 END AS name, DATE '2001-01-01' + CAST(c_custkey % 40 AS INTEGER) AS released_on FROM customer WHERE c_custkey % 3 <> 0),
aliases AS (SELECT 'S' || c_custkey AS code, c_custkey + 4 AS set_id FROM customer WHERE c_custkey % 31 = 2)"""


@query(f"""
WITH {_OURS}, said AS (SELECT code, set_id, 0 AS k, 'alias' AS rule FROM aliases WHERE set_id IN (SELECT set_id FROM theirs) AND code IN (SELECT code FROM ours)),
rest AS (SELECT * FROM ours WHERE code NOT IN (SELECT code FROM aliases)),
mine AS (SELECT code, name, unnest(codes) AS c FROM rest), holders AS (SELECT c, count(*) AS n FROM (SELECT unnest(codes) AS c FROM ours) GROUP BY 1),
coded AS (SELECT m.code, m.name, m.c, t.set_id, t.name AS theirs FROM mine m JOIN theirs t ON t.code = m.c),
found AS (SELECT * FROM said
  UNION ALL SELECT code, min(set_id), 1, 'code and name' FROM coded WHERE name = theirs GROUP BY 1 HAVING count(DISTINCT set_id) = 1
  UNION ALL SELECT code, min(set_id), 2, 'code' FROM coded GROUP BY 1 HAVING count(DISTINCT set_id) = 1 AND (SELECT n FROM holders WHERE holders.c = min(coded.c)) = 1
  UNION ALL SELECT rest.code, min(set_id), 3, 'name and day' FROM rest JOIN theirs USING (name, released_on) GROUP BY 1 HAVING count(DISTINCT set_id) = 1)
SELECT code, arg_min(set_id, k) AS set_id, arg_min(rule, k) AS rule FROM found GROUP BY 1""")
def matched_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two catalogs matched by alias, code and name, a code of their own, or name and day."""
    customer, i = table(spark, d, "customer"), c("c_custkey")
    s, day = lambda x: F.concat(F.lit("S"), x.cast("string")), F.date_add(F.lit("2001-01-01").cast("date"), (i % 40).cast("int"))
    k, name = F.concat(F.lit("K"), (i % 97).cast("string")), F.concat("c_mktsegment", (i % 60).cast("string"))
    ours = customer.select(s(i).alias("code"), F.array(s(i), k).alias("codes"), name.alias("name"), day.alias("released_on"))
    code = F.when(i % 5 == 0, s(i)).when((i % 5 == 1) & (i % 97 < 20), k).when(i % 5 == 2, s(i + 1))
    theirs = customer.where(i % 3 != 0).select(i.alias("set_id"), code.alias("code"), F.when(i % 7 == 1, "other").otherwise(name).alias("name"), day.alias("released_on"))
    return assign.match_sets(ours, theirs, customer.where(i % 31 == 2).select(s(i).alias("code"), (i + 4).alias("set_id")))


_RUN = """
held AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'sm.jpg' WHEN 1 THEN 'orig-lowres.jpg' WHEN 2 THEN 'orig.jpg' END AS kind FROM part),
jobs AS (SELECT p_partkey AS id, p_brand || '-' || p_size AS url FROM part WHERE p_partkey % 3 <> 0),
results AS (SELECT DISTINCT p_brand || '-' || p_size AS url, CASE p_size % 6 WHEN 0 THEN 'gone' WHEN 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p_size % 6 > 1 THEN CASE p_size % 5 WHEN 0 THEN 'sm-lowres.jpg' ELSE 'orig.jpg' END END AS kind FROM part),
gone AS (SELECT DISTINCT p_brand || '-' || p_size AS url FROM part WHERE p_size % 5 = 2),
rank(kind, r) AS (VALUES ('sm.jpg', 0), ('orig.jpg', 1), ('sm-lowres.jpg', 2), ('orig-lowres.jpg', 3))"""


@query(f"""
WITH {_RUN}
SELECT 'row' AS what, CAST(h.id AS VARCHAR) AS name, CASE WHEN r.kind IS NOT NULL AND (h.kind IS NULL OR n.r <= o.r) THEN r.kind ELSE h.kind END AS value
FROM held h LEFT JOIN jobs j ON j.id = h.id LEFT JOIN results r ON r.url = j.url AND r.status = 'ok' LEFT JOIN rank n ON n.kind = r.kind LEFT JOIN rank o ON o.kind = h.kind
UNION ALL SELECT 'gone', url, 'before' FROM gone WHERE url NOT IN (SELECT url FROM results WHERE status = 'ok')
UNION ALL SELECT 'gone', url, 'now' FROM results WHERE status = 'gone' AND url NOT IN (SELECT url FROM gone)""")
def transfers_written_back(spark: SparkSession, d: str) -> DataFrame:
    """What a run of picture transfers leaves: better keys, and the list of sources that are gone."""
    part, size = table(spark, d, "part"), c("p_size")
    url = F.concat_ws("-", "p_brand", size.cast("string"))
    folder = lambda x: F.when(x.isNotNull(), F.concat(F.lit("images/x/"), x))
    kind = F.when(size % 4 == 0, "sm.jpg").when(size % 4 == 1, "orig-lowres.jpg").when(size % 4 == 2, "orig.jpg")
    new = F.when(size % 6 > 1, F.when(size % 5 == 0, "sm-lowres.jpg").otherwise("orig.jpg"))
    rows = part.select(c("p_partkey").alias("id"), folder(kind).alias("key"))
    jobs = part.where("p_partkey % 3 != 0").select(c("p_partkey").alias("id"), url.alias("url"))
    results = part.select(url.alias("url"), F.when(size % 6 == 0, "gone").when(size % 6 == 1, "failed").otherwise("ok").alias("status"), folder(new).alias("key")).distinct()
    gone = part.where(size % 5 == 2).select(url.alias("url"), F.lit("before").alias("since")).distinct()
    after, lost = merge.written_back(rows, jobs, results, gone, key_rank, F.lit("now"))
    out = after.select(F.lit("row").alias("what"), c("id").cast("string").alias("name"), F.regexp_replace("key", "^.*/", "").alias("value"))
    return out.unionByName(lost.select(F.lit("gone").alias("what"), c("url").alias("name"), c("since").alias("value")))


@query("""
WITH k AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN 'renders/' || p_partkey || '.png' END AS key FROM part),
firsts AS (SELECT p_brand, arg_min(key, p_partkey) AS first FROM k WHERE key IS NOT NULL GROUP BY 1),
filled AS (SELECT p_partkey, coalesce(key, first) AS key FROM k LEFT JOIN firsts USING (p_brand))
SELECT p_partkey, CASE WHEN key IN (SELECT 'renders/' || p_partkey || '.png' FROM part WHERE p_partkey % 2 = 0) THEN replace(key, 'renders/', 'sm/') ELSE key END AS key FROM filled""")
def keys_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a picture take their first sibling's; keys move to another folder where the file is there."""
    part = table(spark, d, "part")
    name = lambda folder: F.concat(F.lit(f"{folder}/"), c("p_partkey").cast("string"), F.lit(".png"))
    rows = part.select("p_partkey", "p_brand", F.when(c("p_size") % 3 == 0, name("renders")).alias("key"))
    held = part.where("p_partkey % 2 = 0").select(name("sm").alias("key"))
    filled = merge.sibling_values(rows, ["p_brand"], "p_partkey", "key")
    return merge.swapped_keys(filled, "key", "^renders/", "sm/", held).select("p_partkey", "key")
