"""Hash trees, strict chunks, greedy matching, backfills that commit days, pushes and deltas with odd input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakewright.operators import assign, chunks, feed, hashtree, merge
from lakewright.sources.backfill import DayTable
from lakewright.sources.scratch import scratch


def by_hand(sizes, limit):
    out, chunk, total = [], 0, 0
    for k, s in enumerate(sizes):
        if k and total + s > limit:
            chunk, total = chunk + 1, 0
        total += s
        out.append(chunk)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strict_chunks(spark, seed):
    draw = random.Random(seed)
    sizes = {g: [draw.choice([0, 1, 5, 9, 30, 41]) for _ in range(n)] for g, n in (("a", 150), ("b", 1), (None, 40), ("c", 7))}
    sizes["a"][0] = sizes["b"][0] = 99  # larger than the limit
    data = [(g, k, s, "x") for g, v in sizes.items() for k, s in enumerate(v)]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "g string, at long, s long, _fit string").repartition(5)
    got = {(r["g"], r["at"]): r["chunk"] for r in chunks.greedy_chunks(df, ["g"], ["at"], F.col("s"), 40).collect()}
    assert got == {(g, k): n for g, v in sizes.items() for k, n in enumerate(by_hand(v, 40))}
    one = spark.createDataFrame([(k, s) for k, s in enumerate(sizes["a"])], "at long, s long")
    assert [r["chunk"] for r in chunks.greedy_chunks(one, [], ["at"], F.col("s"), 40).orderBy("at").collect()] == by_hand(sizes["a"], 40)
    assert chunks.greedy_chunks(df.limit(0), ["g"], ["at"], F.col("s"), 40).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_greedy_pairs_as_the_loop(spark, seed):
    draw = random.Random(seed)
    pairs = list({(draw.randrange(25), draw.randrange(25), draw.randrange(9)) for _ in range(160)})
    left, right, want = set(), set(), set()
    for a, b, w in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((w, a, b))
    df = spark.createDataFrame([*pairs, (None, 3, 0)], "a int, b int, w int")
    assert {tuple(r) for r in assign.greedy_pairs(df, "a", "b", ["w"]).collect()} == want


def test_greedy_pairs_never_ends_in_a_part(spark):
    chain = spark.createDataFrame([(k // 2, (k + 1) // 2, k) for k in range(12)], "a int, b int, w int")
    assert assign.greedy_pairs(chain, "a", "b", ["w"]).count() == 6
    with pytest.raises(RuntimeError, match="rounds"):
        assign.greedy_pairs(chain, "a", "b", ["w"], rounds=2)
    assert assign.greedy_pairs(chain.limit(0), "a", "b", ["w"]).count() == 0


def cards_by_loop(prints, cards):
    out, used = {}, set()
    todo = [p for p in prints if not p[3]]
    for p in todo:
        hits = [x for x in cards if x[1:] == p[1:3]]
        if len(hits) == 1 and hits[0][0] not in used:
            used.add(hits[0][0])
            out[p[0]] = hits[0][0]
    numbers = {p[1] for p in prints}
    rest = [x for x in cards if x[0] not in used and x[1] not in numbers]
    names = [p[2] for p in prints if p[0] not in out]
    for p in [p for p in todo if p[0] not in out]:
        hits = [x for x in rest if x[2] == p[2]]
        if len(hits) == 1 and names.count(p[2]) == 1:
            out[p[0]] = hits[0][0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cards_once(spark, seed):
    draw = random.Random(seed)
    prints = [(k, str(draw.randrange(12)), draw.choice("abcdefghij"), draw.random() < 0.2) for k in range(30)]
    cards = [(100 + k, str(draw.randrange(20)), draw.choice("abcdefghijkl")) for k in range(30)]
    got = assign.cards_once(spark.createDataFrame(prints, "print_id int, number string, name string, has_picture boolean"), spark.createDataFrame(cards, "card_id int, number string, name string"))
    assert {r["print_id"]: r["card_id"] for r in got.collect()} == cards_by_loop(prints, cards)


MAPPED = "id long, ids map<string,string>, parts array<struct<k:string,m:map<string,int>>>, n int"


def mapped(spark, changed=()):
    row = lambda k: (k, {"a": str(k), "b": "x"} if k % 2 else {"b": "x", "a": str(k)}, [("p", {"z": k, "y": 1})], k + 100 if k in changed else k)
    return spark.createDataFrame([row(k) for k in range(200)], MAPPED)


def test_deltas_of_tables_with_maps(spark):
    old, new = mapped(spark), mapped(spark, {3, 7}).where("id != 11")
    # The same entries in another order are no change.
    new = new.withColumn("ids", F.map_from_entries(F.reverse(F.map_entries("ids"))))
    change = merge.delta(old, new, ["id"])
    assert sorted((r["op"], r["id"]) for r in change.collect()) == [("delete", 11), ("upsert", 3), ("upsert", 7)]
    applied = merge.apply_delta(old, change, ["id"])
    assert {r["id"]: (r["ids"], r["n"]) for r in applied.collect()} == {r["id"]: (r["ids"], r["n"]) for r in new.collect()}
    done = merge.upsert_if_different(old, new, ["id"], ["ids", "parts", "n"], "action")
    assert {r["action"]: r["count"] for r in done.groupBy("action").count().collect()} == {"unchanged": 197, "updated": 2, "kept": 1}


def test_a_tree_finds_what_except_finds(spark, tmp_path):
    old, new = mapped(spark), mapped(spark, {5, 9}).where("id != 20").unionByName(mapped(spark).where("id = 1").withColumn("id", F.lit(900).cast("long")))
    trees = [hashtree.tree(df, ["id"]) for df in (old, new)]
    leaves = hashtree.different(*trees)
    want = {r["leaf"] for r in old.where("id IN (5, 9, 20)").select("id").union(spark.range(900, 901)).select(hashtree.leaf(["id"]).alias("leaf")).collect()}
    assert set(leaves) == want
    for name, df in (("a", old), ("b", new)):
        df.withColumn("leaf", hashtree.leaf(["id"])).write.partitionBy("leaf").parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{name}") for name in "ab"]
    got = hashtree.tree_delta(*stored, *trees, ["id"])
    assert sorted((r["op"], r["id"]) for r in got.collect()) == [("delete", 20), ("upsert", 5), ("upsert", 9), ("upsert", 900)]
    # Unchanged ranges aren't read: their files can be missing.
    import shutil

    for name in "ab":
        for folder in (tmp_path / name).glob("leaf=*"):
            if int(folder.name[5:]) not in want:
                shutil.rmtree(folder)
    assert hashtree.tree_delta(*(spark.read.parquet(f"{tmp_path}/{name}") for name in "ab"), *trees, ["id"]).count() == 4
    assert hashtree.different(trees[0], hashtree.tree(mapped(spark).repartition(7), ["id"])) == []
    # Repeats and changes that cancel out in a plain sum of values are seen.
    twice = old.unionByName(old.where("id = 4"))
    assert len(hashtree.different(trees[0], hashtree.tree(twice, ["id"]))) == 1


def test_depth_follows_the_rows():
    assert [hashtree.depth_for(n) for n in (0, 10**6, 10**8, 10**12)] == [1, 1, 3, 5]


DAY = "day date, k long"


def test_a_stopped_backfill_goes_on(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(20)]
    landed = [d for k, d in enumerate(days) if k not in (4, 12, 13, 14)]
    data = spark.createDataFrame([(d, k) for k, d in enumerate(landed) for _ in range(3)], DAY)
    spine = spark.createDataFrame([(d,) for d in days], "day date")
    root = scratch(spark, "test-backfill")
    table = DayTable(spark, root, data.schema)
    seen = []

    def stop(part):
        seen.append(part)
        if len(seen) == 3:
            # Killed between the rows and the ledger.
            data.where(F.col("day").isin(part)).write.parquet(f"{root}/days/lost")
            raise InterruptedError

    with pytest.raises(InterruptedError):
        table.backfill(spine, data.select("day"), data, at_a_time=2, before_commit=stop)
    assert table.rows().groupBy("day").count().where("count = 3").count() == 4 and table.rows().count() == 12
    again = DayTable(spark, root, data.schema)
    assert again.backfill(spine, data.select("day"), data, at_a_time=5) == 7
    want = [(d, 3) for d in landed if d < days[12]]
    assert rows(again.rows().groupBy("day").count()) == sorted(want, key=repr) == rows(again.ledger().select("day", "n"))
    assert again.backfill(spine, data.select("day"), data) == 0 and again.clean() == []


def test_a_key_twice_in_a_push(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    stored = spark.createDataFrame([("u", 1, "a", t(1), None, 1), ("u", 9, "q", t(1), None, 2)], "owner string, k int, v string, updated_at timestamp, deleted_at timestamp, seq long")
    pushed = spark.createDataFrame([("u", 1, "b", t(2), None, t(1)), ("u", 1, "c", t(3), None, t(1)), ("u", 2, "x", t(5), None, None), ("u", 2, None, t(5), t(5), None), ("u", 3, "z", t(5), None, None), ("u", 3, "y", t(5), None, None)], "owner string, k int, v string, updated_at timestamp, deleted_at timestamp, base_updated_at timestamp")
    after, done = feed.push(stored, pushed, "owner", "k", ["v"])
    assert rows(after.select("k", "v", "seq")) == [(1, "c", 3), (3, "z", 4), (9, "q", 2)]
    assert rows(done.select("k", "action")) == [(1, "apply"), (1, "superseded"), (2, "skip"), (2, "superseded"), (3, "insert"), (3, "superseded")]


def test_sets_of_one_key_make_no_pairs(spark):
    """Many sets of one name, day or code on both sides: as many rows as sets, not their product."""
    n = 3000
    ours = spark.range(n).select(F.concat(F.lit("o"), "id").alias("code"), F.array(F.lit("k"), F.concat(F.lit("o"), "id")).alias("codes"), F.lit("x").alias("name"), F.lit("d").alias("released_on"))
    theirs = spark.range(n).select(F.concat(F.lit("t"), "id").alias("set_id"), F.when(F.col("id") > 0, "k").otherwise("o7").alias("code"), F.when(F.col("id") > 0, "x").otherwise("y").alias("name"), F.lit("d").alias("released_on"))
    got = assign.match_sets(ours, theirs, spark.createDataFrame([], "code string, set_id string"))
    plan = lambda p: [p, *(y for k in range(p.children().size()) for y in plan(p.children().apply(k)))]
    joins = [p for p in plan(got._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Join"]
    assert joins and all(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, j).count() <= 2 * n for j in joins)


def test_chunks_of_small_and_large_keys(spark, monkeypatch):
    """Small keys are dealt out once and saved nowhere; those with more rows than a task takes go by ranges; both alike."""
    draw = random.Random(5)
    data = [(g, n, draw.choice([None, 0, 3, 17, 55])) for g, most in ((None, 9), ("a", 40), ("b", 7)) for n in range(most)]
    df = spark.createDataFrame(data, "g string, at int, s int")
    saved = []
    monkeypatch.setattr(chunks.Steps, "save", lambda self, d, save=chunks.Steps.save: saved.append(d) or save(self, d))
    want = rows(chunks.greedy_chunks(df, ["g"], ["at"], F.col("s"), 60))
    assert len(saved) == 1 and want[0][-1] == 0
    monkeypatch.setattr(chunks, "IN_TURN", 8)
    assert rows(chunks.greedy_chunks(df, ["g"], ["at"], F.col("s"), 60)) == want
