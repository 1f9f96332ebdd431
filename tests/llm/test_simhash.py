"""SimHash: fingerprints against a plain count of bits, components against all pairs."""

import random
import re

import pytest
import xxhash

from lakewright.llm import base, simhash
from lakewright.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of_all_pairs(prints):
    """The least member of each print's component, all pairs compared."""
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {p: top(p) for p in root}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "ÀB c\x85d e\xa0f G", "a b c " * 300, "x" * 100_000, "line one\nline two\r\n line\x0bthree"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_blocks_do_not_change_fingerprints(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("to be or")).alias("h")).first()["h"] % 2**64 == xxhash.xxh64(b"to be or", seed=42).intdigest()


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


signed = lambda x: x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("parts", [1, 3])
def test_every_pair_in_the_radius_meets(spark, parts):
    """Pairs far from all others, so that a pair has no other way to be connected; more than three flips don't meet."""
    draw, prints, want = random.Random(parts), [], set()
    for k in range(400):
        x, d = draw.getrandbits(64), k % 6
        y = flipped(x, draw.sample(range(64), d) if k % 4 else draw.sample(range(31, 34 + 4), d))
        prints += [signed(x), signed(y)]
        if 0 < d <= 3:
            want.add(tuple(sorted((signed(x), signed(y)))))
    distinct = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    found = simhash.close_pairs(distinct, base.Scratch(spark, "test"), parts=parts).collect()
    assert {tuple(sorted((r["u"], r["v"]))) for r in found} == want


def test_chains_and_balls_against_all_pairs(spark):
    draw, prints = random.Random(5), {0, -1, 1, 7, 15}
    for _ in range(30):
        x = draw.getrandbits(64)
        for _ in range(12):  # a walk
            prints.add(signed(x))
            x = flipped(x, draw.sample(range(64), draw.randint(1, 5)))
        prints |= {signed(flipped(x, draw.sample(range(64), draw.randint(0, 2)))) for _ in range(12)}  # a ball
    scratch = base.Scratch(spark, "test")
    pairs = simhash.close_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), scratch)
    assert pairs.where("bit_count(u ^ v) > 3").count() == 0
    roots = {r["node"]: r["root"] for r in components(pairs, scratch).collect()}
    want = roots_of_all_pairs(prints)
    assert {p: roots.get(p, p) for p in prints} == want


def brute(rows):
    prints = {}
    for key, text in rows:
        prints.setdefault(signed(plain_fingerprint(text)), []).append(key)
    roots = roots_of_all_pairs(prints)
    members = {}
    for p, r in roots.items():
        members.setdefault(r, []).extend(k for k in prints[p] if k is not None)
    return sorted(((k, f"{p % 2**64:016x}", min(members[roots[p]], default=None)) for p, keys in prints.items() for k in keys), key=repr)


def test_query_on_the_table(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = simhash.op11_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([tuple(r) for r in docs])


def test_odd_rows(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(3, None), (2, ""), (None, " "), (5, "a"), (5, "a"), (5, "b"), (None, "c"), (8, "A"), (9, long), (10, long.upper()), (11, "a b"), (2, "a b")]
    docs = docs_of(*rows).withColumnRenamed("score", "fp")
    got = simhash.simhash_components(docs, base.Scratch(spark, "test"))
    from pyspark.sql import functions as F

    told = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted((tuple(r) for r in told.collect()), key=repr) == brute(rows)
    assert simhash.simhash_components(docs.limit(0), base.Scratch(spark, "test")).count() == 0
