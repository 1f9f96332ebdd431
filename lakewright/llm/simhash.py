"""SimHash near-duplicates: fingerprints that differ in few bits meet on shared variants.

A fingerprint has a bit set where over half of the hashes of a text's three-word shingles (repeats count) have it.
Two fingerprints are linked if they differ in RADIUS = 3 bits or fewer.

Links are found by meeting in the middle. Half of three flips are one and a half, so one side takes two and the other
one, and parity says which: fingerprints that differ in an odd number of bits have different parities. Every
fingerprint emits itself and its 64 variants of one flip; those with an odd number of set bits emit variants of two
flips too. Of three differing bits two always lie in the same half of the 64, so only pairs of flips within a half are
emitted (992): 65 variants of an even fingerprint, 1,057 of an odd one.

All emitters of a variant that are within one flip of it are within two of each other, and an emitter at two flips is
within three of them. So a variant needs no pairs: each emitter links to the least one within a flip, the centre. Where
none is that near, nothing within the radius meets there alone. Links are deduplicated and each is verified by
counting bits. Their number is bounded by the variants', whatever the size of a group.

Only distinct fingerprints emit, so copies cost nothing, and a variant has 1,057 emitters at most: its key is never hot.
The shuffle is about 560 variants a distinct fingerprint. It may be dealt in PARTS by the variant, one after the other,
which divides what is on disk at a time; every part covers all fingerprints.

Cases: a null text, or one without a word, has the fingerprint zero, which is linked like any other; a text of one or
two words has one shingle, the whole sequence; repeated rows and ids are judged each on its own; a null id has a
row, and counts as a component's least id only if there is no other (then it is null); an empty table gives an empty
result; other columns are not read. Long texts are hashed in blocks, so memory beyond the text stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, table
from .components import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Variants are dealt out in so many parts, one at a time.
PARTS = 2
#: Shingles that are counted at a time.
BLOCK = 1 << 14
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_signed = lambda x: x - 2**BITS if x >= 2 ** (BITS - 1) else x
#: Masks of no flip and one, and of two flips in the same half.
NEAR = [0] + [_signed(1 << k) for k in range(BITS)]
FAR = [_signed(1 << i | 1 << j) for low in (0, BITS // 2) for i, j in combinations(range(low, low + BITS // 2), 2)]


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, as a signed number."""
    # Bytes lower only A-Z, and split at the six white characters of ASCII.
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= SHINGLE else iter([b" ".join(w)])  # noqa: B905
    ones, n = np.zeros(BITS, np.int64), 0
    while len(h := np.fromiter(map(_hash, islice(shingles, BLOCK)), "<u8")):
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprinter():
    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return fingerprints


def _flips(masks: list[int]) -> Column:
    return F.array(*(F.lit(m) for m in masks))


def close_pairs(distinct: DataFrame, scratch: Scratch, *, parts: int = PARTS) -> DataFrame:
    """u, v: links among different fingerprints (column fp, no repeats) that connect all those within RADIUS bits."""
    odd = F.bit_count("fp") % 2 == 1
    emitted = distinct.select("fp", F.explode(F.when(odd, _flips(NEAR + FAR)).otherwise(_flips(NEAR))).alias("mask"))
    variants = emitted.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("z"), "mask")
    close = distinct.select("fp", F.explode(_flips(NEAR)).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("z"), "fp")
    found = []
    for part in range(parts):
        mine = F.pmod(F.xxhash64("z"), F.lit(parts)) == part
        centres = close.where(mine).groupBy("z").agg(F.min("fp").alias("v"))
        # A variant has 65 near emitters at most, so no partition of the hashed side is uneven.
        met = variants.where(mine).join(centres.hint("shuffle_hash"), "z")
        pairs = met.select(F.col("z").bitwiseXOR(F.col("mask")).alias("u"), "v").where("u != v").distinct()
        found.append(scratch.save(pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS), "pairs"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simhash_components(docs: DataFrame, scratch: Scratch, *, parts: int = PARTS) -> DataFrame:
    """doc_id, fp (a signed number), component_id: the least doc_id among all that links reach."""
    marked = scratch.save(docs.select("doc_id", fingerprinter()(F.col("text")).alias("fp")), "marked")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(close_pairs(distinct.select("fp"), scratch, parts=parts), scratch)
    rooted = scratch.save(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    # Saved, so that what joins the documents are two plain exchanges, which Spark can split at a hot fingerprint.
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    scratch.only("marked", "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
