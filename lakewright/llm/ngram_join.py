"""N-gram Jaccard join by chosen paths.

Texts become sets of word 5-grams. Texts with equal sets are one node. Each node has a sketch of min-hashes; in each
run, a path starts at a root bucket, and every bucket picks PICKS places of the sketch by its own hash; the nodes
that agree in a picked place go on together into a child bucket. A bucket that is small, or doesn't get smaller, is
brute-forced on the sketches; the others are split again, to DEPTH. A pair at the threshold survives a split with
probability 1 - (1 - similarity)**PICKS, which fixes how many runs reach the target recall. Pairs whose sketches
come close join their nodes to candidate clusters, and within these every pair is verified on the whole sets.

Large buckets and clusters are compared as pairs of bounded blocks, so no task holds a whole group, and a task sends
out sums and a spanning forest of links, never all pairs.

Cases: a text of fewer than five words, but some, has one n-gram of all its words; a text without words, null ones
included, is alone in its class; a row without an id has no class and no links; repeated rows are copies of each
other; ties for the least id don't matter, as equal ids are equal; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SIMILARITY, Scratch, free_name, hashed_words, mix, shingled, table, text_slices
from .components import components

PLACES = 64
PICKS, DEPTH, SMALL, RECALL = 2, 4, 48, 0.9999
#: Nodes of one block, and 5-grams of one block of sets; a task compares two blocks at most.
SKETCH_BLOCK, SET_BLOCK, SET_GRAMS = 1024, 512, 2_000_000
#: 5-grams that are counted at a time.
STRIP = 1_000_000
#: Sketches that agree in so many places are candidates: five standard deviations below the threshold.
CLOSE = 0.56

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, PLACES, dtype=np.uint64)


def runs_for(similarity: float, recall: float, picks: int = PICKS, depth: int = DEPTH) -> int:
    once = (1 - (1 - similarity) ** picks) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def sketches(own: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The upper halves of PLACES min-hashes of each text's 5-grams, of texts that have some; one row a text."""
    out = np.empty((len(begins), PLACES), np.uint32)
    for k in range(PLACES if len(begins) else 0):
        out[:, k] = np.minimum.reduceat(own * MULTIPLIERS[k] + OFFSETS[k], begins) >> np.uint64(32)
    return out


def digest(own: np.ndarray) -> tuple[bytes, bytes]:
    """A set's 128-bit hash and its sorted elements."""
    packed = np.unique(own).tobytes()
    return xxhash.xxh3_128_digest(packed), packed


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, a row's number and its text's hash in; the same without the text, the hash of the set of 5-grams, a sketch of it and its size out."""
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            own, ends = shingled(*hashed_words(batch.column(1).slice(a, b - a)))
            some = np.flatnonzero(np.diff(ends))
            sets = [digest(own[ends[i] : ends[i + 1]]) for i in some.tolist()]
            sketch = sketches(own, ends[some])
            filled = [None] * (b - a)
            node, packed, grams = list(filled), list(filled), np.zeros(b - a, np.int32)
            for k, i in enumerate(some.tolist()):
                node[i], packed[i], grams[i] = sets[k][0], sketch[k].tobytes(), len(sets[k][1]) // 8
            columns = [*(batch.column(k).slice(a, b - a) for k in (0, 2, 3)), pa.array(node, pa.binary()), pa.array(packed, pa.binary()), pa.array(grams)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "h", "node", "sketch", "grams"])


def children(parents: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """The child buckets of each row, PICKS columns."""
    out = np.empty((len(parents), PICKS), np.uint64)
    first = mix(parents + np.uint64(0x51ED270B)) % np.uint64(PLACES)
    for k in range(PICKS):
        step = np.uint64(1) + mix(parents + np.uint64(0xA24BAED4)) % np.uint64(PLACES - 1)
        at = ((first + np.uint64(k) * step) % np.uint64(PLACES)).astype(np.int64)
        value = sketches[np.arange(len(parents)), at].astype(np.uint64)
        out[:, k] = mix(parents * np.uint64(0x9E3779B97F4A7C15) + mix((at.astype(np.uint64) << np.uint64(32)) | value))
    return out


def unpack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), PLACES)


def first_buckets(runs: int):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = unpack(pdf["sketch"])
            for run in range(runs):
                below = children(np.full(len(pdf), mix(np.array([run + 1], np.uint64))[0]), s)
                for k in range(PICKS):
                    yield pd.DataFrame({"bucket": below[:, k].astype(np.int64), "n": pdf["n"], "above": np.int64(0)})

    return expand


def next_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        below = children(pdf["bucket"].to_numpy().astype(np.uint64), unpack(pdf["sketch"]))
        for k in range(PICKS):
            yield pd.DataFrame({"bucket": below[:, k].astype(np.int64), "n": pdf["n"], "above": pdf["size"]})


def leaf_buckets(nodes: DataFrame, runs: int, scratch: Scratch, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """bucket, n, size: the buckets that aren't split further and hold two nodes or more."""
    at_most_two = "bucket long, n long, above long"
    entries = nodes.select("n", "sketch").mapInPandas(first_buckets(runs), at_most_two)
    leaves = None
    for level in range(1, depth + 1):
        # The same node may reach a bucket along one path only, but a row that is computed again must not count twice.
        now = scratch.save(entries, "entries")
        sizes = now.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        sized = scratch.save(now.join(sizes, "bucket"), "sized")
        scratch.drop(now)
        stuck = (F.col("above") > 0) & (F.col("size") > 0.7 * F.col("above"))
        done = (F.col("size") <= small) | stuck | F.lit(level == depth)
        part = sized.where(done).select("bucket", "n", "size")
        leaves = part if leaves is None else leaves.unionByName(part)
        rest = sized.where(~done)
        if level == depth or rest.isEmpty():
            break
        entries = rest.select("bucket", "n", "size").join(nodes.select("n", "sketch"), "n").mapInPandas(next_buckets, at_most_two)
    return leaves


def blocked(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks its group's block is in: columns a, b (the pair) and mine."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("long")
    own = F.pmod(F.xxhash64("n", group), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b")))
    return df.withColumn("mine", own).withColumn("pair", F.explode(pairs)).select("*", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).drop("pair")


def by_group(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """A function over sorted batches that works on each run of equal keys; it holds one group at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        done: list[pd.DataFrame] = []
        rows = 0
        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[keys]
            new = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, new), np.append(new, len(pdf)), strict=True):
                key = tuple(k.iloc[a])
                part = pdf.iloc[a:b]
                if held and key != last:
                    out = work(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
                    held = []
                    if out is not None:
                        done.append(out)
                        rows += len(out)
                        if rows > 5000:
                            yield pd.concat(done, ignore_index=True)
                            done, rows = [], 0
                held.append(part)
                last = key
        if held and (out := work(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))) is not None:
            done.append(out)
        if done:
            yield pd.concat(done, ignore_index=True)

    return run


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    if not len(pairs):
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def close_pairs(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Links of a spanning forest over the nodes of two blocks whose sketches come close."""
    if len(pdf) < 2:
        return None
    s = unpack(pdf["sketch"])
    mine = pdf["mine"].to_numpy()
    cross = pdf["a"].iloc[0] != pdf["b"].iloc[0]
    least = CLOSE * PLACES
    if len(pdf) == 2:
        if (s[0] == s[1]).sum() < least or (cross and mine[0] == mine[1]):
            return None
        return pd.DataFrame({"u": [pdf["n"].iloc[0]], "v": [pdf["n"].iloc[1]]})
    found = []
    for i in range(0, len(s), 64):
        same = np.zeros((len(s[i : i + 64]), len(s)), np.uint8)
        for j in range(PLACES):
            same += s[i : i + 64, j, None] == s[None, :, j]
        x, y = np.nonzero(same >= least)
        x += i
        keep = (x < y) & (mine[x] != mine[y]) if cross else x < y
        if keep.any():
            part = np.stack([x[keep], y[keep]], axis=1)
            r = forest(len(s), part)  # a forest has the same components, and fewer links
            at = np.flatnonzero(r != np.arange(len(s)))
            found.append(np.stack([r[at], at], axis=1))
    if not found:
        return None
    r = forest(len(s), np.concatenate(found))
    at = np.flatnonzero(r != np.arange(len(s)))
    node = pdf["n"].to_numpy()
    return pd.DataFrame({"u": node[r[at]], "v": node[at]})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets (sorted) share, counted in ranges of hashes, so that the memory is bounded."""
    n = len(sets)
    shared = np.zeros((n, n), np.float32)
    ranges = max(1, -(-sum(map(len, sets)) // STRIP))
    top = int(np.iinfo(sets[0].dtype).max) + 1
    cuts = [np.searchsorted(x, np.array([k * top // ranges for k in range(1, ranges)], x.dtype)) for x in sets]
    for k in range(ranges):
        part = [x[c[k - 1] if k else 0 : c[k] if k < ranges - 1 else len(x)] for x, c in zip(sets, cuts, strict=True)]
        add_overlaps(shared, part)
    return shared


def add_overlaps(shared: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds what the sets share, by products of bounded strips of the incidence matrix."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held[at] > 1
    rows, at = rows[keep], at[keep]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    width = max(1, 4_000_000 // n)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [low, low + width])
        strip = np.zeros((n, min(width, int(at[b - 1]) + 1 - low)), np.float32)
        strip[rows[a:b], at[a:b] - low] = 1
        shared += strip @ strip.T


def linker(similarity: float):
    def link(pdf: pd.DataFrame) -> pd.DataFrame | None:
        """For each node of two blocks: the copies that it links to, and its root in a spanning forest of links."""
        pdf = pdf.drop_duplicates("n", ignore_index=True)
        if len(pdf) < 2:
            return None
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        sizes = np.array([len(x) for x in sets], np.float64)
        mine, copies, node = pdf["mine"].to_numpy(), pdf["copies"].to_numpy(), pdf["n"].to_numpy()
        if len(sets) == 2:
            shared = np.zeros((2, 2))
            shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        else:
            shared = overlaps(sets).astype(np.float64)
        linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        if pdf["a"].iloc[0] != pdf["b"].iloc[0]:
            linked &= mine[:, None] != mine[None, :]
        weight = linked @ copies
        if not weight.any():
            return None
        r = forest(len(sets), np.argwhere(np.triu(linked)))
        has = weight > 0
        return pd.DataFrame({"n": node[has], "weight": weight[has].astype(np.int64), "root": node[r[has]]})

    return link


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole 5-gram sets of the rows whose text still has the node's set, one of each node in a task; the node's number is the first column, text and node are the last two."""
    seen: set[int] = set()
    for batch in batches:
        fresh = [n not in seen and not seen.add(n) for n in batch.column(0).to_pylist()]
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        for a, b in text_slices(batch.column("text")):
            part = batch.slice(a, b - a)
            own, ends = shingled(*hashed_words(part.column("text")))
            sets = [digest(own[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            fits = pa.array([d == n for (d, _), n in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
            packed = pa.array([x for _, x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], packed], [*part.schema.names[:-2], "shingles"]).filter(fits)


def ngram_join(docs: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least id of its class), n_links (how many other rows are at least that similar)."""
    return joined_rows(docs, F.lit(0).cast("long"), similarity, recall).select("doc_id", "class_id", "n_links")


def joined_rows(docs: DataFrame, row: Column, similarity: float, recall: float) -> DataFrame:
    """doc_id, row (a column of docs), class_id, n_links, class: a number that rows of a class share, null for rows without an id or a word."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    texts = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(docs.select("doc_id", "text", row.alias("row"), F.xxhash64("text").alias("h")).mapInArrow(fingerprints, f"doc_id {id_type}, row long, h long, node binary, sketch binary, grams int"), "rows")
    lone = F.col("node").isNull() | F.col("doc_id").isNull()
    # Everything that equal sets share is part of the key, and nodes are numbered, so that aggregations hash.
    nodes = rows.where(~lone).groupBy("node", "sketch", "grams").agg(F.count("*").alias("copies"), F.min("doc_id").alias("id"), F.min_by("h", "doc_id").alias("h"))
    nodes = scratch.save(nodes.withColumn("n", F.monotonically_increasing_id()), "nodes")

    leaves = leaf_buckets(nodes, runs_for(similarity, recall), scratch)
    compared = blocked(leaves, "bucket", "size", SKETCH_BLOCK).join(nodes.select("n", "sketch"), "n")
    keys = ["bucket", "a", "b"]
    close = compared.select(*keys, "mine", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys, "n").mapInPandas(by_group(keys, close_pairs), "u long, v long")
    clusters = components(close, scratch).select(F.col("node").alias("n"), F.col("root").alias("cluster"))

    members = clusters.union(clusters.select("cluster", "cluster").distinct())
    blocks = F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("grams") / SET_GRAMS)).cast("long")
    sizes = members.join(nodes.select("n", "grams"), "n").groupBy("cluster").agg(blocks.alias("blocks"))
    picked = members.join(sizes, "cluster").join(nodes.select("n", "copies", F.col("id").alias("doc_id"), "h", "node"), "n")
    # By id and text, as an id may have many texts.
    wanted = texts.withColumn("h", F.xxhash64("text")).join(picked, ["doc_id", "h"]).select("n", "cluster", "blocks", "copies", "text", "node")
    sets = wanted.mapInArrow(shingle_sets, "n long, cluster long, blocks long, copies long, shingles binary")
    keys = ["cluster", "a", "b"]
    dealt = blocked(sets, "cluster", "blocks", 1).select(*keys, "mine", "n", "copies", "shingles")
    linked = dealt.repartition(*keys).sortWithinPartitions(*keys, "n").mapInPandas(by_group(keys, linker(similarity)), "n long, weight long, root long")
    linked = scratch.save(linked, "linked")

    roots = components(linked.select(F.col("n").alias("u"), F.col("root").alias("v")), scratch).withColumnRenamed("node", "n")
    weights = scratch.save(linked.groupBy("n").agg(F.sum("weight").alias("weight")), "weights")
    found = weights.join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")).join(nodes.select("n", "id"), "n")
    classes = scratch.save(found.groupBy("root").agg(F.min("id").alias("class_id")), "classes")
    classes = found.join(classes, "root").select("n", "weight", "class_id", "root")
    n_links = F.coalesce("weight", F.lit(0)) + F.col("copies") - 1
    known = nodes.select("n", "node", "copies", "id").join(classes, "n", "left").select("node", F.coalesce("class_id", "id").alias("class_id"), n_links.cast("long").alias("n_links"), F.coalesce("root", "n").alias("class"))
    # Saved, so that the join reads two plain exchanges, which Spark can split at a text with many copies; texts without words stay out of it.
    known = scratch.save(known, "known")
    scratch.only("rows", "known")
    out = rows.where(~lone).select("doc_id", "row", "node").join(known, "node").select("doc_id", "row", "class_id", "n_links", "class")
    return out.union(rows.where(lone).select("doc_id", "row", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(None).cast("long")))


def one_of_each_class(docs: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of each class of docs, with the least id; rows without an id or a word all stay.

    Each row is judged by its own text, also where several rows have one id.
    """
    number = free_name(docs, "row")
    scratch = Scratch(docs.sparkSession, "one-of-each-class")
    # Written, as the numbers must be the same whenever they are read.
    numbered = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = joined_rows(numbered, F.col(number), similarity, recall)
    first = rows.where(F.col("class").isNotNull() & (F.col("doc_id") == F.col("class_id"))).groupBy("class").agg(F.min("row").alias(number)).select(number)
    kept = scratch.save(first.union(rows.where(F.col("class").isNull()).select("row")), "kept")
    # The kept numbers grow with the rows, so they are never broadcast: one plan at every size, which Spark can split at need.
    return numbered.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
