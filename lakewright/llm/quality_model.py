"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are the words and punctuation marks of a text and their neighbouring pairs (all pairs of equal ones count
as one feature), hashed into 2**BITS places and divided by their number, so that a text's length doesn't matter.
Training takes about MAX_TRAIN labelled texts, never twice as many, chosen by the hash of their ids; their sparse
features are counted on the executors. Scoring is a sparse dot
product with the broadcast weights (2**BITS floats), one pass without a shuffle.

Cases: a null or empty text scores by the bias alone; labelled rows with a null label, or without a text, teach
nothing; different labels of one text all count, and of several texts with one id the least one teaches; with no labelled row every score is 0.5; repeated rows are scored
each on its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, WordHashes, free_name, mix, table

BITS = 18
SCALE = 40.0
#: Labelled texts in training at most; longer texts than this teach nothing (they are scored).
MAX_TRAIN, MAX_TRAIN_CHARS = 4000, 50_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
KEEP_AT = 0.7
SAME = np.uint64(0x5A5A_0001_F00D_CAFE)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def places(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The places of all tokens and neighbouring pairs, with repeats."""
    tokens = TOKEN.findall(text.translate(LOWER)) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[:-1] == h[1:]] = SAME
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        rows = []
        for key, label, text in zip(pdf["h"], pdf["label"], pdf["text"], strict=True):
            at = places(text, hashes)
            where, n = np.unique(at, return_counts=True)
            rows.append((key, label, where.astype(np.int32).tobytes(), (n * (SCALE / max(1, len(at)))).astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["h", "label", "at", "x"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal with a learning rate for each coordinate."""
    size = 2**BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for label, at, x in rows:
            i, v = np.append(at, size), np.append(x, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - label) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled texts outside the held-out fold."""
    # Labels count once, however often their rows are repeated.
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    total = known.count()
    share = min(1.0, max_train / max(1, total))
    chosen = known.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("h", "label").limit(2 * max_train)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.length("text") <= MAX_TRAIN_CHARS)
    # Of several rows with one id the least text teaches, so repeated rows can't swell the sample.
    one = texts.join(F.broadcast(chosen), "id").groupBy("h", "label").agg(F.min("text").alias("text"))
    rows = one.mapInPandas(sparse, "h long, label int, at binary, x binary").collect()
    rows.sort(key=lambda r: (r["h"], r["label"], r["at"]))
    return train([(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows])


def scorer(spark: SparkSession, weights: np.ndarray, bias: float):
    """An Arrow-batched function from texts to the probability of label 1."""
    shared = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        hashes = WordHashes()
        for texts in batches:
            odds = np.empty(len(texts))
            for k, text in enumerate(texts):
                at = places(text, hashes)
                odds[k] = b + (float(w[at].sum()) * SCALE / len(at) if len(at) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return score.asNondeterministic()


def quality_scores(docs: DataFrame, labels: DataFrame, *, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    weights, bias = fit(docs, labels)
    scored = docs.select("doc_id", scorer(docs.sparkSession, weights, bias)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    weights, bias = fit(docs, labels)
    score = free_name(docs, "score")
    return docs.withColumn(score, scorer(docs.sparkSession, weights, bias)(F.col("text"))).where(F.col(score) >= keep_at).drop(score)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
