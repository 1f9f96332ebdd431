"""Embedding whitening: the leading eigenvectors of a covariance that is never formed, found by LOBPCG.

Entries become integers, floor(1024 * c) + 100000, so counts and sums are exact. The covariance V of these integers
is only ever multiplied: a pass over the rows adds up Zᵀ(Z·W), where Z are a batch's centred rows and W a block of a few
directions, task by task and then by dimension; what reaches the driver is dimensions x block, whatever the number of
rows. On the driver a Rayleigh-Ritz step over the iterates, their residuals and the previous directions (an
orthonormal basis, whose products are carried along) gives the next iterates. When the carried residuals are small, the
iterates are multiplied anew by a pass over the rows: only residuals from such a product certify them; else iteration
goes on from there. Each residual must be below TOLERANCE times its eigenvalue (FLOOR times the largest one for tiny
ones, as rounding allows no less).

Every pass reads the table again, row by row in Arrow batches, and keeps nothing: a lost executor costs the tasks it
ran. Rows are never shuffled; a pass shuffles dimensions x tasks partial sums.

Cases: rows whose vector is null, or holds a null or non-finite entry, are dropped, and so are vectors of another length
than most (of equally many the shorter), and empty ones; a null id has rows, repeated rows count and come out each; finite entries
beyond 2**52 count as 2**52 with their sign; a deviation beyond 64 bits is null; components without variance (an
eigenvalue below 1e-12 of the largest) can't be scaled and are left out, so equal vectors, or a single one, give an empty result, as does an
empty table; with fewer dimensions there are fewer components; eigenvalues that tie share any basis of theirs; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import table

COMPONENTS = 8
#: Iterates beyond the wanted components, which speed up the last ones.
GUARD = 8
TOLERANCE, FLOOR, NO_VARIANCE = 1e-12, 5e-14, 1e-12
ROUNDS = 300
#: Rounds after which products are no longer carried along.
REFRESH = 25
SCALE, SHIFT, LARGEST = 1024, 100_000, 2**52
#: Rows that are centred and multiplied at a time.
BLOCK = 4096


def integers(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay, and their integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    flat = pc.list_flatten(vectors.filter(fits)).cast(pa.float64())
    c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(c).all(axis=1)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[good]
    with np.errstate(over="ignore"):
        return at, np.clip(np.floor(SCALE * c[good]), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers, some rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            at, x = integers(part.column(1), dims)
            if len(at):
                yield part.column(0).take(pa.array(at)), x


@dataclass(frozen=True)
class Means:
    """How many rows there are, and the sums of each dimension, exact."""

    n: int
    sums: tuple[int, ...]

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the mean's whole part, and the sums' remainders."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return x - whole, np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.offsets(x)
        return y - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 over the dimensions of each row, exact."""
        y, rest = self.offsets(x)
        top = int(np.abs(y).max())
        if y.shape[1] * top * max(top, self.n) >= 2**62:
            y, rest = y.astype(object), rest.astype(object)
        squares, mixed, own = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist(), sum(int(r) ** 2 for r in rest)
        exact = (self.n**2 * a - 2 * self.n * b + own for a, b in zip(squares, mixed, strict=True))
        return [v if v < 2**63 else None for v in exact]


def summed(rows: DataFrame, dims: int) -> Means | None:
    """n and S, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in blocks(batches, dims):
            n += len(x)
            # In two halves, so that no task's sums overflow.
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = rows.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(exact("n"), exact("high"), exact("low")).collect()
    found.sort(key=lambda r: r["i"])
    return Means(int(found[0]["n"]), tuple((int(r["high"]) << 32) + int(r["low"]) for r in found)) if found else None


def by_dimension(rows: DataFrame, dims: int, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of add(integers) over all blocks of rows: a small matrix, summed by task and then by its rows."""
    height, width = shape
    names = [f"y{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for _, x in blocks(batches, dims):
            total += add(x)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(width))], names=["i", *names])

    found = rows.mapInArrow(run, ", ".join(["i long", *(f"{c} double" for c in names)])).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
    out = np.zeros(shape)
    for r in found:
        out[r["i"]] = [r[c] for c in names]
    return out


def covariance_product(rows: DataFrame, means: Means, w: np.ndarray) -> np.ndarray:
    """V·W, by a pass over the rows."""

    def add(x: np.ndarray) -> np.ndarray:
        z = means.centred(x)
        return z.T @ (z @ w)

    return by_dimension(rows, len(w), w.shape, add) / means.n


def variances(rows: DataFrame, means: Means) -> np.ndarray:
    """The diagonal of V."""
    dims = len(means.sums)
    return by_dimension(rows, dims, (dims, 1), lambda x: (means.centred(x) ** 2).sum(0)[:, None])[:, 0] / means.n


def _independent(w: np.ndarray, known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of w's columns beyond the span of known's, without those that add nothing."""
    size = np.linalg.norm(w, axis=0)
    w = w[:, size > 0] / size[size > 0]
    for _ in range(2):
        w = w - known @ (known.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        w = u[:, s > 1e-10]
    return w


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, count: int, *, guard: int = GUARD, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors, of the matrix that `product` multiplies by."""
    size, count = min(dims, count + guard), min(dims, count)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, size)))[0]
    ax, age = product(x), 0
    p = ap = np.empty((dims, 0))
    for _ in range(rounds):
        values, u = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, u = values[::-1], u[:, ::-1]
        x, ax = x @ u, ax @ u
        residuals = ax - x * values
        limits = np.maximum(TOLERANCE * np.abs(values), FLOOR * max(values[0], 0.0))[:count]
        met = (np.linalg.norm(residuals, axis=0)[:count] <= limits).all()
        if met and not age:
            return values[:count], x[:, :count]
        w = np.empty((dims, 0)) if met or age >= REFRESH else _independent(residuals, np.hstack([x, p]))
        if not w.shape[1]:
            # Multiplied anew: to certify, or because carried products add up errors or have nothing to add.
            basis = np.linalg.qr(np.hstack([x, p]))[0]
            images, age = product(basis), 0
            x, p, ax, ap = basis[:, :size], basis[:, size:], images[:, :size], images[:, size:]
            continue
        basis, images = np.hstack([x, w, p]), np.hstack([ax, product(w), ap])
        gram = basis.T @ images
        u = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :size]
        # The previous directions: the step without its part along the old iterates, beyond the new iterates.
        step = u.copy()
        step[:size] = 0
        step = _independent(step, u)
        x, ax, p, ap, age = basis @ u, images @ u, basis @ step, images @ step, age + 1
    raise RuntimeError(f"residuals not certified after {rounds} rounds")


@dataclass(frozen=True)
class Whitener:
    """A fitted transformation: whitened = (x - mean) projected on the components, over the roots of their eigenvalues."""

    dims: int
    means: Means
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.means.centred(x) @ self.vectors / np.sqrt(self.values)


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))


def fit(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Fits on all vectors; None if there is no direction with variance."""
    rows = _rows(df, key, vector)
    most = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").orderBy(F.desc("n"), "dims").first()
    means = summed(rows, most["dims"]) if most else None
    if means is None:
        return None
    dims, trace = most["dims"], variances(rows, means).sum()
    if trace <= 0:
        return None
    values, vectors = lobpcg(lambda w: covariance_product(rows, means, w), dims, components)
    kept = values > NO_VARIANCE * values[0]
    values, vectors = values[kept], vectors[:, kept]
    # Of the two signs the one that makes a vector's largest entry positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return Whitener(dims, means, values, vectors, values / trace)


def identity_error(df: DataFrame, fitted: Whitener, *, key: str = "vec_id", vector: str = "embedding") -> float:
    """The largest entry, without sign, of the whitened rows' covariance less the identity, by a pass over the rows."""
    k = len(fitted.values)

    def add(x: np.ndarray) -> np.ndarray:
        w = fitted.whitened(x)
        return np.vstack([w.T @ w, w.sum(0)])

    total = by_dimension(_rows(df, key, vector), fitted.dims, (k + 1, k), add) / fitted.means.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, fitted: Whitener | None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, deviation, whitened, explained: a row for each remaining row of df and component, in one pass."""
    rows = _rows(df, key, vector)
    long, double = T.LongType(), T.DoubleType()
    kinds = [("component", T.IntegerType()), ("deviation", long), ("whitened", double), ("explained", double)]
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *(T.StructField(c, t) for c, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        for keys, x in blocks(batches, fitted.dims):
            every = pa.array(np.repeat(np.arange(len(x)), k))
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            columns = [keys.take(every), numbers, pa.array(fitted.means.deviations(x), pa.int64()).take(every), pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(fitted.explained, len(x)))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema) if fitted else df.sparkSession.createDataFrame([], schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fitted = fit(vectors)
    n, error = (fitted.means.n, identity_error(vectors, fitted)) if fitted else (0, 0.0)
    out = whiten(vectors, fitted).withColumns({"n": F.lit(n).cast("long"), "identity_error": F.lit(error)})
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
