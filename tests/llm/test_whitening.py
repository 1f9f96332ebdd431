"""Whitening: LOBPCG against a dense solver, exact deviations, odd vectors."""

import numpy as np
import pytest

from lakewright.llm import base
from lakewright.llm import whitening as wh

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def dense(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)) + 100_000
    z = x - x.mean(0)
    values, u = np.linalg.eigh(z.T @ z / len(z))
    values, u = values[::-1], u[:, ::-1]
    return z @ u[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize(("dims", "gap"), [(5, 0.5), (40, 0.9), (200, 0.97), (400, 0.995)])
def test_lobpcg_against_a_dense_solver(dims, gap):
    q = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]
    true = 1e4 * gap ** np.arange(dims)
    v = (q * true) @ q.T
    values, x = wh.lobpcg(lambda w: v @ w, dims, 8)
    k = min(8, dims)
    assert np.allclose(values, true[:k], rtol=1e-12) and np.abs(np.abs((q[:, :k] * x).sum(0)) - 1).max() < 1e-12
    assert np.linalg.norm(v @ x - x * values, axis=0).max() < 1e-7


def test_lobpcg_with_ties_and_without_rank():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))[0]
    true = np.array([9.0, 9, 9, 4, 4, 1] + [0] * 54)
    v = (q * true) @ q.T
    values, x = wh.lobpcg(lambda w: v @ w, 60, 8)
    assert np.allclose(values, true[:8], atol=1e-12) and np.allclose(x.T @ x, np.eye(8), atol=1e-12)
    assert np.allclose(wh.lobpcg(lambda w: 0 * w, 6, 8)[0], 0)


def test_only_a_fresh_product_certifies():
    """A product that is wrong once must not end in a wrong result."""
    v, calls = np.diag(np.arange(30.0, 0, -1)), []

    def product(w):
        calls.append(w.shape)
        return v @ w + (1e-4 if len(calls) == 2 else 0)

    values, _ = wh.lobpcg(product, 30, 4, guard=2)
    assert np.allclose(values, [30, 29, 28, 27], rtol=1e-12)


def test_deviations_are_exact():
    draw = np.random.default_rng(2)
    for top in (1000, 2**40):
        x = draw.integers(-top, top, (50, 7))
        means = wh.Means(len(x), tuple(int(s) for s in x.sum(0)))
        want = [sum((50 * int(a) - s) ** 2 for a, s in zip(row, means.sums, strict=True)) for row in x]
        assert means.deviations(x) == [v if v < 2**63 else None for v in want]


def test_query_on_the_table(spark, sf_dir):
    got = wh.op13_whitening(spark, sf_dir)
    assert got.columns == COLUMNS
    rows = got.toPandas().sort_values(["vec_id", "component"])
    raw = base.table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    kept = raw[[v is not None and all(c is not None and np.isfinite(c) for c in v) for v in raw["embedding"]]]
    want, explained = dense(kept["embedding"].tolist())
    assert rows["vec_id"].tolist() == np.repeat(kept["vec_id"], 8).tolist() and set(rows["n"]) == {len(kept)}
    assert np.allclose(np.abs(rows["whitened"].to_numpy().reshape(-1, 8)), np.abs(want), atol=1e-8)
    assert np.allclose(rows["explained"].to_numpy()[:8], explained, rtol=1e-9) and rows["identity_error"].max() < 1e-9


def vectors(spark, rows, extra="component string"):
    return spark.createDataFrame([(k, v, "clash") for k, v in rows], f"vec_id long, embedding array<double>, {extra}")


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    good = [(k % 17, v.tolist()) for k, v in enumerate(draw.standard_normal((60, 5)))] + [(None, [1e300, 0.0, -1e300, 2.0, 3.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    df = vectors(spark, good + bad + good[:5])
    fitted = wh.fit(df)
    out = wh.whiten(df, fitted).toPandas()
    assert fitted.means.n == 66 and len(out) == 66 * len(fitted.values) and set(out["component"]) <= set(range(1, 6))
    assert wh.identity_error(df, fitted) < 1e-4 and sorted(out["vec_id"].dropna().unique()) == list(range(17))
    assert np.isfinite(out["whitened"]).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(k, [1.0, 2.0, 3.0]) for k in range(9)]])
def test_nothing_to_whiten(spark, rows):
    df = vectors(spark, rows)
    assert wh.fit(df) is None and wh.whiten(df, None).count() == 0


def test_repeated_rows_and_blocks(spark, monkeypatch):
    base_rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(4).standard_normal((40, 12)))]
    once, thrice = wh.fit(vectors(spark, base_rows)), wh.fit(vectors(spark, base_rows * 3))
    assert np.allclose(once.values, thrice.values, rtol=1e-10) and np.allclose(once.vectors, thrice.vectors, atol=1e-8)
    monkeypatch.setattr(wh, "BLOCK", 7)
    assert np.allclose(wh.fit(vectors(spark, base_rows)).vectors, once.vectors, atol=1e-8)
