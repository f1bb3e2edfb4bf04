"""Leading eigenpairs from distributed products, and the PCA that is built on them."""

import numpy as np
import pytest

from preyscope.functions import blocks
from preyscope.operators import analytics


@pytest.mark.parametrize("spectrum", ["flat", "steep", "tied"])
def test_leading_eigenpairs(spectrum):
    rng = np.random.default_rng(2)
    n = 300
    values = {"flat": np.linspace(2, 1, n), "steep": 0.5 ** np.arange(n), "tied": np.r_[[5.0, 5.0, 3.0], np.ones(n - 3)]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    matrix = (q * values) @ q.T
    products = []
    found, vectors = blocks.leading(lambda x: products.append(x.shape[1]) or matrix @ x, n, 3)
    assert found == pytest.approx(values[:3], rel=1e-9)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-9 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-9) and max(products) <= 2 * 9


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DIRECT", 100)
    df = spark.range(1000).repartition(70)

    def add(total, batch):
        total += batch.column(0).to_numpy().sum()

    assert blocks.summed(df, add, (2, 3)).tolist() == [[499500.0] * 3] * 2


def wide(spark, n=150, preys=400, seed=4):
    rng = np.random.default_rng(seed)
    signal = np.exp(rng.standard_normal((preys, 3)) @ rng.standard_normal((3, n)) * 0.4 + 5 + 0.3 * rng.standard_normal((preys, n)))
    seen = rng.random((preys, n)) < rng.uniform(0.3, 1, preys)[:, None]
    rows = [(f"E{e:03}", f"P{p}", float(signal[p, e])) for p in range(preys) for e in range(n) if seen[p, e]]
    rows += [("E000", "flat", 1.0), ("elsewhere", "P1", 1e9)] + [(f"E{e:03}", "even", 7.0) for e in range(n)]
    design = spark.createDataFrame([(f"E{e:03}", f"B{e % 9}", "T") for e in range(n)], "experiment string, bait string, type string")
    return spark.createDataFrame(rows, "experiment string, prey string, value double").repartition(5), design, np.where(seen, signal, np.nan)


def test_sparse_pca_against_the_dense_grid(spark):
    inter, design, dense = wide(spark)
    dense = dense[(~np.isnan(dense)).sum(1) >= 75]
    dense = np.where(np.isnan(dense), np.nanmin(dense, 1, keepdims=True), dense)
    z = (dense - dense.mean(1, keepdims=True)) / dense.std(1, ddof=1, keepdims=True)
    grid = analytics.pca_matrix(inter, design).toPandas().pivot(index="prey", columns="experiment", values="z").sort_index(axis=1)
    assert np.sort(grid.to_numpy().ravel()) == pytest.approx(np.sort(z.ravel()), abs=1e-9)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    scores, shares = analytics.pca(inter, design, 4)
    got = np.array([list(r)[1:] for r in scores.orderBy("experiment").collect()])
    assert shares == pytest.approx((s**2 / (s**2).sum())[:4].tolist(), rel=1e-9)
    assert np.abs(got) == pytest.approx(np.abs(v[:4].T * s[:4]), abs=1e-6)
    assert all(got[np.abs(got[:, k]).argmax(), k] > 0 for k in range(4))


def test_products_go_by_parts_of_a_batch(spark, monkeypatch):
    inter, design, _ = wide(spark, 20, 60)
    n, _, rows = analytics.standardised_cells(inter, design)
    rows = rows.coalesce(1)
    q = np.random.default_rng(1).standard_normal((n, 2))
    whole = analytics.gram_product(rows, n, q)
    z = analytics.pca_matrix(inter, design).toPandas().pivot(index="prey", columns="experiment", values="z").sort_index(axis=1).to_numpy()
    assert whole == pytest.approx(z.T @ (z @ q), rel=1e-9)


def test_nothing_to_decompose(spark):
    inter, design, _ = wide(spark, 5, 4)
    assert analytics.pca(inter.where("false"), design)[0].collect() == []
    one = design.limit(1)
    assert analytics.pca(inter, one)[1] == [0.0, 0.0]
