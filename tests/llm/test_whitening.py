"""Whitening against a dense eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from preyscope.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def plain(rows, components=4):
    """{vec_id: (n, deviation, projections, shares)} by a dense decomposition and exact fractions."""
    rows = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if usable(v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, float) - mean
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(k, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), (np.array(x, float) - mean) @ vectors / np.sqrt(values)) for k, x in rows]
    return out, values / np.trace(cov)


def held(df, rows, components=4):
    """df has the plain version's rows, up to one sign a component."""
    found = df.collect()
    expected, shares = plain(rows, components)
    assert len(found) == len(expected) * len(shares)
    for c, share in enumerate(shares, 1):
        own = sorted((r for r in found if r.component == c), key=lambda r: (r.vec_id is None, r.vec_id, r.whitened))
        sign = [s for s in (1, -1) if np.allclose([r.whitened for r in own], [w for _, w in sorted(((k is None, k), s * z[c - 1]) for k, _, _, z in expected)], rtol=0, atol=1e-9)]
        assert sign
        assert [(r.vec_id, r.n, r.deviation) for r in own] == [x[:3] for x in sorted(expected, key=lambda x: (x[0] is None, x[0], sign[0] * x[3][c - 1]))]
        assert all(abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-10 for r in own)


def drawn(seed=1, n=300, dim=40):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * np.linspace(1.3, 0.2, dim) + rng.standard_normal(dim)
    return [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA).repartition(parts)


def test_dirty_rows_copies_and_many_partitions(spark):
    rows = drawn()
    rows += [(400 + k, rows[7][1]) for k in range(200)] + [rows[3], (None, rows[4][1])]
    dirty = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [1.0] * 39 + [math.nan]), (904, [math.inf] + [1.0] * 39)]
    short = [(905, [1.0, 2.0])]
    held(whitening.whiten(frame(spark, rows + dirty + short, 70).selectExpr("*", "1 as x", "2 as n", "3 as component")), rows)


def test_filter_is_used_beyond_the_block(spark):
    rows = drawn(2, 500, 60)
    fit = whitening.Fit(whitening.integers(frame(spark, rows)).select("x").distinct(), 60, 4, guard=3, degree=6)
    assert fit.passes > 12 and fit.residuals.max() < 1e-12
    held(whitening.whiten(frame(spark, rows), guard=3, degree=6), rows)


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_few_dimensions(spark, dim):
    rows = drawn(dim, 50, dim)
    held(whitening.whiten(frame(spark, rows)), rows, min(4, dim))


def test_small_rank_and_empty_tables(spark):
    line = [(k, [float(k), 2.0 * k, 0.0, 1.0, 1.0, 1.0]) for k in range(20)]
    found = whitening.whiten(frame(spark, line)).collect()
    assert len(found) == 20 and {r.component for r in found} == {1} and all(abs(r.explained - 1) < 1e-12 for r in found)
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []


def test_equal_eigenvalues_give_some_basis(spark):
    dim = 36
    rows = [(2 * k + s, [(1.0 - 2 * s) * (j == k) for j in range(dim)]) for k in range(dim) for s in (0, 1)]
    found = whitening.whiten(frame(spark, rows), guard=2).collect()
    z = np.zeros((2 * dim, 4))
    for r in found:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(z.T @ z / (2 * dim), np.eye(4), atol=1e-9) and all(abs(r.explained - 1 / dim) < 1e-9 for r in found)


def test_very_large_entries(spark):
    rows = [(k, [3e38 if k == 0 else float(k), float(k % 3)]) for k in range(9)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) >= 9 and {r.deviation for r in found} == {None}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    held(queries.op13_whitening(spark, folder), rows)
