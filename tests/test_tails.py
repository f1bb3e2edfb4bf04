"""Tails against exact fractions and against plain integrals."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from preyscope.functions import stats, tails


def exact_tail(k, n, m, t):
    whole = math.comb(t, n)
    return float(Fraction(sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(max(k, 0, n + m - t), min(n, m) + 1)), whole))


def test_hypergeometric_tails_of_all_sizes():
    rng = np.random.default_rng(1)
    cases = [(0, 5, 3, 9), (6, 5, 9, 9), (4, 9, 4, 9), (2, 3, 0, 9), (1, 0, 3, 9), (3, 3, 9, 9), (1, 1, 1, 1)]
    for _ in range(400):
        t = int(rng.integers(1, 300))
        m, n = int(rng.integers(0, t + 1)), int(rng.integers(0, t + 1))
        cases.append((int(rng.integers(-1, n + 2)), n, m, t))
    cases += [(k, 900, 1_000_000, 5_000_000) for k in (1, 120, 170, 179, 180, 181, 200, 260, 400, 900)] + [(k, 700, 10**6, 10**9) for k in (1, 2, 5, 9)]
    got = tails.hypergeom_tail(*np.array(cases, float).T)
    for case, p in zip(cases, got, strict=True):
        assert p == pytest.approx(exact_tail(*case), rel=1e-10, abs=1e-300), case


def test_very_large_groups_end_soon():
    # About the middle of a very wide distribution: half by the normal limit, whose error is of the order of 1 / sd.
    n, m, t = 10.0**9, 10.0**9, 4 * 10.0**9
    sd = math.sqrt(n * (m / t) * (1 - m / t) * (t - n) / (t - 1))
    k = n * m / t + np.array([-3, -1, 0, 1, 3]) * sd
    got = tails.hypergeom_tail(np.ceil(k), *np.full((3, 5), [[n], [m], [t]]))
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in (-3, -1, 0, 1, 3)], abs=1e-4)


def plain_t(t, df):
    """Twice the upper tail, by Simpson's rule over the angle."""
    theta = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    y = np.cos(theta) ** (df - 1)
    h = theta[1] - theta[0]
    return 2 * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_t_tails_of_whole_and_fractional_freedom():
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 7.5, 23.2, 150, 1000.5) for t in (0.0, 1e-3, 0.5, -2.0, 6.0, 20.0)]
    got = tails.t_two_sided(*np.array(cases, float).T)
    for (t, df), p in zip(cases, got, strict=True):
        assert p == pytest.approx(plain_t(t, df), rel=1e-8, abs=1e-11), (t, df)
    below, above = (tails.t_two_sided(np.array([0.3, 2.0, 5.0]), np.full(3, df)) for df in (tails.NORMAL, tails.NORMAL * 1.001))
    assert below == pytest.approx(above, rel=1e-7)
    normal = tails.t_two_sided(np.array([0.3, 2.0, 5.0]), np.full(3, 1e12))
    assert normal == pytest.approx([math.erfc(x / math.sqrt(2)) for x in (0.3, 2.0, 5.0)], rel=1e-9)
    edge = tails.t_two_sided(np.array([math.nan, math.inf, 1.0]), np.array([3.0, 3.0, 0.0]))
    assert math.isnan(edge[0]) and edge[1] == 0 and math.isnan(edge[2])


def test_columns(spark):
    df = spark.createDataFrame([(3, 10, 20, 100, 2.5, 6), (1, 10, 20, 100, None, 6)], "k long, n long, m long, t long, x double, df long")
    rows = df.select(stats.hypergeom_tail(F.col("k"), F.col("n"), F.col("m"), F.col("t")).alias("p"), stats.t_two_sided(F.col("x"), F.col("df")).alias("q")).collect()
    assert [r.p for r in rows] == pytest.approx([exact_tail(3, 10, 20, 100), exact_tail(1, 10, 20, 100)])
    assert rows[0].q == pytest.approx(plain_t(2.5, 6)) and rows[1].q is None
