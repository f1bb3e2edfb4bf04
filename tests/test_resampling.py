"""Drawn p-values: the binomial inverse against a plain one, and draws against exact values."""

import math

import numpy as np
import pytest

from preyscope.operators import wd


@pytest.mark.parametrize("n", [1, 7, 400])
def test_binomial_inverse(n):
    rng = np.random.default_rng(n)
    chance = np.r_[0.0, 1.0, rng.choice([0.5, 1 / 30, 1e-9, 0.999], 50), rng.random(50)]
    uniform = np.r_[0.0, rng.random(101)]
    for p, u, got in zip(chance, uniform, wd.binomial_draws(n, chance, uniform), strict=True):
        total, k = 0.0, -1
        while total <= u and k < n:
            k += 1
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        assert abs(got - k) <= (abs(total - u) < 1e-9)


def table(spark):
    rng = np.random.default_rng(4)
    rows = [(f"P{p}", f"E{e}", 40, float(rng.integers(0, 9)) if rng.random() < 0.9 else None) for p in range(120) for e in range(40) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "prey string, experiment string, k int, wd double").repartition(3)


@pytest.mark.parametrize("iterations", [20, 300, 5000])
def test_draws_are_within_their_error(spark, iterations):
    df = table(spark)
    drawn = {(r.prey, r.experiment): r.p_value for r in wd.resampled_p(df, iterations).collect()}
    exact = {(r.prey, r.experiment): r.p_value for r in wd.permutation_p(df).collect()}
    assert drawn.keys() == exact.keys() and all((drawn[k] is None) == (p is None) for k, p in exact.items())
    z = np.array([(drawn[k] - p) / math.sqrt(p * (1 - p) / iterations) for k, p in exact.items() if p])
    assert all(drawn[k] == 0 for k, p in exact.items() if p == 0)
    assert abs(z.mean()) < 4 / math.sqrt(len(z)) and abs(z.std() - 1) < 0.1 and np.abs(z).max() < 6
    assert all(abs(drawn[k] * iterations - round(drawn[k] * iterations)) < 1e-9 for k, p in exact.items() if p is not None)


def test_reruns_agree_and_seeds_differ(spark):
    df = table(spark)
    runs = [{(r.prey, r.experiment): r.p_value for r in wd.resampled_p(d, 100, seed).collect()} for d, seed in ((df, 1), (df.repartition(7), 1), (df, 2))]
    assert runs[0] == runs[1] != runs[2]
    assert "collect_list" not in wd.resampled_p(df, 10)._jdf.queryExecution().optimizedPlan().toString()
