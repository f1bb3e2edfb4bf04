"""The prior's likelihood over ragged lists of values."""

import math

import numpy as np
import pandas as pd
import pytest

from preyscope.operators import impute


def plain(p, mu, sigma):
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    density = lambda x, m, s: math.exp(-((x - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    own = sum(math.log10(density(y, mu, sigma) + 1e-6) for y in p.ys)
    return own + p.n_zero * math.log10(phi((p.tlim - mu) / sigma) + 1e-6) + math.log10(density(mu, p.obs_mu, p.obs_sigma / math.sqrt(p.n_obs)) + 1e-6)


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_values_of_very_different_numbers(monkeypatch, at_once):
    monkeypatch.setattr(impute, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    ys = [rng.normal(6, 1, n) for n in (1, 400, 2, 7, 1)]
    p = pd.DataFrame({"ys": ys, "n_zero": [3, 0, 9, 1, 0], "tlim": [y.min() for y in ys], "obs_mu": [y.mean() for y in ys], "obs_sigma": [y.std() or 0.5 for y in ys], "n_obs": [len(y) for y in ys]})
    mu, sigma = rng.normal(6, 1, (5, 9)), rng.uniform(0.3, 2, (5, 9))
    got = impute.prior_value(p)(mu, sigma)
    expected = [[plain(p.iloc[i], mu[i, j], sigma[i, j]) for j in range(9)] for i in range(5)]
    assert got == pytest.approx(np.array(expected), rel=1e-9)
    assert impute.prior_value(p)(mu[:, :1], sigma[:, :1]) == pytest.approx(np.array(expected)[:, :1], rel=1e-9)
