"""The spline's share of missing values against a plain regression over a cardinal natural-spline basis."""

import numpy as np
import pytest

from preyscope.functions import stats
from preyscope.operators import impute
from preyscope.plans import queries, views


def cardinal(x, knots):
    """Natural cubic splines that are one at a knot and zero at the others, by their second derivatives."""
    n, h = len(knots), np.diff(knots)
    bend, left = np.zeros((n, n)), np.eye(n)
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        bend[i, i - 1 : i + 2] = 1 / h[i - 1], -1 / h[i - 1] - 1 / h[i], 1 / h[i]
    second = np.linalg.solve(left, bend)
    j = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, n - 2)
    a, b = (knots[j + 1] - x) / h[j], (x - knots[j]) / h[j]
    eye = np.eye(n)
    return a[:, None] * eye[j] + b[:, None] * eye[j + 1] + ((a**3 - a) * h[j] ** 2 / 6)[:, None] * second[j] + ((b**3 - b) * h[j] ** 2 / 6)[:, None] * second[j + 1]


def plain(x, y, family, df=5):
    knots = np.unique(np.percentile(np.unique(x), np.linspace(0, 100, df)))
    b, top = cardinal(x, knots), cardinal(np.array([x.max()]), knots)[0]
    if family == "gaussian":
        return float(top @ np.linalg.lstsq(b, y, rcond=None)[0])
    y = np.clip(y, 1e-6, 1 - 1e-6)
    mu = (y + 0.5) / 2
    eta = np.log(mu / (1 - mu))
    for _ in range(200):
        mu = 1 / (1 + np.exp(-eta))
        w = np.sqrt(mu * (1 - mu))
        beta = np.linalg.lstsq(w[:, None] * b, w * (eta + (y - mu) / w**2), rcond=None)[0]
        eta = b @ beta
    return float(1 / (1 + np.exp(-top @ beta)))


@pytest.fixture
def shares(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 300), ("b", 80), ("few", 9), ("flat", 40), ("two", 40)):
        x = {"flat": np.full(n, 3.0), "two": rng.integers(0, 2, n) * 1.0}.get(g, rng.normal(20, 3, n))
        y = 1 / (1 + np.exp((x - 19) / 2)) + rng.normal(0, 0.15, n)
        if g == "b":
            x[:9] = x[9]
            y[20:30], y[30:35] = 1.5, -1.0
        rows += [(g, f"P{k}", float(np.clip(v, 0, 1)), float(u)) for k, (u, v) in enumerate(zip(x, y, strict=True))]
    rows.append(("a", "none", 1.0, None))
    return rows, spark.createDataFrame(rows, "bait string, prey string, missing double, mean_log2 double").repartition(3)


@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_both_families_by_group(shares, family):
    rows, df = shares
    found = impute.missingness_at_top(df, "bait", family=family)
    assert set(found) == {"a", "b", "two"}
    for g, share in found.items():
        x, y = (np.array([r[k] for r in rows if r[0] == g and r[3] is not None]) for k in (3, 2))
        assert share == pytest.approx(plain(x, y, family), abs=1e-6)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("x", 1), ("y", 2), ("z", 501)) for v in rng.integers(0, 60, n)] + [("z", None)]
    got = {r.g: r.quantiles for r in stats.quantiles_by(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", [0, 0.3, 0.5, 1]).collect()}
    for g in "xyz":
        assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g and v is not None], [0, 30, 50, 100]).tolist())


def test_methods_over_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    design, values = views.design(spark, folder), queries._values(spark, folder)
    rows = values.join(design.where("type = 'C'"), "experiment").select("bait", "prey", "value").toPandas()
    n = {r.bait: r["count"] for r in design.where("type = 'C'").groupBy("bait").count().collect()}
    share = {}
    for family in ("binomial", "gaussian"):
        for bait, own in rows.groupby("bait"):
            seen = own.groupby("prey").value.agg(lambda v: 1 - len(v) / n[bait])
            share[family, bait] = plain(own.groupby("prey").value.agg(lambda v: np.log2(v).mean()).to_numpy(), seen.to_numpy(), family)
            assert impute.estimate_pi(values, design, "single_bait", bait, family=family) == pytest.approx(share[family, bait], abs=1e-6)
    whole = sum(share["binomial", b] * k for b, k in n.items()) / sum(n.values())
    assert impute.estimate_pi(values, design) == pytest.approx(whole, abs=1e-6)
    assert queries.imputation_pi(spark, folder).first().pi == pytest.approx(whole, abs=1e-4)
    with pytest.raises(ValueError, match="no control bait"):
        impute.estimate_pi(values, design, "single_bait", "B1")
    with pytest.raises(ValueError, match="unknown method"):
        impute.estimate_pi(values, design, "mode")
    with pytest.raises(ValueError, match="enough replicates"):
        impute.estimate_pi(values, design, least_replicates=99)
