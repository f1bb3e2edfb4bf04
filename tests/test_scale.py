"""What keeps the work of large tables in bounds: pairs in rows, tasks that grow, pairs counted once."""

import math

import numpy as np
import pandas as pd

from preyscope.functions import lineage, tails
from preyscope.operators import impute, network, scoring
from preyscope.plans import views


def test_a_pair_is_a_row_with_all_its_replicates(spark):
    design = spark.createDataFrame([("e1", "A", "T"), ("e2", "A", "T"), ("e3", "B", "T"), ("c1", "C", "C")], "experiment string, bait string, type string")
    preys = spark.createDataFrame([("p", "g"), ("q", "A")], "prey string, gene string")
    inter = spark.createDataFrame([("e1", "p", 3.0), ("e3", "p", 2.0), ("e2", "q", 9.0), ("c1", "p", 1.0)], "experiment string, prey string, value double")
    found = {(r.prey, r.bait): (r.m, {c.experiment: c.y for c in r.cells}) for r in scoring.replicate_pairs(inter, design, preys).collect()}
    assert found == {("p", "A"): (2, {"e1": 3.0, "e2": None}), ("p", "B"): (1, {"e3": 2.0}), ("q", "A"): (2, {"e1": None, "e2": None})}
    plan = scoring.replicate_cells(inter, design, preys)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(experiment") == 0


def test_tasks_grow_with_a_table(spark, monkeypatch):
    table = spark.range(1000)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lineage.tasks_of(table) == least
    monkeypatch.setattr(lineage, "ROWS_OF_A_TASK", 10)
    assert lineage.tasks_of(table) == max(least, 101)
    edges = spark.createDataFrame([("q", "p"), ("p", "q"), ("p", "r"), ("p", "p"), ("p", "x")], "a string, b string")
    preys = spark.createDataFrame([("p",), ("q",), ("r",)], "prey string")
    assert sorted(map(tuple, network.edges_from_pairs(edges, preys).collect())) == [("p", "q"), ("p", "r")]


def test_known_pairs_of_some_ids_are_those_of_all(spark):
    sf = "/root/testdata/sf0.001"
    ids = views.design(spark, sf).select("bait_id")
    every = views.known(spark, sf)
    some = every.join(ids.distinct().withColumnRenamed("bait_id", "pb"), "pb", "left_semi")
    of = views.known_of(spark, sf, ids.withColumnRenamed("bait_id", "pb"))
    assert sorted(map(tuple, of.select("pa", "pb", "n").collect())) == sorted(map(tuple, some.select("pa", "pb", "n").collect()))
    assert views.known_once(spark, sf).count() * 2 == every.count() == every.select("pa", "pb").distinct().count()


def test_error_function_of_arrays():
    x = np.concatenate([np.linspace(-7, 7, 5001), [0.46875, -0.46875, 4.0, np.inf, -np.inf]])
    assert np.abs(tails.erf(x) - [math.erf(v) for v in x]).max() < 5e-16
    assert np.isnan(tails.erf(np.array([np.nan]))).all()


def test_prior_value_is_its_formula():
    p = pd.DataFrame({"n_zero": [2, 0], "tlim": [1.0, 1.5], "obs_mu": [2.0, 2.5], "obs_sigma": [0.5, 0.7], "n_obs": [3, 1], "ys": [[1.5, 2.0, 2.5], [2.5]]})
    mu, sigma = np.array([[1.9, 30.0], [2.4, 2.6]]), np.array([[0.4, 0.5], [0.6, 0.3]])
    density = lambda x, m, s: math.exp(-((x - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    for r, row in p.iterrows():
        for k in range(2):
            m, s = mu[r, k], sigma[r, k]
            want = row.n_zero * math.log10(0.5 * (1 + math.erf((row.tlim - m) / s / math.sqrt(2))) + 1e-6) + math.log10(density(m, row.obs_mu, row.obs_sigma / math.sqrt(row.n_obs)) + 1e-6)
            want += sum(math.log10(density(y, m, s) + 1e-6) for y in row.ys)
            assert abs(impute.prior_value(p)(mu, sigma)[r, k] - want) < 1e-12
