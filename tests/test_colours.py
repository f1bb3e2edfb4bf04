"""Neighbour updates by colours against one prey after the other."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from preyscope.functions.lineage import Workspace, shared_folder
from preyscope.operators import network

from .test_models import fit_plain


def drawn(spark, seed, n=30, degree=4):
    rng = np.random.default_rng(seed)
    names = [f"P{k:02}" for k in range(n)]
    edges = sorted({tuple(sorted(rng.choice(names, 2, replace=False))) for _ in range(degree * n // 2)})
    cells = [(p, f"B{b}", f"E{b}{r}", float(rng.normal(-1.2, 1)), 0.0, bool(rng.random() < 0.4), False, 1.0) for p in names + ["alone"] for b in range(3) for r in range(2 + b)]
    df = spark.createDataFrame(cells, "prey string, bait string, experiment string, lt double, lf double, z0 boolean, skip boolean, y double").repartition(3)
    return edges, cells, spark.createDataFrame(edges, "a string, b string"), df


class Plain:
    """Labels by (prey, bait), updated one prey after the other, or all at once."""

    def __init__(self, edges, cells):
        self.cells, self.near = {}, {}
        for a, b in edges:
            self.near.setdefault(a, []).append(b)
            self.near.setdefault(b, []).append(a)
        for p, b, _, lt, lf, z, _, _ in cells:
            self.cells.setdefault((p, b), []).append((lt - lf, z))
        self.z = {k: np.mean([z for _, z in v]) for k, v in self.cells.items()}
        self.labels = {k: [z for _, z in v] for k, v in self.cells.items()}
        self.baits = sorted({b for _, b in self.cells})

    def support(self, p, b):
        return sum(self.z[q, b] for q in self.near.get(p, []))

    def update(self, order, beta, gamma):
        for group in order:
            new = {}
            for p in group:
                for b in self.baits:
                    new[p, b] = [beta + gamma * self.support(p, b) + d >= 0 for d, _ in self.cells[p, b]]
            self.labels |= new
            self.z |= {k: np.mean(v) for k, v in new.items()}

    def likelihood(self, beta, gamma):
        own = sum(z * (beta + d) for k, v in self.cells.items() for (d, _), z in zip(v, self.labels[k], strict=True))
        return own + gamma * sum(len(self.cells[p, b]) * self.z[p, b] * self.support(p, b) for p, b in self.cells) / 2


@pytest.mark.parametrize(("seed", "degree"), [(1, 3), (2, 8)])
def test_colours_and_labels(spark, seed, degree):
    edges, cells, edge, df = drawn(spark, seed, degree=degree)
    colours = {r.prey: r.colour for r in network.colour(edge.union(edge.select("b", "a")).union(edge)).collect()}
    assert set(colours) == {p for e in edges for p in e} and all(colours[a] != colours[b] for a, b in edges)
    assert sorted({*colours.values()}) == list(range(max(colours.values()) + 1)) and max(colours.values()) <= max(sum(p in e for e in edges) for p in colours)
    n = max(colours.values()) + 2
    tint = spark.createDataFrame([(p, colours.get(p, n - 1)) for p in sorted({c[0] for c in cells})], "prey string, colour int")
    plain, order = Plain(edges, cells), [[p for p in sorted({c[0] for c in cells}) if colours.get(p, n - 1) == c] for c in range(n)]
    one_by_one = [[p] for group in order for p in group]
    with Workspace(spark) as ws:
        tinted, both = df.join(tint, "prey"), edge.union(edge.select("b", "a")).join(tint.withColumnRenamed("prey", "a"), "a")
        means = [tinted.where(F.col("colour") == c).groupBy("prey", "bait").agg(F.avg(F.col("z0").cast("double")).alias("z"), F.lit(0.0).alias("support"), F.lit("").alias("neighbours")) for c in range(n)]
        before = plain.likelihood(0.1, 0.4)
        for _ in range(2):
            means = network.update_labels(ws, tinted, both, means, 0.1, 0.4)
            plain.update(one_by_one, 0.1, 0.4)
            assert plain.likelihood(0.1, 0.4) >= before - 1e-9
            before = plain.likelihood(0.1, 0.4)
            assert {(r.prey, r.bait): r.z for m in means for r in m.collect()} == pytest.approx(plain.z)
        folder = ws.folder.removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and os.path.isdir(shared_folder(spark).removeprefix("file:"))


def test_at_once_swings_and_by_colours_settles():
    cells = [("P1", "B", "E", -0.5, 0.0, True, False, 1.0), ("P2", "B", "E", -0.5, 0.0, False, False, 1.0)]
    swinging, settled = Plain([("P1", "P2")], cells), Plain([("P1", "P2")], cells)
    states = []
    for _ in range(4):
        swinging.update([["P1", "P2"]], 0.0, 1.0)
        states.append(tuple(swinging.z.values()))
    assert states == [(0, 1), (1, 0), (0, 1), (1, 0)]
    settled.update([["P1"], ["P2"]], 0.0, 1.0)
    first = dict(settled.z)
    settled.update([["P1"], ["P2"]], 0.0, 1.0)
    assert settled.z == first


def test_symmetric_scores(spark):
    edges, cells, edge, df = drawn(spark, 5)
    colours = {r.prey: r.colour for r in network.colour(edge).collect()}
    plain = Plain(edges, cells)
    order = [[p] for p in sorted({c[0] for c in cells}, key=lambda p: (colours.get(p, 99), p))]
    beta = gamma = 0.0
    last = {}
    for _ in range(3):
        for (p,) in order:
            last |= {(p, b): plain.support(p, b) for b in plain.baits}
            plain.update([[p]], beta, gamma)
        beta, gamma = fit_plain(np.array([plain.z[k] for k in last]), np.array([last[k] for k in last]))
    pairs = df.select("prey", "bait").distinct().withColumn("avg_p", F.lit(0.0))
    got = {(r.prey, r.bait): r.topo_avg_p for r in network.topology_scores(df, edge, pairs, rounds=3, symmetric=True).collect()}
    for (p, b), v in plain.cells.items():
        assert got[p, b] == pytest.approx(np.mean([1 / (1 + np.exp(-(beta + gamma * plain.support(p, b) + d))) for d, _ in v]), abs=2e-3)
    none = edge.where("false")
    assert network.topology_scores(df, none, pairs, rounds=1, symmetric=True).count() == len(got)
