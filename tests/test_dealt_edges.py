"""Topology scores over dealt pairs and edges: cells in any form, many baits, keys that repeat or are null."""

import random

import pytest
from pyspark.sql import functions as F

from preyscope.functions.lineage import Workspace
from preyscope.operators import network

from .test_models import plain_topology

FLAT = "prey string, bait string, experiment string, lt double, lf double, z0 boolean, skip boolean, y double"


def drawn(n_preys, n_baits, seed):
    rng = random.Random(seed)
    cells, edges = {}, []
    for p in range(n_preys):
        for b in range(n_baits):
            if rng.random() < 0.6:
                skip = rng.random() < 0.1
                for e in range(rng.choice([2, 3])):
                    cells[f"P{p}", f"B{b}", f"E{e}"] = {"lt": -rng.uniform(0, 6), "lf": -rng.uniform(0, 6), "z0": rng.random() < 0.5, "skip": skip, "y": 0.0 if skip else float(rng.choice([0, 1, 5]))}
    for a in range(n_preys):
        for b in range(a + 1, n_preys):
            if rng.random() < 0.2:
                edges.append((f"P{a}", f"P{b}"))
    return cells, edges


def flat(spark, cells):
    return spark.createDataFrame([(*k, c["lt"], c["lf"], c["z0"], c["skip"], c["y"]) for k, c in cells.items()], FLAT)


def scored(df, edge, rounds):
    pairs = df.select("prey", "bait").distinct().withColumn("avg_p", F.lit(0.0))
    return {(r.prey, r.bait): (r.topo_avg_p, r.score, r.boosted_by) for r in network.topology_scores(df, edge, pairs, rounds=rounds).collect()}


def test_more_baits_than_a_block_against_a_plain_version(spark):
    cells, edges = drawn(15, 2 * network.BLOCK + 3, 1)
    got = scored(flat(spark, cells), spark.createDataFrame(edges, "a string, b string"), 3)
    plain = plain_topology(cells, edges, 3)
    assert got.keys() == plain.keys()
    assert all(got[k][0] == pytest.approx(plain[k], abs=2e-2) for k in plain)


def test_an_array_a_pair_gives_what_a_row_a_replicate_gives(spark):
    cells, edges = drawn(12, 10, 2)
    edge, df = spark.createDataFrame(edges, "a string, b string"), flat(spark, cells)
    listed = df.groupBy("prey", "bait", "skip").agg(F.collect_list(F.struct("experiment", "y", "lt", "lf", "z0")).alias("cells"))
    one, two = scored(df, edge, 2), scored(listed, edge, 2)
    assert one.keys() == two.keys() and all(one[k][0] == pytest.approx(two[k][0]) and one[k][2] == two[k][2] for k in one)
    assert any(names for *_, names in one.values())


def test_keys_that_repeat_or_are_null(spark):
    cells, edges = drawn(8, 3, 3)
    edge, df = spark.createDataFrame(edges, "a string, b string"), flat(spark, cells)
    odd = spark.createDataFrame([(None, "B0", "E0", 0.0, -1.0, True, False, 1.0), ("P0", None, "E0", 0.0, -1.0, True, False, 1.0)], FLAT)
    pairs = df.select("prey", "bait").distinct().withColumn("avg_p", F.lit(0.25)).unionByName(odd.select("prey", "bait", F.lit(0.25).alias("avg_p")))
    out = network.topology_scores(df.union(df).union(odd), edge, pairs, rounds=2).collect()
    assert len(out) == pairs.count()
    assert all(r.topo_avg_p is None and r.boosted_by is None and r.score == 0.25 for r in out if r.prey is None or r.bait is None)
    assert all(r.topo_avg_p is not None for r in out if r.prey and r.bait)


def test_without_rounds_or_edges(spark):
    cells, edges = drawn(6, 2, 4)
    df, edge = flat(spark, cells), spark.createDataFrame(edges, "a string, b string")
    assert {names for *_, names in scored(df, edge, 0).values()} == {None}
    assert {names for *_, names in scored(df, edge.where("false"), 2).values()} == {None}


def test_a_round_does_not_move_edges(spark):
    with Workspace(spark) as ws:
        edges = ws.deal(spark.range(100).select(F.concat(F.lit("P"), "id").alias("a"), F.concat(F.lit("P"), F.col("id") + 1).alias("b")), 8, "b")
        means = ws.keep(spark.range(100).select(F.concat(F.lit("P"), "id").alias("prey"), F.lit(0).cast("long").alias("block"), F.lit(1).alias("place"), F.lit(1.0).alias("z")))
        near = network._gathered(means, edges, 8, False)
        plan = near._jdf.queryExecution().executedPlan().toString()
        # Labels to their edges, and what the edges bring.
        assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
        assert near.count() == 99 and near.agg(F.sum("s1")).first()[0] == 99
        names = [r.tableName for r in spark.sql("show tables").collect()]
    assert any(n.startswith("dealt_") for n in names)
    assert not any(r.tableName.startswith("dealt_") for r in spark.sql("show tables").collect())


def test_edges_move_once_by_each_end(spark):
    pairs = spark.createDataFrame([("P2", "P1"), ("P1", "P2"), ("P1", "P1"), ("P1", "X"), ("P3", "P2"), (None, "P1")], "a string, b string")
    preys = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P3",), (None,)], "prey string")
    out = network.edges_from_pairs(pairs, preys)
    # One shuffle of the pairs and one of the preys for each end; telling pairs apart needs none.
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    assert sorted(map(tuple, out.collect())) == [("P1", "P2"), ("P2", "P3")]
