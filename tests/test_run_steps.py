"""Steps of the whole run: rows move once where they can, and nothing is worked out that is dropped."""

import math
import re

import pytest
from pyspark.sql import functions as F

from preyscope.functions import stats
from preyscope.operators import annotate, ingest, score_intensity, scoring
from preyscope.plans import pipeline, views

DESIGN = [(f"{t}{b}_{r}", t, f"{t}{b}", f"{t}{b}", r, g) for t, b, g in (("T", 1, "1"), ("T", 2, "2"), ("C", 3, "*"), ("C", 4, "1")) for r in (1, 2, 3)]


@pytest.fixture(scope="module")
def tables(spark):
    design = spark.createDataFrame(DESIGN, "experiment string, type string, bait string, bait_id string, replicate int, grp string")
    rows = [(e[0], f"P{p}", float((p * 37 + i * 11) % 53 + 1) * (9 if p % 3 and e[1] == "T" else 1)) for i, e in enumerate(DESIGN) for p in range(30) if p < 8 or (p + i) % 4]
    preys = spark.createDataFrame([(f"P{p}", f"G{p}") for p in range(30)], "prey string, gene string")
    return design, spark.createDataFrame(rows, "experiment string, prey string, value double"), preys


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(prey")


def test_preys_of_controls_alone_go_in_one_shuffle(spark, tables):
    design = tables[0].select("experiment", "type", "replicate").union(tables[0].where("bait = 'T1'").select("experiment", "type", "replicate"))
    rows = [("T1_1", "A", 1.0), ("C3_1", "A", 2.0), ("C3_1", "B", 5.0), ("T2_1", "C", 0.0), ("T2_2", None, 3.0), ("X", "D", 4.0), ("X", "A", 6.0)]
    inter = spark.createDataFrame(rows, "experiment string, prey string, value double")
    out = ingest.drop_control_only(inter, design)
    assert shuffles(out) == 1
    assert out.columns == inter.columns and sorted(map(tuple, out.collect())) == [("C3_1", "A", 2.0), ("T1_1", "A", 1.0), ("X", "A", 6.0)]


def test_rates_of_groups_are_worked_out_once(spark, tables, monkeypatch):
    design, inter, preys = tables

    def fails(*_):
        raise AssertionError("error rates of groups are dropped")

    monkeypatch.setattr(scoring, "tail_fdr", fails)
    out = pipeline.score(inter, design, preys).collect()
    assert {r.source_group for r in out} == {1, 2} and all(0 <= r.bfdr <= 1 for r in out)


def test_control_lists_are_text_once_a_prey(spark, tables):
    design, inter, preys = tables
    rows = {(r.prey, r.bait): r for r in score_intensity.score(inter, design, preys, digits=2).collect()}
    controls = {}
    for r in inter.join(design.where("type = 'C'"), "experiment").collect():
        controls.setdefault(r.prey, []).append(r.value)
    scale = score_intensity.log_standardise(inter).first()
    shown = lambda v: [math.exp((math.log(x) - scale.mean_ln) / scale.sd_ln) for x in sorted(v, reverse=True)]
    for (prey, _), r in rows.items():
        assert [float(x) for x in r.ctrl_values.split("|")] == pytest.approx(shown(controls[prey]), abs=0.0051)
    std = score_intensity.log_standardise(inter).cache()
    assert dict(score_intensity.density_pairs(std, design, preys, digits=2).dtypes)["controls"] == "string"


def test_known_pairs_of_other_baits_are_not_shuffled(spark):
    df = spark.createDataFrame([("A", "P1"), ("B", "P1"), ("C", None)], "first_id string, bait_id string")
    known = spark.createDataFrame([("A", "P1", True), ("B", "P2", True), ("C", "P9", False)], "a string, b string, multivalidated boolean")
    ids = df.select("bait_id").distinct()
    out = annotate.join_known(df, known, ids)
    assert sorted(map(tuple, out.select("first_id", "is_known", "multivalidated").collect())) == [("A", True, True), ("B", False, False), ("C", False, False)]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_known_pairs_of_ids_shuffle_no_lines_by_order(spark):
    sf = "/root/testdata/sf0.001"
    ids = spark.createDataFrame([("P1",), ("P7",), (None,)], "pb string")
    out = views.known_of(spark, sf, ids)
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L?, \d+\)", out._jdf.queryExecution().executedPlan().toString())
    every = views.known(spark, sf).where("pb in ('P1', 'P7')")
    assert out.count() > 0 and sorted(map(tuple, out.select("pa", "pb", "n").collect())) == sorted(map(tuple, every.select("pa", "pb", "n").collect()))


def test_interactions_without_bait_are_one_experiment(spark, tmp_path):
    rows = [(None, 1, 5, 1.0, 2.0), (None, 2, 5, 2.0, 3.0), (7, None, 5, 4.0, 5.0), (7, 3, 5, 8.0, 9.0), (17, 6, 5, 1.0, 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = views.interactions(spark, str(tmp_path)).collect()
    assert sorted((str(r.experiment), str(r.bait), r.prey, r.spc, r.intensity) for r in out) == [("E7_1", "B7", "P5", 9.0, 10.0), ("None", "B7", "P5", 4.0, 5.0), ("None", "None", "P5", 3.0, 5.0)]


def test_frequent_scores_have_the_rate_of_all_greater_ones(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 100, 0.5).when(F.col("id") < 400, 0.25).alias("p"))
    out = {r.id: r.bfdr for r in stats.tail_fdr(df, "p").collect()}
    assert {out[0], out[99]} == {0.0} and {out[100], out[399]} == {0.5} and out[450] == pytest.approx(1 - (50 + 75) / 400)
