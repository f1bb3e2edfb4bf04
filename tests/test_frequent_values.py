"""Rates by value: frequent values are broadcast, so that none brings all its rows to one task."""

import math
import re

import pytest
from pyspark.sql import functions as F

from preyscope.functions import stats
from preyscope.operators import wd


def exchanges(df):
    df.collect()
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_rates_of_frequent_rare_and_null_values(spark, most):
    rows = [(i, 0.0 if i % 2 else None if i % 10 == 4 else float(i % 37)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(5)
    rates = df.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("rate", F.col("v") * 2)
    out = stats.with_rates(df, "v", rates, most).collect()
    assert sorted((r.i, r.v, r.rate) for r in out) == [(i, v, None if v is None else v * 2) for i, v in rows]


def test_error_rates_do_not_shuffle_rows_by_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") / 3000).alias("p"))
    for out in (stats.bh_adjust(df, "p", "q"), stats.tail_fdr(df, "p")):
        assert not {"p", "_p", "_v"} & {*exchanges(out)}


def test_wd_rows_move_by_prey_only(spark):
    rows = [(f"E{e}", r, f"P{e}", f"P{p}", float((e * 7 + p * 3 + r) % 11 + 1)) for e in range(6) for r in (1, 2, 2) for p in range(40) if (e + p) % 4]
    counts = spark.createDataFrame(rows, "experiment string, replicate int, bait string, prey string, count double")
    plan = wd.average_counts(counts)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan) == [re.search(r"prey#\d+", plan)[0]]
    assert not exchanges(wd.wd_scores(counts, iterations=50))


def test_entropy_of_present_replicates(spark):
    rows = [("E", 1, "B", "P", 3.0), ("E", 2, "B", "P", 1.0), ("E", 2, "A", "P", 4.0), ("E", 3, "B", "P", None), ("F", 1, "B", "P", None), ("F", 2, "B", "Q", 5.0)]
    out = {(r.experiment, r.prey): r for r in wd.average_counts(spark.createDataFrame(rows, "experiment string, replicate int, bait string, prey string, count double")).collect()}
    p = [3.5 / 8, 4.5 / 8]
    one = out["E", "P"]
    assert (one.bait, one.avg_count, one.n_saw) == ("A", 3.5, 2) and one.entropy == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert out["F", "P"].entropy == 0.0 and math.copysign(1, out["F", "Q"].entropy) == 1 and out["F", "Q"].entropy == 0.0
