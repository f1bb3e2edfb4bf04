"""WD, Z and D scores of bait-prey counts, with permutation p-values, from the sparse table.

A missing (experiment, prey) cell is a zero; means and deviations over all K experiments follow from counts and sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.stats import bh_adjust, quantiles


def dedupe_replicates(counts: DataFrame) -> DataFrame:
    """(experiment, replicate, bait, prey, count): the largest count of each replicate cell, with its smallest bait id."""
    return counts.groupBy("prey", "experiment", "replicate").agg(F.min("bait").alias("bait"), F.max("count").alias("count"))


def average_counts(counts: DataFrame) -> DataFrame:
    """One row for each (experiment, prey): avg_count over present replicates, n_saw (replicates above 0), entropy.

    Entropy is in bits, of p = (x + 1/n) / (sum + 1) over the n replicates that are present. Rows move once, by prey, and
    are sorted once, by prey, experiment and replicate.
    """
    cells = dedupe_replicates(counts.repartition("prey"))
    w = Window.partitionBy("prey", "experiment")
    p = (F.col("count").cast("double") + 1 / F.count("count").over(w)) / (F.coalesce(F.sum(F.col("count").cast("double")).over(w), F.lit(0.0)) + 1)
    cells = cells.withColumn("_p", p)
    return cells.groupBy("prey", "experiment").agg(
        F.min("bait").alias("bait"), F.avg("count").alias("avg_count"), F.count_if(F.col("count") > 0).alias("n_saw"), F.coalesce(F.sum(0 - F.col("_p") * F.log2("_p")), F.lit(0.0)).alias("entropy")
    ).select("experiment", "prey", "bait", "avg_count", "n_saw", "entropy")


def prey_sums(cells: DataFrame) -> DataFrame:
    """cells with self and the sums over each prey's cells that its statistics are made of; one window by prey."""
    w = Window.partitionBy("prey")
    rows = cells.withColumn("self", F.coalesce(F.col("bait") == F.col("prey"), F.lit(False)))
    x, not_self = F.col("avg_count"), F.when(~F.col("self"), F.col("avg_count"))
    sums = {
        "_selves": F.sum(F.col("self").cast("int")), "_positive": F.sum((x > 0).cast("int")), "_seen": F.sum((F.col("n_saw") > 0).cast("int")),
        "_n": F.count(not_self), "_x": F.sum(not_self), "_xx": F.sum(not_self * not_self),
    }
    return rows.select("*", *[f.over(w).alias(name) for name, f in sums.items()])


def prey_statistics(cells: DataFrame) -> DataFrame:
    """cells with self, self_only, n_exp, prey_mean, prey_sd over the K experiments."""
    sums = stored(prey_sums(cells))
    k = sums.agg(F.countDistinct("experiment").alias("k"))
    x, total, squares = F.col("avg_count"), F.coalesce("_x", F.lit(0.0)), F.coalesce("_xx", F.lit(0.0))
    rows = sums.crossJoin(F.broadcast(k)).withColumn("self_only", F.col("_selves") == F.col("_positive"))
    rows = rows.withColumn("n_exp", F.when(F.col("self_only"), 1).otherwise(F.col("_seen")))
    rows = rows.withColumn("mean", F.when(F.col("self_only"), x / F.col("k")).otherwise(total / F.col("k")))
    # Squared errors: other cells x - mean, own cells none, absent cells mean.
    m, n = F.col("mean"), F.col("_n")
    sse = squares - 2 * m * total + n * m * m + (F.col("k") - n - F.col("_selves")) * m * m
    alone = F.pow(x - m, F.lit(2)) + m * m * F.col("k")
    rows = rows.withColumn("sse", F.when(F.col("self_only"), alone).otherwise(F.greatest(F.lit(0.0), sse)))
    sd = F.sqrt(F.col("sse") / F.nullif(F.col("k") - 1, F.lit(0)))
    rows = rows.withColumn("prey_sd", F.nullif(sd, F.lit(0.0))).withColumn("prey_mean", F.nullif(F.col("mean"), F.lit(0.0)))
    return rows.select(*[c for c in cells.columns], "k", "self", "self_only", "n_exp", "prey_sd", "prey_mean")


def z_score() -> Column:
    return (F.col("avg_count") - F.col("prey_mean")) / F.col("prey_sd")


def wd_score() -> Column:
    spread = F.col("prey_sd") / F.col("prey_mean") * (F.col("k") / F.col("n_exp"))
    return F.sqrt(F.col("avg_count") * F.pow(spread, F.col("n_saw")))


def quantile_normalise(df: DataFrame, score: str, quantile: float | None) -> DataFrame:
    """Scores divided by a quantile (interpolated) of the positive ones."""
    if not quantile:
        return df
    at = quantiles(df.where(F.col(score) > 0), {"_q": (score, quantile)})
    return df.crossJoin(F.broadcast(at)).withColumn(score, F.col(score) / F.col("_q")).drop("_q")


def _greater() -> Column:
    """How many of the prey's scores are greater; scores that agree in nine digits are ties, nulls are least."""
    return F.rank().over(Window.partitionBy("prey").orderBy(F.round("wd", 9).desc_nulls_last())) - 1


def permutation_p(df: DataFrame, nan_as_zero: bool = False) -> DataFrame:
    """p: the chance that a shuffle of the prey's cells over all K experiments puts a greater score here.

    Shuffling moves whole cells, so the expected share is (number of greater scores of the prey) / K: the limit of
    resampling, without resampling. A null score has a null p, or 0 on request.
    """
    return df.withColumn("p_value", F.when(F.col("wd").isNotNull(), _greater() / F.col("k")).otherwise(F.lit(0.0 if nan_as_zero else None).cast("double")))


#: Chances of one table of binomial sums are worked out for so many of its cells at once.
_TABLE = 1 << 21


def binomial_draws(n: int, chance: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """For each pair the least count whose cumulated binomial chance of n trials is above the uniform number."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(n + 1)
    out = np.zeros(len(chance), np.int64)
    order = np.argsort(chance, kind="stable")
    values, starts = np.unique(chance[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    step = max(1, _TABLE // (n + 1))
    for first in range(0, len(values), step):
        p = values[first : first + step, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = logs[n] - logs - logs[::-1] + np.where(i > 0, i * np.log(p), 0.0) + np.where(i < n, (n - i) * np.log1p(-p), 0.0)
        sums = np.cumsum(np.exp(terms), axis=1)
        for row, a, b in zip(sums, starts[first : first + step], ends[first : first + step], strict=True):
            at = order[a:b]
            out[at] = np.minimum(np.searchsorted(row, uniform[at], side="right"), n)
    return out


def resampled_p(df: DataFrame, iterations: int, seed: int = 1) -> DataFrame:
    """permutation_p() by `iterations` seeded shuffles: the share of them that put a greater score here.

    A shuffle puts each of the prey's K cells here with the same chance, so the number of shuffles with a greater score
    is binomial in the cell's exact p. That number is drawn itself, by the inverse of its distribution at a hash of seed,
    prey and experiment: no scores travel, the work is linear in cells, and a rerun agrees.
    """

    @F.pandas_udf("double")
    def share(greater: pd.Series, k: pd.Series, uniform: pd.Series) -> pd.Series:
        return pd.Series(binomial_draws(iterations, greater.to_numpy(float) / k.to_numpy(float), uniform.to_numpy(float)) / iterations)

    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("prey"), F.col("experiment")), 11) * F.lit(2.0**-53)
    rows = df.withColumn("_greater", _greater()).withColumn("_uniform", uniform)
    return rows.withColumn("p_value", F.when(F.col("wd").isNotNull(), share("_greater", "k", "_uniform"))).drop("_greater", "_uniform")


def wd_scores(counts: DataFrame, quantile: float | None = 0.98, iterations: int | None = None, seed: int = 1) -> DataFrame:
    """All scores of (experiment, replicate, bait, prey, count): entropy, z, wd (normalised), p_value, wd_fdr."""
    # Written, as a filter on wd would work out its nested formula anew in every place where it stands.
    rows = stored(prey_statistics(average_counts(counts)).withColumn("z", z_score()).withColumn("wd", wd_score()))
    rows = quantile_normalise(rows, "wd", quantile)
    rows = resampled_p(rows, iterations, seed) if iterations else permutation_p(rows)
    return bh_adjust(stored(rows), "p_value", "wd_fdr")


def d_scores(counts: DataFrame, by_counts: bool = True) -> DataFrame:
    """experiment, prey, d: sqrt((K / frequency) ^ replicates * total); frequency counts experiments of other baits."""
    total = F.sum("count") if by_counts else F.log2(1 + F.sum("count"))
    cells = counts.groupBy("experiment", "prey").agg(F.min("bait").alias("bait"), total.alias("total"), F.count_if(F.col("count") > 0).alias("reps"))
    k = cells.agg(F.countDistinct("experiment").alias("k"))
    other = (F.col("total") > 0) & ~F.coalesce(F.col("bait") == F.col("prey"), F.lit(False))
    frequency = F.sum(other.cast("int")).over(Window.partitionBy("prey"))
    rows = cells.crossJoin(F.broadcast(k)).withColumn("frequency", frequency)
    return rows.select("experiment", "prey", "total", "frequency", F.sqrt(F.pow(F.col("k") / F.greatest(F.lit(1), "frequency"), F.col("reps")) * F.col("total")).alias("d"))
