"""The spectral-count model: generalised Poisson densities against top-L controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.stats import gp_log_pmf
from . import scoring

ETA_FLOOR, TRUE_FACTOR, TRUE_DISPERSION = 0.1, 5, 0.1


def control_parameters(inter: DataFrame, design: DataFrame, preys: DataFrame, n_controls: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """For each prey: eta (mean of the top L controls, zeros count, floored), lambda2 the whole mean of all controls and their
    values, from the largest; with its gene.

    Zeros add nothing to the sums, so only seen values are gathered; L is the number of controls or the argument.
    """
    keys = [*by]
    top = scoring.control_values(inter, design, by).groupBy(*keys, "prey").agg(F.sum("value").alias("all"), F.sort_array(F.collect_list(F.col("value").cast("double")), asc=False).alias("controls"))
    top = top.withColumn("top", F.slice("controls", 1, n_controls))
    every = preys.select("prey", "gene").crossJoin(F.broadcast(scoring.n_controls(design, by)))
    rows = every.join(top, [*keys, "prey"], "left").withColumn("l", F.least(F.col("n_ctrl"), F.lit(n_controls)))
    s = F.coalesce(F.aggregate("top", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    ss = F.coalesce(F.aggregate("top", F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0))
    rows = rows.withColumn("s", s).withColumn("ss", ss).withColumn("eta", F.greatest(F.lit(ETA_FLOOR), F.coalesce(F.col("s") / F.nullif("l", F.lit(0)), F.lit(0.0))))
    var = F.when(F.col("l") > 1, (F.col("ss") - F.col("s") * F.col("s") / F.nullif("l", F.lit(0))) / F.nullif(F.col("l") - 1, F.lit(0))).otherwise(0.0)
    rows = rows.withColumn("var", var)
    lam = F.when(F.col("var") > F.col("eta"), 1 - F.sqrt(F.col("eta") / F.col("var"))).otherwise(0.1)
    mean = F.floor(F.coalesce(F.col("all") / F.nullif("n_ctrl", F.lit(0)), F.lit(0.0)))
    return rows.select(*keys, "prey", "gene", "eta", lam.alias("lambda2"), mean.alias("ctrl_mean"), "controls")


def density_pairs(inter: DataFrame, design: DataFrame, preys: DataFrame, n_controls: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Pairs with eta, most, skip and cells, (experiment, y, lt, lf, z0, low) of each replicate;
    low is no more than one or the mean of the controls. Counts are cut to whole numbers."""
    mu = TRUE_FACTOR * F.col("eta")

    def cell(seen: Column) -> dict[str, Column]:
        y = F.coalesce(seen.cast("double"), F.lit(0.0))
        lt = gp_log_pmf(F.floor(F.least(y, mu)), mu, F.lit(TRUE_DISPERSION))
        lf = gp_log_pmf(F.floor(F.greatest(y, F.col("eta"))), F.col("eta"), F.col("lambda2"))
        return {"y": y, "lt": lt, "lf": lf, "z0": y > 2 * F.col("eta"), "low": (y <= 1) | (y <= F.col("ctrl_mean"))}

    rows = scoring.replicate_pairs(inter, design, control_parameters(inter, design, preys, n_controls, by), by, "inner", cell)
    return rows.withColumn("most", F.array_max("cells.y")).withColumn("skip", F.col("most") == 0)


def densities(inter: DataFrame, design: DataFrame, preys: DataFrame, n_controls: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Replicate cells with y (0 if missing), eta, lt, lf, z0 (first labels) and skip."""
    return scoring.replicates(density_pairs(inter, design, preys, n_controls, by).drop("controls")).drop("low")


def score(inter: DataFrame, design: DataFrame, preys: DataFrame, n_controls: int = 100, n_replicates: int = 100, by: Sequence[str] = (), rounds: int | None = None, digits: int = 2, rate: bool = True) -> DataFrame:
    """Scores of every (prey, bait) pair of inter(experiment, prey, value): densities, rounds, posterior, report."""
    keys, inter, design = [*by, "prey", "bait"], stored(inter), scoring.checked_design(design)
    pairs = stored(density_pairs(inter, design, preys, n_controls, by))
    return posterior(pairs, keys, n_replicates, by, rounds, digits, rate)


def posterior(pairs: DataFrame, keys: Sequence[str], n_replicates: int = 100, by: Sequence[str] = (), rounds: int | None = None, digits: int = 2, rate: bool = True) -> DataFrame:
    """score() of a written table of density_pairs()."""
    beta = scoring._per_group(scoring.settle_labels(scoring.label_cells(pairs, by), by, rounds), by)

    def cell(x: Column) -> Column:
        odds = beta + x["lt"] - x["lf"]
        none = x["low"] | (F.col("most") == 1)
        return F.struct(x["experiment"].alias("experiment"), x["y"].alias("y"), odds.alias("log_odds"), F.when(none, 0.0).otherwise(1 / (1 + F.exp(-odds))).alias("score"))

    fold = scoring.total(F.col("cells.y")) / F.size("cells") / F.col("eta")
    rows = pairs.select(*keys, fold.alias("fold_change"), "gene", "m", F.transform("cells", cell).alias("cells"), "controls")
    return scoring.report(rows, keys, n_replicates, digits, rate)
