"""The intensity model: clamped Gaussian densities of standardised log intensities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..functions.stats import normal_log_pdf_clamped, upper_median
from . import scoring

SHIFT_FLOOR, FIRST_LABEL = math.log(4), math.log(5)


def log_standardise(inter: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """value becomes (ln value - mean) / sample sd over all rows; columns mean_ln and sd_ln are added."""
    logged = inter.withColumn("value", F.when(F.col("value") > 0, F.log("value"))).where("value is not null")
    scale = logged.groupBy(*by).agg(F.avg("value").alias("mean_ln"), F.stddev_samp("value").alias("sd_ln"))
    return scoring._cross(logged, scale, by).withColumn("value", (F.col("value") - F.col("mean_ln")) / F.col("sd_ln"))


def _controls(std: DataFrame, design: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each prey with control values: n, mean, MLE sd and the values, from the largest; with the number of controls."""
    v = F.col("value")
    stats = scoring.control_values(std, design, by).groupBy(*by, "prey").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("mean"), F.stddev_pop(v).alias("sd"), F.sort_array(F.collect_list(v), asc=False).alias("controls"))
    return scoring._cross(stats, scoring.n_controls(design, by), by)


def default_missing_value(controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of all values of preys with a missing control."""
    return controls.groupBy(*by).agg((F.sum(F.when(F.col("n") < F.col("n_ctrl"), F.col("s"))) / F.nullif(F.sum(F.when(F.col("n") < F.col("n_ctrl"), F.col("n"))), F.lit(0))).alias("t0"))


def sd_line(controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regression of ln sd on mean over fully observed preys, and the floor: exp of the upper median of ln sd."""
    full = controls.where("n = n_ctrl and sd > 0").withColumn("ln_sd", F.log("sd"))
    line = full.groupBy(*by).agg(F.regr_slope("ln_sd", "mean").alias("slope"), F.regr_intercept("ln_sd", "mean").alias("intercept"))
    return scoring._cross(line, upper_median(full, "ln_sd", by), by).withColumn("floor", F.exp("median")).drop("median")


def parameters(std: DataFrame, design: DataFrame, preys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each prey: gene, t (missing value), eta, sd_false, d (true shift), sd_true and its control values.

    preys may have `imputed_mu` (linear scale): its standardised logarithm is the prey's missing value.
    """
    keys = [*by, "prey"]
    controls = stored(_controls(std, design, by))
    one = default_missing_value(controls, by)
    line = sd_line(controls, by)
    scale = std.groupBy(*by).agg(F.first("mean_ln").alias("mean_ln"), F.first("sd_ln").alias("sd_ln"))
    imputed = F.col("imputed_mu").cast("double") if "imputed_mu" in preys.columns else F.lit(None).cast("double")
    rows = scoring._cross(scoring._cross(preys.select("prey", "gene", imputed.alias("mu")).crossJoin(F.broadcast(one)), line, by), scale, by)
    own = F.when(F.col("mu") > 0, (F.log("mu") - F.col("mean_ln")) / F.col("sd_ln"))
    rows = rows.withColumn("t", F.coalesce(F.nullif(own, F.lit(0.0)), "t0")).join(controls.select(*keys, "n", "mean", "sd", "controls"), keys, "left")
    sd = F.when(F.coalesce("n", F.lit(0)) == 0, F.col("floor")).when(F.col("n") >= 3, F.col("sd")).otherwise(F.exp(F.col("mean") * F.col("slope") + F.col("intercept")))
    rows = stored(rows.withColumn("eta", F.coalesce("mean", "t")).withColumn("sd_false", F.greatest("floor", sd)))
    test = std.select(*by, "experiment", "prey", F.col("value").alias("y")).join(F.broadcast(design.where("type = 'T'").select(*by, "experiment", "bait")), [*by, "experiment"])
    test = test.join(rows.select(*keys, "gene", "eta"), keys).where(F.coalesce(F.col("gene") != F.col("bait"), F.lit(True)))
    shift = test.groupBy(*keys).agg(F.avg(F.when(F.col("y") > F.col("eta"), F.col("y"))).alias("up"), F.stddev_samp(F.when(F.col("y") > F.col("eta") + FIRST_LABEL, F.col("y"))).alias("spread"))
    rows = rows.join(shift, keys, "left").withColumn("d", F.greatest(F.lit(SHIFT_FLOOR), F.coalesce(F.col("up") - F.col("eta"), F.lit(0.0))))
    return rows.select(*keys, "gene", "t", "eta", "sd_false", "d", F.greatest("floor", F.coalesce("spread", "sd_false")).alias("sd_true"), "controls")


def density_pairs(std: DataFrame, design: DataFrame, preys: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Pairs of a written table of log_standardise() with the prey's parameters, skip and cells, (experiment, y, at, lt,
    lf, z0) of each replicate; missing y is taken at t. With `digits` controls are text, made once a prey."""
    top = F.col("eta") + F.col("d")

    def cell(y: Column) -> dict[str, Column]:
        at = F.coalesce(y, F.col("t"))
        lt, lf = normal_log_pdf_clamped(F.least(at, top), top, F.col("sd_true")), normal_log_pdf_clamped(F.greatest(at, F.col("eta")), F.col("eta"), F.col("sd_false"))
        return {"y": y, "at": at, "lt": lt, "lf": lf, "z0": F.coalesce(y > F.col("eta") + FIRST_LABEL, F.lit(False))}

    own = parameters(std, design, preys, by)
    if digits is not None:
        own = own.withColumn("controls", scoring.listed(F.transform("controls", F.exp), digits))
    rows = scoring.replicate_pairs(std.select(*by, "experiment", "prey", "value"), design, stored(own), by, "inner", cell)
    return rows.withColumn("skip", ~F.exists("cells.y", lambda y: y.isNotNull()))


def densities(inter: DataFrame, design: DataFrame, preys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Replicate cells with y (null: missing), the prey's parameters, lt, lf, z0 and skip; missing y is taken at t."""
    return scoring.replicates(density_pairs(stored(log_standardise(inter, by)), design, preys, by).drop("controls"))


def score(inter: DataFrame, design: DataFrame, preys: DataFrame, n_replicates: int = 100, by: Sequence[str] = (), rounds: int | None = None, digits: int = 3, rate: bool = True) -> DataFrame:
    """Scores of every (prey, bait) pair of inter(experiment, prey, value); preys(prey, gene[, imputed_mu])."""
    keys, std, design = [*by, "prey", "bait"], stored(log_standardise(stored(inter), by)), scoring.checked_design(design)
    pairs = stored(density_pairs(std, design, preys, by, digits))
    beta = scoring._per_group(scoring.settle_labels(scoring.label_cells(pairs, by), by, rounds), by)

    def cell(x: Column) -> Column:
        odds = beta + x["lt"] - x["lf"]
        return F.struct(x["experiment"].alias("experiment"), F.exp(x["y"]).alias("y"), odds.alias("log_odds"), F.when(x["y"].isNull(), 0.0).otherwise(1 / (1 + F.exp(-odds))).alias("score"))

    fold = scoring.total(F.transform("cells.at", F.exp)) / F.size("cells") / F.exp("eta")
    rows = pairs.select(*keys, fold.alias("fold_change"), "gene", F.exp("t").alias("imputed_value"), "m", F.transform("cells", cell).alias("cells"), "controls")
    return scoring.report(rows, keys, n_replicates, digits, rate)
