"""Missing intensities from censored log-normal fits by prey."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..functions.stats import quantiles, quantiles_by
from ..functions.tails import erf

#: Values times candidates of a fit that are worked out at once.
AT_ONCE = 1 << 18

MODES = {"prior": (3, "stddev_pop", 0.95, 0.05, 2), "mixture": (5, "stddev_samp", 0.99, 0.01, 3), "one": (5, "stddev_samp", 0.99, 0.01, 3)}

def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def exclude_self(inter: DataFrame, design: DataFrame) -> DataFrame:
    """Rows whose prey is not the bait's own protein; baits without an id keep all rows."""
    ids = design.select("experiment", "bait_id")
    return inter.join(F.broadcast(ids), "experiment").where(~F.col("bait_id").eqNullSafe(F.col("prey"))).drop("bait_id")


def limits(inter: DataFrame, mode: str = "mixture") -> DataFrame:
    """One row: upper_tlim, mu_low, mu_high, sigma_floor over positive values.

    upper_tlim is log10 of the 95th percentile of the preys' smallest values; mu lies between log10 of the least value
    minus 3 or 5 deviations and log10 of a percentile of the preys' means; sigma_floor is a low percentile of the preys'
    deviations. Percentiles are exact and interpolated.
    """
    span, sd, high, low, _ = MODES[mode]
    y = inter.where("value > 0").withColumn("y", F.log10("value"))
    every = y.agg(F.min("y").alias("least"), getattr(F, sd)("y").alias("sd"))
    by_prey = y.groupBy("prey").agg(F.min("value").alias("lo"), F.avg("value").alias("mean"), F.stddev_samp("y").alias("sd_y"))
    tops = quantiles(cut(by_prey), {"upper": ("lo", 0.95), "high": ("mean", high), "sigma_floor": ("sd_y", low)})
    rows = tops.crossJoin(F.broadcast(every))
    return rows.select(F.log10("upper").alias("upper_tlim"), (F.col("least") - span * F.col("sd")).alias("mu_low"), F.log10("high").alias("mu_high"), "sigma_floor")


def censor_stats(inter: DataFrame, n_experiments: Column, bounds: DataFrame, mode: str = "mixture", values: bool = False) -> DataFrame:
    """For each prey: n_obs, n_zero, sums of y = log10 value and y^2, tlim, the start (mu0, sigma0) and sigma_high."""
    factor = MODES[mode][4]
    y = inter.where("value > 0").withColumn("y", F.log10("value"))
    more = [F.sort_array(F.collect_list("y")).alias("ys")] * values
    stats = y.groupBy("prey").agg(F.count("y").alias("n_obs"), F.sum("y").alias("sum_y"), F.sum(F.col("y") * F.col("y")).alias("sum_yy"), F.min("y").alias("low"), F.avg("y").alias("obs_mu"), F.stddev_pop("y").alias("sd"), *more)
    rows = stats.crossJoin(F.broadcast(bounds)).withColumn("obs_sigma", F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.5).otherwise(F.col("sd")))
    rows = rows.withColumn("n_zero", n_experiments - F.col("n_obs")).withColumn("tlim", F.least("low", "upper_tlim"))
    rows = rows.withColumn("sigma_high", factor * F.col("sigma_floor") + factor * F.col("obs_sigma"))
    rows = rows.withColumn("mu0", F.greatest("mu_low", F.least("mu_high", "obs_mu"))).withColumn("sigma0", F.greatest("sigma_floor", F.least("sigma_high", "obs_sigma")))
    return rows.drop("low", "sd")


def _search(value: Callable[[np.ndarray, np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Maxima of value(mu, sigma) within boxes, for all rows at once: grids about the best point, each half as wide."""
    best, width = start.copy(), (high - low) / 2
    top = value(best[:, :1], best[:, 1:])[:, 0]
    steps = np.linspace(-1, 1, 9)
    centre = (low + high) / 2
    for k in range(26):
        at = centre if k == 0 else best
        mu = np.clip(at[:, :1] + width[:, :1] * steps, low[:, :1], high[:, :1])
        sigma = np.clip(at[:, 1:] + width[:, 1:] * steps, low[:, 1:], high[:, 1:])
        m, s = np.repeat(mu, 9, 1), np.tile(sigma, (1, 9))
        v = np.nan_to_num(value(m, s), nan=-np.inf)
        pick = v.argmax(1)
        rows = np.arange(len(pick))
        better = v[rows, pick] > top
        best[better] = np.stack([m[rows, pick], s[rows, pick]], 1)[better]
        top = np.maximum(top, v[rows, pick])
        if k:
            width *= 0.6
    return best


def _fit(stats: DataFrame, value: Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """stats with mu and sigma that maximise value, in Arrow batches of one compact row a prey.

    All columns pass through the function, so stats are read once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                low, high = p[["mu_low", "sigma_floor"]].to_numpy(float), p[["mu_high", "sigma_high"]].to_numpy(float)
                best = _search(value(p), low, np.maximum(low, high), p[["mu0", "sigma0"]].to_numpy(float))
                yield p.assign(mu=best[:, 0], sigma=best[:, 1])

    schema = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes)
    return stats.mapInPandas(run, f"{schema}, mu double, sigma double")


def _column(p: pd.DataFrame, name: str) -> np.ndarray:
    return p[name].to_numpy(float)[:, None]


def mixture_value(p: pd.DataFrame, pi: float, floor: float = 0.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """n ln(1/sigma) - sum (y - mu)^2 / 2 sigma^2 + n_zero ln(pi + (1 - pi) Phi((tlim - mu) / sigma))."""
    n, zero, s, ss, t = (_column(p, c) for c in ("n_obs", "n_zero", "sum_y", "sum_yy", "tlim"))

    def value(mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            missing = np.log(np.maximum(pi + (1 - pi) * np.maximum(_phi((t - mu) / sigma), floor), 1e-300))
        return -n * np.log(sigma) - (ss - 2 * mu * s + n * mu * mu) / (2 * sigma * sigma) + np.where(zero > 0, zero * missing, 0.0)

    return value


def prior_value(p: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sum of log10(density + 1e-6) of the values, of log10(Phi + 1e-6) of the zeros, and of a normal prior for mu."""
    zero, t, om, osd, n = (_column(p, c) for c in ("n_zero", "tlim", "obs_mu", "obs_sigma", "n_obs"))
    # All preys' values one after the other, and where each prey's begin.
    sizes = np.array([len(y) for y in p.ys])
    flat = np.concatenate([np.asarray(y, float) for y in p.ys])
    starts = np.cumsum(sizes) - sizes
    step, ln10, root = max(1, AT_ONCE // max(1, len(flat))), math.log(10), math.sqrt(2 * math.pi)

    def density(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        return np.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))

    def value(mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        out = zero * np.log10(_phi((t - mu) / sigma) + 1e-6) + np.log10(density(mu, om, osd / np.sqrt(n)) + 1e-6)
        # A few candidates at a time, each beside every value: memory follows the values, whatever the longest prey has.
        for k in range(0, mu.shape[1], step):
            m, s = mu[:, k : k + step], sigma[:, k : k + step]
            rows = flat[:, None] - np.repeat(m, sizes, axis=0)
            rows *= rows
            rows *= np.repeat(-0.5 / (s * s), sizes, axis=0)
            np.exp(rows, out=rows)
            rows *= np.repeat(1 / (s * root), sizes, axis=0)
            rows += 1e-6
            # The natural logarithm is the quicker one of numpy.
            out[:, k : k + step] += np.add.reduceat(np.log(rows, out=rows), starts, axis=0) / ln10
        return out

    return value


def fit(stats: DataFrame, mode: str = "mixture", pi: float = 0.0) -> DataFrame:
    """stats with the maximum-likelihood mu and sigma: modes prior (needs ys), mixture (with pi) and one (pi 0)."""
    if mode == "prior":
        return _fit(stats, prior_value)
    return _fit(stats, lambda p: mixture_value(p, pi if mode == "mixture" else 0.0, 1e-12 if mode == "one" else 0.0))


def reject_outliers(fits: DataFrame, nan_aware: bool = True) -> DataFrame:
    """fits(prey, mu, sigma, ...) with imputed = false and mu = 0 where mu or sigma is over 3 deviations off the mean.

    Skipped preys (null sigma) count with their mu; unless nan_aware, a single one switches the test of sigma off.
    """
    stats = fits.agg(F.avg("mu").alias("m_mu"), F.stddev_pop("mu").alias("s_mu"), F.avg("sigma").alias("m_s"), F.stddev_pop("sigma").alias("s_s"), F.count_if(F.col("sigma").isNull()).alias("skipped"))
    rows = fits.crossJoin(F.broadcast(stats))
    far = F.abs(F.col("mu") - F.col("m_mu")) > 3 * F.col("s_mu")
    wide = F.coalesce(F.abs(F.col("sigma") - F.col("m_s")) > 3 * F.col("s_s"), F.lit(False))
    wide = wide if nan_aware else wide & (F.col("skipped") == 0)
    out = rows.withColumn("imputed", F.col("sigma").isNotNull() & ~far & ~wide)
    return out.withColumn("mu", F.when(far | wide, 0.0).otherwise(F.col("mu"))).drop("m_mu", "s_mu", "m_s", "s_s", "skipped")


def missingness(inter: DataFrame, experiments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., prey, missing, mean_log2) within experiments(by..., experiment): share of zeros, mean log2 of the others."""
    n = experiments.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = inter.where("value > 0").join(F.broadcast(experiments), "experiment").groupBy(*by, "prey").agg(F.count(F.lit(1)).alias("seen"), F.avg(F.log2("value")).alias("mean_log2"))
    rows = rows.join(F.broadcast(n), [*by]) if by else rows.crossJoin(F.broadcast(n))
    return rows.select(*by, "prey", (1 - F.col("seen") / F.col("n")).alias("missing"), "mean_log2")


def spline_basis(x: Column, knots: Column, size: int) -> Column:
    """A constant, x and natural cubic splines over an array of at most `size` knots, linear beyond the ends: an array of
    `size` values, zeros where there are fewer knots."""
    last, before = F.element_at(knots, -1), F.element_at(knots, -2)
    cube = lambda k: F.pow(F.greatest(F.lit(0.0), x - k), F.lit(3.0))
    d = lambda k: (cube(k) - cube(last)) / F.nullif(last - k, F.lit(0.0))
    bends = [F.when(F.size(knots) > k + 2, d(F.get(knots, F.lit(k))) - d(before)).otherwise(0.0) for k in range(size - 2)]
    return F.array(F.lit(1.0), x, *bends)


def missingness_at_top(stats: DataFrame, by: str, df: int = 5, family: str = "binomial", least: int = 10, rounds: int = 100) -> dict[object, float]:
    """{group: the share missing that a natural-cubic-spline regression predicts at the group's largest mean}.

    stats(by, prey, missing, mean_log2). Knots are `df` equidistant quantiles of the distinct means. Least squares
    (family gaussian) or a logit by iterated reweighting (binomial, shares clamped by 1e-6); the normal equations of all
    groups are one aggregate a round, of which df (df + 3) / 2 sums a group reach the driver. Groups of fewer than
    `least` preys, of equal means or of under three distinct knots are left out.
    """
    if family not in ("binomial", "gaussian"):
        raise ValueError(f"unknown family: {family}")
    stats = cut(stats.where("mean_log2 is not null").select(F.col(by).alias("g"), "missing", "mean_log2"))
    knots = quantiles_by(stats.select("g", "mean_log2").distinct(), ["g"], "mean_log2", [k / (df - 1) for k in range(df)])
    size = stats.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("mean_log2").alias("m"), F.stddev_pop("mean_log2").alias("sd"), F.max("mean_log2").alias("top"))
    groups = size.where((F.col("n") >= least) & (F.col("sd") > 0)).join(knots, "g")
    # Equal to nine digits is equal: a knot twice is no knot more.
    scaled = F.array_distinct(F.transform("quantiles", lambda q: F.round((q - F.col("m")) / F.col("sd"), 9)))
    groups = cut(groups.select("g", "m", "sd", ((F.col("top") - F.col("m")) / F.col("sd")).alias("top"), scaled.alias("knots")).where(F.size("knots") >= 3))
    x = (F.col("mean_log2") - F.col("m")) / F.col("sd")
    y = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "missing")) if family == "binomial" else F.col("missing")
    rows = cut(stats.join(F.broadcast(groups), "g").select("g", y.alias("y"), spline_basis(x, F.col("knots"), df).alias("b")))
    tops = {r.g: np.array(r.b) for r in groups.select("g", spline_basis(F.col("top"), F.col("knots"), df).alias("b")).collect()}

    at = lambda k: F.get("b", F.lit(k))
    cells = [(i, j) for i in range(df) for j in range(i, df)]

    def solve(table: DataFrame, weight: Column, target: Column, loss: Column) -> dict[object, tuple[np.ndarray, float]]:
        sums = [F.sum(weight * at(i) * at(j)) for i, j in cells] + [F.sum(weight * target * at(i)) for i in range(df)] + [F.sum(loss)]
        out = {}
        for row in table.groupBy("g").agg(*[c.alias(f"s{k}") for k, c in enumerate(sums)]).collect():
            values, left = np.array(row[1:], float), np.zeros((df, df))
            for (i, j), v in zip(cells, values, strict=False):
                left[i, j] = left[j, i] = v
            # Columns of their own size first, so that small ones are no rounding.
            scale = 1 / np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1))
            out[row[0]] = scale * np.linalg.lstsq(left * np.outer(scale, scale), scale * values[len(cells) : -1], rcond=1e-13)[0], values[-1]
        return out

    if family == "gaussian":
        return {g: float(tops[g] @ beta) for g, (beta, _) in solve(rows, F.lit(1.0), F.col("y"), F.lit(0.0)).items()}
    mu = (F.col("y") + 0.5) / 2
    eta, table = F.log(mu / (1 - mu)), rows
    beta: dict[object, np.ndarray] = {}
    before: dict[object, float] = {}
    spark = stats.sparkSession
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-eta))
        weight = F.greatest(F.lit(1e-12), q * (1 - q))
        loss = -2 * (F.col("y") * F.log(F.greatest(q, F.lit(1e-300))) + (1 - F.col("y")) * F.log(F.greatest(1 - q, F.lit(1e-300))))
        found = solve(table, weight, eta + (F.col("y") - q) / weight, loss)
        moved = [abs(np.linalg.norm(b - beta[g])) > 1e-9 * (1 + np.linalg.norm(b)) and abs(v - before[g]) > 1e-13 * (1 + abs(v)) if g in beta else True for g, (b, v) in found.items()]
        beta, before = {g: b for g, (b, _) in found.items()}, {g: v for g, (_, v) in found.items()}
        if not any(moved):
            break
        coefficients = spark.createDataFrame([(g, b.tolist()) for g, b in beta.items()], f"g {dict(rows.dtypes)['g']}, beta array<double>")
        table = rows.join(F.broadcast(coefficients), "g")
        eta = F.aggregate(F.zip_with("b", "beta", lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    return {g: float(1 / (1 + np.exp(-(tops[g] @ b)))) for g, b in beta.items()}


def estimate_pi(inter: DataFrame, design: DataFrame, method: str = "weighted_average", bait: str | None = None, least_replicates: int = 3, family: str = "binomial") -> float:
    """pi from control baits with enough replicates: one bait's, or the mean weighted by replicates; failed fits skip.

    All baits are fitted in the same jobs."""
    if method not in ("weighted_average", "single_bait"):
        raise ValueError(f"unknown method: {method}")
    controls = design.where("type = 'C' and bait is not null")
    counts = {r.bait: r.n for r in controls.groupBy("bait").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_replicates).collect()}
    if method == "single_bait":
        if bait not in counts:
            raise ValueError(f"no control bait {bait} with {least_replicates} replicates")
        counts = {bait: counts[bait]}
    used = controls.where(F.col("bait").isin([*counts])).select("bait", "experiment")
    found = missingness_at_top(missingness(inter, used, ("bait",)), "bait", family=family) if counts else {}
    if not found:
        raise ValueError("no control bait has enough replicates and preys")
    return sum(counts[b] * pi for b, pi in sorted(found.items())) / sum(counts[b] for b in found)


def impute(inter: DataFrame, design: DataFrame, preys: DataFrame, mode: str = "mixture", pi: float = 0.0) -> DataFrame:
    """(prey, mu, sigma, tlim, imputed, imputed_mu): imputed_mu is 10^mu, or 0 where nothing is imputed.

    Preys without a value other than their own bait's are skipped: mu is the limit and sigma null.
    """
    inter, design = stored(inter), cut(design)
    bounds = cut(limits(inter, mode))
    rows = exclude_self(inter, design)
    own = design.where("bait_id is not null").groupBy(F.col("bait_id").alias("prey")).agg(F.count(F.lit(1)).alias("own"))
    n = design.agg(F.count(F.lit(1)).alias("n"))
    stats = censor_stats(rows, F.lit(0), bounds, mode, values=mode == "prior").crossJoin(F.broadcast(n)).join(F.broadcast(own), "prey", "left")
    stats = stored(stats.withColumn("n_zero", F.col("n") - F.coalesce("own", F.lit(0)) - F.col("n_obs")).drop("n", "own"))
    fits = fit(stats, mode, pi).select("prey", "mu", "sigma", "tlim")
    skipped = preys.select("prey").join(stats.select("prey"), "prey", "left_anti").crossJoin(F.broadcast(bounds.select("upper_tlim")))
    every = fits.unionByName(skipped.select("prey", F.col("upper_tlim").alias("mu"), F.lit(None).cast("double").alias("sigma"), F.col("upper_tlim").alias("tlim")))
    out = reject_outliers(cut(every), nan_aware=mode != "prior")
    return out.withColumn("imputed_mu", F.when(F.col("imputed"), F.pow(F.lit(10.0), "mu")).otherwise(0.0))


def normalization(inter: DataFrame, ddof: int = 0) -> DataFrame:
    """One row (mean, sd) of ln(value) over positive values."""
    return inter.where("value > 0").agg(F.avg(F.log("value")).alias("mean"), (F.stddev_samp if ddof else F.stddev_pop)(F.log("value")).alias("sd"))


def normalize(df: DataFrame, params: DataFrame, column: str = "value") -> DataFrame:
    return df.crossJoin(F.broadcast(params)).withColumn(column, F.when(F.col(column) > 0, (F.log(column) - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def denormalize(df: DataFrame, params: DataFrame, column: str = "value") -> DataFrame:
    return df.crossJoin(F.broadcast(params)).withColumn(column, F.exp(F.col(column) * F.col("sd") + F.col("mean"))).drop("mean", "sd")
