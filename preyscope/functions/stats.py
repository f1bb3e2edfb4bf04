"""Densities, tails and error rates as column expressions and joins on pre-aggregated values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tails
from .lineage import cut

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)

#: Values with their rates that are broadcast, some 50 bytes a row.
MOST_VALUES = 100_000


def log_factorial(k: Column) -> Column:
    """ln k! for whole k >= 0: exact logarithms below 10, Stirling's series (error under 1e-12) from there."""
    x = F.greatest(k.cast("double"), F.lit(10.0))
    series = (x + 0.5) * F.log(x) - x + HALF_LOG_2PI + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    small = F.array(*[F.lit(math.log(math.factorial(n))) for n in range(10)])
    return F.when(k < 10, F.get(small, F.least(k, F.lit(9)).cast("int"))).otherwise(series)


def gp_log_pmf(k: Column, mean: Column, dispersion: Column) -> Column:
    """Generalised Poisson log density of a whole count with this mean and dispersion lambda2."""
    first = mean * (1 - dispersion)
    rate = first + k * dispersion
    return F.when(k == 0, -first).otherwise(F.log(first) + (k - 1) * F.log(rate) - rate - log_factorial(k))


def normal_log_pdf_clamped(x: Column, mean: Column, sd: Column, most: float = 5.0) -> Column:
    """Gaussian log density with the standardised distance capped."""
    return -0.5 * F.pow(F.least(F.abs((x - mean) / sd), F.lit(most)), F.lit(2)) - F.log(sd) - HALF_LOG_2PI


def running(df: DataFrame, order: str, totals: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """df with running sums or minima in the order of a column that tells its rows apart: {name: (sum or min, column)}.

    Rows are dealt by ranges of the column. The totals of the ranges, a row a shuffle partition, are run over first,
    then the rows within each range, so no task sees more than a range.
    """
    ordered = F.desc(order) if descending else F.asc(order)
    dealt = cut(df.repartitionByRange(ordered).withColumn("_part", F.spark_partition_id()))
    fold = {"sum": F.sum, "min": F.min}
    parts = dealt.groupBy("_part").agg(*[fold[f](c).alias(f"_{name}") for name, (f, c) in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[fold[f](f"_{name}").over(before).alias(f"_{name}") for name, (f, _) in totals.items()])
    within = Window.partitionBy("_part").orderBy(ordered).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(parts), "_part")
    for name, (f, c) in totals.items():
        own = fold[f](c).over(within)
        rows = rows.withColumn(name, own + F.coalesce(f"_{name}", F.lit(0)) if f == "sum" else F.least(own, f"_{name}"))
    return rows.drop("_part", *[f"_{name}" for name in totals])


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles {name: (column, share)}; nulls do not count, none gives null."""
    out = []
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        ranked = running(counts, "_v", {"_upto": ("sum", "_c")})
        rows = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("_c").alias("_n"))))
        picks = []
        for name, (c, share) in wanted.items():
            if c == column:
                place = share * (F.col("_n") - 1)
                low, high = (F.min(F.when(F.col("_upto") > f(place), F.col("_v"))) for f in (F.floor, F.ceil))
                picks.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
        out.append(rows.agg(*picks))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), out)


def quantiles_by(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """(by..., quantiles): the interpolated quantiles of each group's values, as an array in the order of `shares`.

    Groups share the ranges of (group, value), so a group of any size is spread over them.
    """
    keys = [*by]
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts.withColumn("_o", F.struct(*keys, "_v")), "_o", {"_upto": ("sum", "_c")})
    groups = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_base"))
    rows = ranked.join(F.broadcast(groups), keys).withColumn("_upto", F.col("_upto") - F.col("_base"))
    picks = []
    for k, share in enumerate(shares):
        place = share * (F.col("_n") - 1)
        low, high = (F.min(F.when(F.col("_upto") > f(place), F.col("_v"))) for f in (F.floor, F.ceil))
        picks.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"_{k}"))
    return rows.groupBy(*keys).agg(*picks).select(*keys, F.array(*[f"_{k}" for k in range(len(picks))]).alias("quantiles"))


def upper_median(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., median): the value at place n div 2, counted from 0, of each group's ordered values that are not null."""
    keys = [*by]
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts.withColumn("_o", F.struct(*keys, "_v")), "_o", {"_upto": ("sum", "_c")})
    groups = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_base"))
    rows = ranked.join(F.broadcast(groups), keys) if keys else ranked.crossJoin(F.broadcast(groups))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_upto") - F.col("_base") > F.floor(F.col("_n") / 2), F.col("_v"))).alias("median"))


def with_rates(df: DataFrame, value: str, rates: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """A written table with the columns of rates(value, n, ...), a row for each of its values, n of them; null for null.

    A frequent value would bring all its rows to one task, so up to `most` values are broadcast: all, or those that more
    than a `most`-th of the rows have. Only rows of the others are shuffled.
    """
    rates = cut(rates)
    if rates.count() <= most:
        return df.join(F.broadcast(rates.drop("n")), value, "left")
    heavy = rates.crossJoin(F.broadcast(rates.agg((F.sum("n") / most).alias("_least")))).withColumn("_heavy", F.col("n") > F.col("_least")).drop("_least", "n")
    often, seldom = (F.broadcast(heavy.where("_heavy").drop("_heavy")), heavy.where("not _heavy").drop("_heavy"))
    none = df.where(F.col(value).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in often.dtypes if c != value})
    rare = df.join(often.select(value), value, "left_anti").where(F.col(value).isNotNull()).join(seldom, value, "left")
    return df.join(often, value).unionByName(rare).unionByName(none)


def tail_fdr(df: DataFrame, score: str, into: str = "bfdr") -> DataFrame:
    """df with 1 - mean(score of all rows with a strictly greater score), in [0, 1]; 0 for the top, equal for ties.

    Scores are counted by distinct value first; the running sums over these go by ranges of the score.
    """
    value = F.coalesce(F.col(score), F.lit(0.0))
    sums = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.col("_v") * F.col("n"))
    rows = running(sums, "_v", {"above": ("sum", "s"), "count": ("sum", "n")}, descending=True)
    greater = F.col("count") - F.col("n")
    rate = 1 - (F.col("above") - F.col("s")) / F.nullif(greater, F.lit(0))
    rates = rows.select("_v", "n", F.when(greater == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))).alias(into))
    return with_rates(df.withColumn("_v", value), "_v", rates).drop("_v")


def bh_adjust(df: DataFrame, p: str, into: str, by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over all rows, or within groups. Null p-values stay null and do not count.

    Works on distinct (group, p) values with their counts: adjusted = min over larger p of p * n / rank. Without groups
    ranks and minima run by ranges of p; with groups, by windows of the group.
    """
    keys = [*by]
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("c"))
    value = F.col("_p") * F.col("n") / F.col("rank")
    if keys:
        up = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("rank", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
        down = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
        least = ranked.withColumn("least", F.min(value).over(down))
    else:
        ranked = running(counts, "_p", {"rank": ("sum", "c")})
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("c").alias("n")))).withColumn("value", value)
        least = running(ranked, "_p", {"least": ("min", "value")}, descending=True)
        return with_rates(df.withColumn("_p", F.col(p)), "_p", least.select("_p", F.col("c").alias("n"), F.least(F.lit(1.0), "least").alias(into))).drop("_p")
    adjusted = least.select(*keys, "_p", F.least(F.lit(1.0), "least").alias(into))
    return df.withColumn("_p", F.col(p)).join(adjusted, [*keys, "_p"], "left").drop("_p")


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for any degrees of freedom above 0: an incomplete beta by continued fraction."""
    return F.pandas_udf(lambda x, n: pd.Series(tails.t_two_sided(x.to_numpy(float), n.to_numpy(float))), "double")(t.cast("double"), df.cast("double"))


def hypergeom_tail(k: Column, draws: Column, marked: Column, total: Column) -> Column:
    """P(at least k marked among `draws` of `total`, `marked` of which are marked), summed until terms no longer count."""
    columns = [c.cast("double") for c in (k, draws, marked, total)]
    return F.pandas_udf(lambda a, b, c, d: pd.Series(tails.hypergeom_tail(*(x.to_numpy(float) for x in (a, b, c, d)))), "double")(*columns)
