"""The tables behind quality control, network comparison and enrichment plots.

Scored rows have bait, bait_id, prey, first_id, score, bfdr, wd, wd_fdr, is_known and multivalidated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import leading, summed
from ..functions.lineage import cut, stored
from ..functions.stats import bh_adjust, hypergeom_tail, running, t_two_sided
from ..functions.text import features, intensities
from . import scoring


def apply_thresholds(scored: DataFrame, score: float = 0.0, bfdr: float = 1.0, wd: float = 0.0, wd_fdr: float = 1.0, baits: Sequence[str] | None = None) -> DataFrame:
    """Rows that pass all thresholds; a missing wd_fdr counts as 1."""
    rows = scored if baits is None else scored.where(F.col("bait").isin([*baits]))
    return rows.where((F.col("score") >= score) & (F.col("bfdr") <= bfdr) & (F.col("wd") >= wd) & (F.coalesce("wd_fdr", F.lit(1.0)) <= wd_fdr))


def bait_network(scored: DataFrame, bait: str, **thresholds: float) -> DataFrame:
    return apply_thresholds(scored.where(F.col("bait") == bait), **thresholds)


def network_degree(passing: DataFrame, known: DataFrame) -> DataFrame:
    """(first_id, degree): ends of known(a, b) rows between passing preys that are no passing baits."""
    preys = passing.select("first_id").where("first_id is not null").distinct()
    baits = passing.select(F.col("bait_id").alias("first_id")).where("bait_id is not null").distinct()
    ends = preys.join(baits, "first_id", "left_anti")
    inside = known.join(ends.withColumnRenamed("first_id", "a"), "a", "left_semi").join(ends.withColumnRenamed("first_id", "b"), "b", "left_semi")
    counts = inside.select(F.explode(F.array("a", "b")).alias("first_id")).groupBy("first_id").agg(F.count(F.lit(1)).alias("degree"))
    return preys.join(counts, "first_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def threshold_metrics(scored: DataFrame, known: DataFrame, baits: Sequence[str] | None = None, **thresholds: float) -> DataFrame:
    """One row: totals and knowns before and after, median network size, enrichment of knowns, mean degree."""
    rows = stored(scored if baits is None else scored.where(F.col("bait").isin([*baits])))
    passing = apply_thresholds(rows, **thresholds)
    count = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"total_{s}"), F.count_if("is_known").alias(f"known_{s}"))
    sizes = passing.groupBy("bait").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.median("n"), F.lit(0.0)).alias("median_network_size"))
    degree = network_degree(passing, known).agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"))
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [count(rows, "before"), count(passing, "after"), sizes, degree])
    ratio = (F.col("known_after") / F.nullif("total_after", F.lit(0))) / (F.nullif("known_before", F.lit(0)) / F.nullif("total_before", F.lit(0)))
    return out.withColumn("enrichment_ratio", F.coalesce(ratio, F.lit(0.0)))


def retention_curve(scored: DataFrame, steps: int = 20, similarity: str | None = None) -> DataFrame:
    """(cutoff, n, share_known[, mean similarity]) of rows with score >= each of 0, 1/steps, ..., 1.

    Rows are counted by the last cut-off they pass; a reverse running sum over these few rows does the rest.
    """
    last = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")) * steps + 1e-9).cast("int")
    more = [F.sum(similarity).alias("s"), F.count(similarity).alias("c")] if similarity else []
    counts = scored.where("score >= 0").groupBy(last.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_known").alias("k"), *more)
    all_steps = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = all_steps.join(counts, "step", "left").withColumn("total", total("n")).withColumn("known", total("k"))
    mean = [(F.sum("s").over(w) / F.nullif(F.sum("c").over(w), F.lit(0))).alias("mean_similarity")] if similarity else []
    return rows.select((F.col("step") / steps).alias("cutoff"), F.col("total").alias("n"), (F.col("known") / F.nullif("total", F.lit(0))).alias("share_known"), *mean)


def roc_curve(scored: DataFrame, column: str, descending: bool = True, baits: Sequence[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr, d_fpr, d_tpr): one point a distinct value, with (0, 0) first (threshold null); knowns are
    the positives, and d_fpr and d_tpr are what a point adds. Running sums go by ranges of the value."""
    rows = (scored if baits is None else scored.where(F.col("bait").isin([*baits]))).where(F.col(column).isNotNull())
    value = F.col(column) if descending else -F.col(column)
    counts = rows.groupBy(value.alias("threshold")).agg(F.count_if("is_known").alias("tp"), F.count_if(~F.col("is_known")).alias("fp"))
    summed = running(counts, "threshold", {"t": ("sum", "tp"), "f": ("sum", "fp")}, descending=True)
    summed = summed.crossJoin(F.broadcast(summed.agg(F.nullif(F.sum("tp"), F.lit(0)).alias("p"), F.nullif(F.sum("fp"), F.lit(0)).alias("n"))))
    share = lambda c, whole: (F.col(c) / F.col(whole)).cast("double")
    points = summed.select(F.col("threshold").cast("double"), share("f", "n").alias("fpr"), share("t", "p").alias("tpr"), share("fp", "n").alias("d_fpr"), share("tp", "p").alias("d_tpr"))
    start = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), *[F.lit(0.0).alias(c) for c in points.columns[1:]])
    return start.union(points)


def auc(curve: DataFrame) -> DataFrame:
    """The area under a roc_curve() by trapezoids, each from its own point and what it adds."""
    return curve.agg(F.sum(F.col("d_fpr") * (F.col("tpr") - F.col("d_tpr") / 2)).alias("auc"))


def evidence_class(scored: DataFrame) -> DataFrame:
    """scored with evidence, and mean_control where there is a pipe list ctrl_values."""
    kind = F.when(F.col("multivalidated"), "multivalidated").when(F.col("is_known"), "known").otherwise("not known")
    rows = scored.withColumn("evidence", kind)
    if "ctrl_values" not in scored.columns:
        return rows
    values = intensities(F.col("ctrl_values"))
    return rows.withColumn("mean_control", F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)))


def pca_matrix(inter: DataFrame, design: DataFrame, present: float = 0.5) -> DataFrame:
    """(prey, experiment, z) in long form for preys seen in at least a share of experiments: an export of the whole grid.

    Missing cells take the prey's least value; z is by prey with the sample deviation. Preys without spread go.
    """
    _, experiments, rows = standardised_cells(inter, design, present)
    stored = rows.select("prey", "fill", F.explode("cells").alias("c")).select("prey", F.col("c.e").alias("e"), (F.col("fill") + F.col("c.s")).alias("z"))
    grid = rows.select("prey", "fill").crossJoin(F.broadcast(experiments))
    return grid.join(stored, ["prey", "e"], "left").select("prey", "experiment", F.coalesce("z", "fill").alias("z"))


def standardised_cells(inter: DataFrame, design: DataFrame, present: float = 0.5) -> tuple[int, DataFrame, DataFrame]:
    """(experiments, their table (experiment, e) and (prey, fill, cells)): the standardised matrix as stored cells.

    A prey's z is `fill` in every experiment, with s added in its cells (e, s) alone: the absent ones, which take its
    least value, are never rows. Counts, sums and the least value by prey give mean and sample deviation. Experiments
    are numbered by name; the design is as small as it has to be to be broadcast (scoring.checked_design).
    """
    design = scoring.checked_design(design)
    names = design.select("experiment").distinct()
    experiments = cut(names.select("experiment", (F.row_number().over(Window.orderBy("experiment")) - 1).alias("e")))
    n = experiments.count()
    cells = inter.where("value > 0").join(F.broadcast(experiments), "experiment").select("prey", "e", F.col("value").cast("double").alias("v"))
    rows = cells.groupBy("prey").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.sum("v").alias("s"), F.sort_array(F.collect_list(F.struct("e", "v"))).alias("all")).where(F.col("n") >= present * n)
    rows = rows.withColumn("mean", (F.col("s") + (n - F.col("n")) * F.col("low")) / n)
    off = F.aggregate("all", F.lit(0.0), lambda a, c: a + (c["v"] - F.col("mean")) * (c["v"] - F.col("mean")))
    rows = rows.withColumn("sd", F.sqrt((off + (n - F.col("n")) * (F.col("low") - F.col("mean")) * (F.col("low") - F.col("mean"))) / F.nullif(F.lit(n - 1), F.lit(0))))
    shifted = F.transform("all", lambda c: F.struct(c["e"].alias("e"), ((c["v"] - F.col("low")) / F.col("sd")).alias("s")))
    return n, experiments, rows.where("sd > 0").select("prey", ((F.col("low") - F.col("mean")) / F.col("sd")).alias("fill"), shifted.alias("cells"))


#: Cells of a batch that are multiplied at once.
_AT_ONCE = 1 << 18


def gram_product(rows: DataFrame, n: int, q: np.ndarray) -> np.ndarray:
    """Z'Zq for the preys x experiments matrix Z of standardised_cells(): with Z = fill 1' + S, from stored cells alone."""
    sums = q.sum(0)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        lists = batch.column(1)
        cell = lists.flatten()
        e, s = cell.field(0).to_numpy(), cell.field(1).to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        fill = batch.column(0).to_numpy()
        first = 0
        while first < len(fill):
            at = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, at + _AT_ONCE, side="right")))
            sizes = np.diff(np.concatenate([[at], ends[first:last]]))
            es, ss, f = e[at : ends[last - 1]], s[at : ends[last - 1]], fill[first:last]
            # A prey's product with each column of q, then what it adds to every experiment and to its own.
            y = f[:, None] * sums + np.add.reduceat(ss[:, None] * q[es], np.cumsum(sizes) - sizes, axis=0)
            total += f @ y
            weighed = ss[:, None] * np.repeat(y, sizes, axis=0)
            for k in range(q.shape[1]):
                total[:, k] += np.bincount(es, weighed[:, k], minlength=n)
            first = last

    return summed(rows.select("fill", "cells"), add, q.shape)


def pca(inter: DataFrame, design: DataFrame, components: int = 2, present: float = 0.5) -> tuple[DataFrame, list[float]]:
    """(experiment, pc1, pc2, ...) of the matrix of pca_matrix(), and explained shares.

    The grid is not built: products with the experiments' Gram matrix come from stored cells (gram_product), and only
    experiments x block reaches the driver, where the block is orthonormalised. Signs: the largest score is positive.
    Without preys or with one experiment there are no rows.
    """
    n, experiments, rows = standardised_cells(inter, design, present)
    rows = cut(rows)
    trace = float(rows.count()) * (n - 1)
    spark = inter.sparkSession
    if not trace:
        return spark.createDataFrame([], "experiment string, " + ", ".join(f"pc{k + 1} double" for k in range(components))), [0.0] * components
    values, vectors = leading(lambda q: gram_product(rows, n, q), n, components)
    values = np.maximum(values, 0)
    scores = vectors * np.sqrt(values)
    scores *= np.where(scores[np.abs(scores).argmax(0), range(scores.shape[1])] < 0, -1, 1)
    schema = "e int, " + ", ".join(f"pc{k + 1} double" for k in range(scores.shape[1]))
    found = spark.createDataFrame([(e, *map(float, x)) for e, x in enumerate(scores)], schema)
    return experiments.join(found, "e").drop("e"), (values / trace).tolist()


def compare_baits(inter: DataFrame, design: DataFrame, scored: DataFrame, a: str, b: str, **thresholds: float) -> DataFrame:
    """For each prey: means over both baits' test experiments (zeros count), log2_ratio, p (equal variances), -log10 p
    and which bait's score passes: Both, A only, B only or Neither."""
    test = design.where((F.col("type") == "T") & F.col("bait").isin(a, b))
    n = test.agg(F.count_if(F.col("bait") == a).alias("n_a"), F.count_if(F.col("bait") == b).alias("n_b"))
    rows = inter.join(F.broadcast(test.select("experiment", F.col("bait").alias("_b"))), "experiment")
    x = F.col("value")
    part = lambda name, s: [F.coalesce(F.sum(F.when(F.col("_b") == name, x)), F.lit(0.0)).alias(f"s_{s}"), F.coalesce(F.sum(F.when(F.col("_b") == name, x * x)), F.lit(0.0)).alias(f"ss_{s}")]
    sums = rows.groupBy("prey").agg(*part(a, "a"), *part(b, "b")).crossJoin(F.broadcast(n)).where("n_a > 0 and n_b > 0")
    sums = sums.withColumn("mean_a", F.col("s_a") / F.col("n_a")).withColumn("mean_b", F.col("s_b") / F.col("n_b"))
    sse = F.greatest(F.lit(0.0), F.col("ss_a") - F.col("s_a") * F.col("mean_a")) + F.greatest(F.lit(0.0), F.col("ss_b") - F.col("s_b") * F.col("mean_b"))
    free = F.col("n_a") + F.col("n_b") - 2
    se = F.sqrt(sse / F.nullif(free, F.lit(0)) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(se, F.lit(0.0))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    out = sums.withColumn("t", t).withColumn("p_value", F.when(~enough, 1.0).when(F.col("t").isNotNull(), t_two_sided(F.col("t"), free)))
    ratio = F.when((F.col("mean_a") > 0) & (F.col("mean_b") > 0), F.log2(F.col("mean_a") / F.nullif("mean_b", F.lit(0.0)))).otherwise(0.0)
    out = out.withColumn("log2_ratio", ratio).withColumn("neg_log10_p", F.when(F.col("p_value") == 0, 300.0).otherwise(-F.log10("p_value")))
    passing = apply_thresholds(scored, **thresholds).where(F.col("bait").isin(a, b)).groupBy("prey").agg(F.bool_or(F.col("bait") == a).alias("in_a"), F.bool_or(F.col("bait") == b).alias("in_b"))
    kind = F.when(F.col("in_a") & F.col("in_b"), "Both").when(F.col("in_a"), "A only").when(F.col("in_b"), "B only").otherwise("Neither")
    return out.join(passing, "prey", "left").select("prey", "mean_a", "mean_b", "log2_ratio", "p_value", "neg_log10_p", kind.alias("category"))


def set_overlap(left: DataFrame, right: DataFrame, key: str = "prey") -> DataFrame:
    """One row: keys only in the left, in both, only in the right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("only_a"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("l").isNull()).alias("only_b"))


def enrichment(scored: DataFrame, listed: DataFrame, threshold: float, least_all: int = 5, least_hits: int = 2) -> DataFrame:
    """For each bait and feature of its hits (score >= threshold): k, n, K, M, p_value, enrichment, adj_p.

    listed(prey, feature_type, features[, ordinal]) has `;` lists; of several rows of a prey the last counts. Features
    of under `least_all` preys or `least_hits` hits are left out; adjustment is by bait and feature type.
    """
    pick = F.max_by("features", "ordinal") if "ordinal" in listed.columns else F.max("features")
    scored = cut(scored.select("bait", "prey", "score"))
    universe = cut(scored.select("prey").distinct())
    feats = listed.groupBy("prey", "feature_type").agg(pick.alias("features")).join(universe, "prey", "left_semi").select("prey", "feature_type", F.explode(features(F.col("features"))).alias("feature"))
    feats = cut(feats)
    m = universe.agg(F.count(F.lit(1)).alias("m_all"))
    total = feats.groupBy("feature_type", "feature").agg(F.count(F.lit(1)).alias("k_all")).where(F.col("k_all") >= least_all)
    hits = scored.where(F.col("score") >= threshold).select("bait", "prey").distinct()
    n = hits.groupBy("bait").agg(F.count(F.lit(1)).alias("n"))
    k = hits.join(feats, "prey").groupBy("bait", "feature_type", "feature").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_hits)
    rows = k.join(total, ["feature_type", "feature"]).join(F.broadcast(n), "bait").crossJoin(F.broadcast(m))
    rows = rows.withColumn("p_value", hypergeom_tail(F.col("k"), F.col("n"), F.col("k_all"), F.col("m_all"))).withColumn("enrichment", (F.col("k") / F.col("n")) / (F.col("k_all") / F.col("m_all")))
    return bh_adjust(cut(rows), "p_value", "adj_p", ["bait", "feature_type"])


def enrichment_matrix(enriched: DataFrame, adj_p: float = 0.05, ratio: float = 2.0, top: int = 30, baits: Sequence[str] | None = None) -> DataFrame:
    """log2 enrichment by feature and bait (1 where missing, 1 at least) of the features that pass for most baits."""
    enriched = cut(enriched)
    good = enriched.where((F.col("adj_p") <= adj_p) & (F.col("enrichment") >= ratio))
    best = good.groupBy("feature").agg(F.countDistinct("bait").alias("n")).orderBy(F.desc("n"), "feature").limit(top)
    names = [*baits] if baits is not None else [r.bait for r in enriched.select("bait").distinct().orderBy("bait").collect()]
    wide = good.join(F.broadcast(best.select("feature")), "feature", "left_semi").groupBy("feature").pivot("bait", names).agg(F.max("enrichment"))
    return wide.select("feature", *[F.log2(F.greatest(F.lit(1.0), F.coalesce(F.col(f"`{b}`"), F.lit(1.0)))).alias(b) for b in names])
