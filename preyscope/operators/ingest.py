"""From wide tables to the sparse long table (experiment, bait, prey, value), with filters and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_ids

FLAGS = ("reverse", "only_by_site", "contaminant")


def drop_flagged(wide: DataFrame) -> DataFrame:
    """Rows without a + in any flag."""
    return wide.where(" and ".join(f"coalesce({c}, '') <> '+'" for c in FLAGS))


def flagged_counts(wide: DataFrame) -> DataFrame:
    return wide.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) == "+").alias(c) for c in FLAGS])


def melt_quant(wide: DataFrame, design: DataFrame, experiments: Sequence[str], keep: Sequence[str] = ("prey",)) -> DataFrame:
    """wide -> (keep..., experiment, bait, type, value) over the quant columns that the design names."""
    columns = [c for c in wide.columns if c in {*experiments}]
    long = wide.unpivot([*keep], [F.col(f"`{c}`").cast("double").alias(c) for c in columns], "experiment", "value")
    return long.join(F.broadcast(design.select("experiment", "bait", "type")), "experiment")


def drop_control_only(inter: DataFrame, design: DataFrame) -> DataFrame:
    """Rows of preys whose values over test experiments sum to more than 0."""
    test = design.where("type = 'T'").select("experiment", F.lit(True).alias("_test")).distinct()
    seen = F.sum(F.when(F.col("_test"), F.col("value"))).over(Window.partitionBy("prey"))
    rows = inter.join(F.broadcast(test), "experiment", "left").withColumn("_seen", seen)
    return rows.where("_seen > 0 and prey is not null").select(*inter.columns)


def name_preys(wide: DataFrame) -> DataFrame:
    """(prey, gene): shortened id and gene lists; a missing gene is the id."""
    return wide.select(short_ids(F.col("prey")).alias("prey"), F.coalesce(short_ids(F.nullif(F.trim("gene"), F.lit(""))), short_ids(F.col("prey"))).alias("gene"))


def drop_zero(inter: DataFrame) -> DataFrame:
    return inter.where("value > 0")


def dense_interactions(inter: DataFrame, design: DataFrame, preys: DataFrame) -> DataFrame:
    """A row for each prey and experiment, zeros included: for export; nothing else needs the dense table."""
    grid = preys.select("prey").crossJoin(F.broadcast(design.select("experiment", "bait")))
    return grid.join(inter.select("experiment", "prey", "value"), ["experiment", "prey"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def msstats_clean(rows: DataFrame) -> DataFrame:
    """Light rows with a value, duplicates averaged in log space, on the linear scale: (prey, experiment, value)."""
    light = rows.where("label = 'L' and log_intensity is not null and prey is not null and experiment is not null")
    return light.groupBy("prey", "experiment").agg(F.pow(F.lit(2.0), F.avg("log_intensity")).alias("value"))


def pivot_runs(inter: DataFrame, experiments: Sequence[str]) -> DataFrame:
    """prey by experiment with mean values and 0 for missing: for export."""
    return inter.groupBy("prey").pivot("experiment", [*experiments]).agg(F.avg("value")).fillna(0.0)


def wd_table(inter: DataFrame, design: DataFrame) -> DataFrame:
    """(experiment, replicate, bait, prey, count): positive values, with the bait's name as experiment and id as bait."""
    side = design.select("experiment", F.col("bait").alias("bait_name"), "bait_id", "replicate")
    rows = inter.where("value > 0").select("experiment", "prey", F.col("value").alias("count")).join(F.broadcast(side), "experiment")
    return rows.select(F.col("bait_name").alias("experiment"), "replicate", F.col("bait_id").alias("bait"), "prey", "count")


def number_replicates(design: DataFrame, ordinal: str) -> DataFrame:
    """replicate: a running number within each bait, in file order."""
    return design.withColumn("replicate", F.row_number().over(Window.partitionBy("bait").orderBy(ordinal)))


def wd_from_scoring_inputs(inter: DataFrame, design: DataFrame, preys: DataFrame) -> DataFrame:
    """The wd table from scoring inputs: zeros stay, unknown experiments and preys give nulls."""
    side = design.select("experiment", F.col("bait").alias("bait_name"), F.coalesce("bait_id", "bait").alias("bait_id"), "replicate")
    rows = inter.select("experiment", "prey", F.col("value").alias("count")).join(F.broadcast(side), "experiment", "left").join(preys.select("prey", "gene"), "prey", "left")
    return rows.select(F.col("bait_name").alias("experiment"), "replicate", F.col("bait_id").alias("bait"), "prey", "gene", "count")


def design_counts(design: DataFrame) -> DataFrame:
    return design.agg(F.countDistinct(F.when(F.col("type") == "T", F.col("experiment"))).alias("n_test"), F.countDistinct(F.when(F.col("type") == "C", F.col("experiment"))).alias("n_control"))
