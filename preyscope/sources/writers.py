"""Sinks: scoring inputs, scored tables, grouped results with a run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the quality-control sidecar.
SIDECAR = ("Protein", "originalRUN", "GROUP", "SUBJECT", "NumMeasuredFeature", "NumImputedFeature", "MissingPercentage", "more50missing")

# The columns of the table for the older tool.
WD_INPUT = {"experiment": "Experiment.ID", "replicate": "Replicate", "bait": "Bait", "prey": "Prey", "gene": "Prey.Name", "count": "Spectral.Count"}


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, emptyValue="")


def write_scoring_inputs(design: DataFrame, preys: DataFrame, inter: DataFrame, folder: str, lengths: bool = False) -> None:
    """bait, prey and interaction TSVs without headers; preys with their length as second column if asked for."""
    write_tsv(design.select("experiment", "bait", "type"), f"{folder}/bait")
    write_tsv(preys.select("prey", *["length"] * lengths, "gene"), f"{folder}/prey")
    write_tsv(inter.select("experiment", "bait", "prey", "value"), f"{folder}/interaction")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Any result, as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)


def write_wd_input(df: DataFrame, path: str) -> None:
    """The wd table (ingest.wd_from_scoring_inputs) as CSV with the older tool's column names."""
    write_table(df.select(*[F.col(c).alias(name) for c, name in WD_INPUT.items()]), path, "csv")


def write_sidecar(df: DataFrame, path: str) -> None:
    """Those of the sidecar's columns that the table has."""
    write_table(df.select(*[c for c in SIDECAR if c in df.columns]), path, "csv")


def run_summary(design_groups: DataFrame, scored: DataFrame) -> DataFrame:
    """For each group: test and control experiments and scored pairs."""
    counts = design_groups.groupBy("source_group").agg(F.count_if(F.col("type") == "T").alias("n_test"), F.count_if(F.col("type") == "C").alias("n_control"))
    return counts.join(scored.groupBy("source_group").agg(F.count(F.lit(1)).alias("n_pairs")), "source_group", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def write_groups(scored: DataFrame, design_groups: DataFrame, path: str) -> None:
    """Results by group, and the run summary as JSON beside them."""
    scored.write.mode("overwrite").partitionBy("source_group").parquet(f"{path}/groups")
    run_summary(design_groups, scored).write.mode("overwrite").json(f"{path}/summary")
