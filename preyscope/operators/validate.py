"""Validation rules; each gives a table of violations (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_spec
from ..sources.readers import FRAGPIPE_SUFFIX, QUANT_PREFIX, REQUIRED, missing_columns

# Columns of a DIA-NN matrix that are no runs.
DIANN_METADATA = ("Protein.Group", "Protein.Ids", "Protein.Names", "Genes", "First.Protein.Description", "N.Sequences", "N.Proteotypic.Sequences")


def _found(df: DataFrame, rule: str, test: Column, key: str, detail: Column) -> DataFrame:
    return df.where(F.coalesce(test, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).alias("key"), detail.cast("string").alias("detail"))


def required_not_blank(df: DataFrame, columns: Sequence[str], key: str = "experiment") -> DataFrame:
    """A row for each null or blank required cell; detail names the column."""
    bad = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(F.lit("required_not_blank").alias("rule"), F.col(key).alias("key"), F.explode(bad).alias("detail"))


def valid_type(design: DataFrame) -> DataFrame:
    return _found(design, "valid_type", ~F.coalesce(F.col("type").isin("T", "C"), F.lit(False)), "experiment", F.col("type"))


def valid_replicate(design: DataFrame) -> DataFrame:
    number = F.col("replicate").cast("string").try_cast("int")
    return _found(design, "valid_replicate", number.isNull() | (number <= 0), "experiment", F.col("replicate"))


def duplicate_experiments(design: DataFrame) -> DataFrame:
    counts = design.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))
    return _found(counts, "duplicate_experiment", F.col("n") > 1, "experiment", F.col("n"))


def group_rules(design: DataFrame) -> DataFrame:
    """The first rule that each row breaks, then groups without controls; a warning for control groups without tests.

    In order: not a group cell; * mixed with numbers; * on a test; a test with several groups; a test without group in
    a grouped design; a test's group that no control has, unless a control has *.
    """
    rows = design.withColumn("g", group_spec(F.col("grp")))
    spec = rows.select("experiment", "type", "grp", "g.*")
    grouped = spec.agg(F.bool_or(F.col("is_universal") | (F.size("groups") > 0)).alias("grouped"), F.bool_or((F.col("type") == "C") & F.col("is_universal")).alias("any_universal"))
    spec = spec.crossJoin(F.broadcast(grouped))
    test = F.col("type") == "T"
    rule = (
        F.when(~F.col("is_valid") & F.col("has_star"), "star_mixed").when(~F.col("is_valid"), "invalid_group").when(test & F.col("is_universal"), "star_on_test")
        .when(test & (F.size("groups") > 1), "several_groups").when(test & F.col("grouped") & (F.size("groups") == 0), "test_without_group")
    )
    broken = spec.withColumn("rule", rule).where("rule is not null").select("rule", F.col("experiment").alias("key"), F.col("grp").alias("detail"))
    member = spec.select("type", "any_universal", F.explode("groups").alias("n"))
    tests, controls = member.where(test).select("n", "any_universal").distinct(), member.where("type = 'C'").select("n").distinct()
    lonely = tests.where("not any_universal").join(controls, "n", "left_anti").select(F.lit("group_without_control").alias("rule"), F.col("n").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    idle = controls.join(tests, "n", "left_anti").select(F.lit("warning_control_without_test").alias("rule"), F.col("n").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return broken.union(lonely).union(idle)


def match_experiments(design: DataFrame, data: DataFrame) -> DataFrame:
    """Design names that the data lack (errors) and data names that the design lacks (warnings). data(experiment)."""
    named, have = design.select("experiment").distinct(), data.select("experiment").distinct()
    missing = named.join(have, "experiment", "left_anti").select(F.lit("experiment_not_in_data").alias("rule"), F.col("experiment").alias("key"), F.lit(None).cast("string").alias("detail"))
    extra = have.join(named, "experiment", "left_anti").select(F.lit("warning_experiment_not_in_design").alias("rule"), F.col("experiment").alias("key"), F.lit(None).cast("string").alias("detail"))
    return missing.union(extra)


def header_experiments(columns: Sequence[str], kind: str, quant: str = "intensity", metadata: Sequence[str] = ()) -> list[str]:
    """Experiment names in a wide header: after a prefix, not metadata, or before the longest suffix that fits."""
    if kind == "prefix":
        return [c.removeprefix(quant) for c in columns if c.startswith(quant)]
    if kind == "fragpipe":
        suffixes = sorted(FRAGPIPE_SUFFIX.values(), key=len, reverse=True)
        best = {c: next((s for s in suffixes if c.endswith(s)), None) for c in columns}
        return [c.removesuffix(s) for c, s in best.items() if s == FRAGPIPE_SUFFIX[quant]]
    return [c for c in columns if c not in metadata]


def validate_design(design: DataFrame, data: DataFrame) -> DataFrame:
    """All rules over a design and the data's experiments; an empty design is a violation of its own."""
    if missing := missing_columns(design, ["experiment", "type", "bait", "replicate"]):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = design if "grp" in design.columns else design.withColumn("grp", F.lit(None).cast("string"))
    parts = [required_not_blank(rows, ["experiment", "type", "bait", "replicate"]), valid_type(rows), valid_replicate(rows), duplicate_experiments(rows), group_rules(rows), match_experiments(rows, data)]
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty_design").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, parts, empty)


def data_experiments(data: DataFrame, kind: str, quant: str = "intensity") -> DataFrame:
    """(experiment) that a quantification file of `kind` holds, from its header or, for msstats, its rows."""
    if kind == "msstats":
        return data.where("LABEL = 'L'").select(F.trim("originalRUN").alias("experiment")).distinct()
    if kind == "maxquant":
        names = header_experiments(data.columns, "prefix", QUANT_PREFIX[quant])
    else:
        names = header_experiments(data.columns, "fragpipe", quant) if kind == "fragpipe" else header_experiments(data.columns, "plain", metadata=DIANN_METADATA)
    return data.sparkSession.createDataFrame([(n,) for n in names], "experiment string")


def validate_inputs(design: DataFrame, data: DataFrame, kind: str, quant: str = "intensity") -> DataFrame:
    """All rules for a design and the raw table of a quantification file: its columns, that it has rows, the design's own
    rules, and the experiments of both. Without the required columns the experiments are not compared."""
    found = lambda rule, keys: data.sparkSession.createDataFrame([(rule, k, None) for k in keys], "rule string, key string, detail string")
    missing = missing_columns(data, REQUIRED[kind])
    have = design.select("experiment") if missing else data_experiments(data, kind, quant)
    empty = data.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty_data").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return found("missing_column", missing).unionByName(empty).unionByName(validate_design(design, have))


def validate_name(names: DataFrame, used: DataFrame) -> DataFrame:
    """names(name): empty ones, ones with other characters than letters, digits and _, and ones in used(name)."""
    bad = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "empty_name").when(~F.col("name").rlike("^[A-Za-z0-9_]+$"), "invalid_name")
    broken = names.withColumn("rule", bad).where("rule is not null").select("rule", F.col("name").alias("key"), F.lit(None).cast("string").alias("detail"))
    return broken.union(names.join(used.select("name").distinct(), "name", "left_semi").select(F.lit("name_in_use"), "name", F.lit(None).cast("string")))
