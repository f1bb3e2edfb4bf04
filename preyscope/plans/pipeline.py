"""From files to annotated scores in one lineage."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..functions.stats import tail_fdr
from ..operators import annotate, groups, impute, ingest, ontology, score_counts, score_intensity, scoring, wd
from ..operators.validate import validate_design, validate_inputs, validate_name
from ..sources import readers, writers
from . import stages

FORMATS = ("maxquant", "diann", "fragpipe", "msstats", "scoring")


def load(spark: SparkSession, kind: str, path: str, design: DataFrame, quant: str = "intensity") -> tuple[DataFrame, DataFrame]:
    """(inter(experiment, prey, value), preys(prey, gene)) of a quantification file; flagged proteins go.

    The names of the design's experiments (a row an IP) come to the driver to pick columns by.
    """
    if kind == "msstats":
        inter = ingest.msstats_clean(readers.read_msstats(spark, path)).join(F.broadcast(design.select("experiment")), "experiment", "left_semi")
        return inter, inter.select("prey", F.col("prey").alias("gene")).distinct()
    names = [r.experiment for r in design.select("experiment").collect()]
    wide = readers.read_protein_groups(spark, path, quant) if kind == "maxquant" else readers.read_diann(spark, path, names) if kind == "diann" else readers.read_fragpipe(spark, path, names, quant)
    wide = ingest.drop_flagged(wide)
    inter = ingest.melt_quant(wide, design, names).withColumn("prey", ingest.short_ids(F.col("prey"))).select("experiment", "prey", "value")
    return ingest.drop_zero(inter), ingest.name_preys(wide)


#: keep(name, build): the table of a step, which is used more than once.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


#: Steps that are read once here: kept where a stopped run goes on from them, else not written.
READ_ONCE = ("scored", "wd")


def _written(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return build() if name in READ_ONCE else stored(build())


def score(
    inter: DataFrame, design: DataFrame, preys: DataFrame, quant: str = "intensity", imputation: str | None = None, pi: float | None = None, iterations: int | None = None, keep: Keep = _written, **how: int
) -> DataFrame:
    """Posterior and wd scores, merged; `iterations` draws p-values instead of taking them exactly. A grouped design is
    scored for all its groups at once, with bfdr over them all. Steps go through `keep`, written tables if not said otherwise."""
    design = scoring.checked_design(design)
    given = inter
    inter = keep("interactions", lambda: ingest.drop_control_only(ingest.drop_zero(given), design))
    if imputation and quant != "spc":

        def imputed() -> DataFrame:
            share = pi if pi is not None else impute.estimate_pi(inter, design) if imputation == "mixture" else 0.0
            found = impute.impute(inter, design, preys, imputation, share).select("prey", "imputed_mu")
            return preys.drop("imputed_mu").join(found, "prey", "left")

        preys_used = keep("imputed", imputed)
    else:
        preys_used = preys
    run = score_counts.score if quant == "spc" else score_intensity.score
    if groups.is_grouped(design):
        members = groups.memberships(design)
        each = keep("scored_by_group", lambda: run(groups.scope_to_groups(inter, members), members, preys_used, by=["source_group"], rate=False, **how))
        scored = keep("scored", lambda: tail_fdr(each, "avg_p"))
    else:
        scored = keep("scored", lambda: run(inter, design, preys_used, **how))
    wds = keep("wd", lambda: wd.wd_scores(ingest.wd_table(inter, design), iterations=iterations))
    return annotate.merge_scores(scored, wds)


def raw_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A quantification file as it stands, for its validation."""
    return readers.read_text_table(spark, path, sep="," if kind == "msstats" else "\t", quote="'" if kind == "maxquant" else '"')


def annotation_tables(spark: SparkSession, files: dict[str, str], organism: str = "human") -> dict[str, DataFrame]:
    """Tables for annotate() from files by kind: proteins, atlas, complexes, and known or physical with multivalidated;
    an ontology (obo) gives the semantic values of its terms."""
    kinds = [k for k in files if k not in ("obo", "physical", "multivalidated")]
    tables = {k: cut(readers.read_annotations(spark, k, files[k])) for k in kinds}
    if "physical" in files:
        pairs = [readers.read_annotations(spark, k, files[k]) for k in ("physical", "multivalidated")]
        tables["known"] = cut(annotate.summarise_known(*pairs, annotate.ORGANISMS[organism]["taxon"]))
    if "obo" in files:
        tables["values"] = ontology.semantic_values(ontology.weigh(ontology.edges(cut(readers.read_obo(spark, files["obo"])))))
    return tables


def run(
    spark: SparkSession, kind: str, data: str, design_path: str, quant: str = "intensity", imputation: str | None = None, annotations: dict[str, DataFrame | str] | None = None,
    organism: str = "human", iterations: int | None = None, keep: Keep = _written, **how: int,
) -> DataFrame:
    """The whole pipeline for one of FORMATS: read, validate, impute, score, merge, and annotate where there are tables.

    `data` is a file, or for scoring inputs a folder with bait, prey and interaction. Annotations are tables, or paths
    of files that annotation_tables() reads; `iterations` draws p-values instead of taking them exactly.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    design = cut(readers.read_design(spark, design_path))
    if kind == "msstats" and imputation:
        warnings.warn("these data were imputed before", stacklevel=2)
    if kind == "scoring":
        _, preys, rows = readers.read_scoring_inputs(spark, f"{data}/bait", f"{data}/prey", f"{data}/interaction")
        inter = stored(rows.select("experiment", "prey", "value"))
        found = validate_design(design, cut(inter.select("experiment").distinct()))
    else:
        found = validate_inputs(design, raw_table(spark, kind, data), kind, quant)
    broken = found.where("not startswith(rule, 'warning')").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.key} {r.detail or ''}".strip() for r in broken))
    if kind != "scoring":
        inter, preys = load(spark, kind, data, design, quant)
    merged = score(inter, design, preys, quant, imputation, iterations=iterations, keep=keep, **how)
    if not annotations:
        return merged
    files = {k: v for k, v in annotations.items() if isinstance(v, str)}
    tables = {k: v for k, v in annotations.items() if not isinstance(v, str)} | annotation_tables(spark, files, organism)
    return annotate.annotate(keep("merged", lambda: merged), design, organism=organism, **tables)


def run_to(
    spark: SparkSession, folder: str, name: str, kind: str, data: str, design_path: str, quant: str = "intensity", imputation: str | None = None, annotations: dict[str, str] | None = None,
    organism: str = "human", iterations: int | None = None, **how: int,
) -> str:
    """run() into {folder}/{name}/results; returns that path.

    It holds scores (Parquet, and CSV as scores_csv), the wd table with the older tool's column names (wd_input) and, for a
    grouped design, groups (Parquet by source_group) and summary (JSON). A run that was stopped goes on from its last
    whole step if files and parameters are the same; when the results are in place nothing else is left. A name of other
    characters than letters, digits and _, or one in use by a finished run, is an error.
    """
    used = spark.createDataFrame([(name,)] if stages.finished(spark, f"{folder}/{name}") else [], "name string")
    if broken := validate_name(spark.createDataFrame([(name,)], "name string"), used).collect():
        raise ValueError(f"{broken[0].rule}: {name}")
    files = [design_path, *([f"{data}/{k}" for k in ("bait", "prey", "interaction")] if kind == "scoring" else [data]), *(annotations or {}).values()]
    asked = {"kind": kind, "quant": quant, "imputation": imputation, "organism": organism, "iterations": iterations, "annotations": sorted(annotations or {}), **how}
    staged = stages.StagedRun(spark, f"{folder}/{name}", asked, files)
    design = readers.read_design(spark, design_path)
    result = staged.stage("result", lambda: run(spark, kind, data, design_path, quant, imputation, annotations, organism, iterations, keep=staged.stage, **how))
    inter = staged.stage("interactions_used", lambda: _loaded(spark, kind, data, design, quant))

    def write(path: str) -> None:
        writers.write_table(result, f"{path}/scores")
        writers.write_table(result, f"{path}/scores_csv", "csv")
        writers.write_wd_input(ingest.wd_from_scoring_inputs(inter, design, inter.select("prey", "gene").distinct()), f"{path}/wd_input")
        if groups.is_grouped(design):
            writers.write_groups(result, groups.memberships(design), path)

    return staged.publish(write, {"rows": result.count(), "parameters": asked})


def _loaded(spark: SparkSession, kind: str, data: str, design: DataFrame, quant: str) -> DataFrame:
    """(experiment, prey, value, gene) of a quantification file or of scoring inputs."""
    if kind == "scoring":
        _, preys, inter = readers.read_scoring_inputs(spark, f"{data}/bait", f"{data}/prey", f"{data}/interaction")
    else:
        inter, preys = load(spark, kind, data, design, quant)
    return inter.select("experiment", "prey", "value").join(preys.select("prey", "gene"), "prey", "left")
