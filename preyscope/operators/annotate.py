"""Merging scores with annotation and known interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import clean_go, feature_notes, first_item, first_location, go_ids
from . import ontology
from .scoring import MOST_EXPERIMENTS

# Taxonomy ids, and whether there are an atlas of locations and a table of complexes.
ORGANISMS = {
    "human": {"taxon": 9606, "human_tables": True},
    "mouse": {"taxon": 10090, "human_tables": False},
    "yeast": {"taxon": 559292, "human_tables": False},
}
COMPONENT = "cellular_component"
GO_COLUMNS = ("go_cellular", "go_process", "go_function")
NOTE_COLUMNS = ("motif", "region", "repeat", "bias", "domain")


def merge_scores(posterior: DataFrame, wd: DataFrame) -> DataFrame:
    """posterior(prey, bait, ...) with the wd columns of (experiment = bait, prey); boosted_by goes, source_group is
    always there."""
    side = wd.select(F.col("experiment").alias("bait"), "prey", "avg_count", "entropy", "z", "wd", "p_value", "wd_fdr")
    rows = posterior.drop("boosted_by").join(side, ["bait", "prey"], "left")
    return rows if "source_group" in rows.columns else rows.withColumn("source_group", F.lit(None).cast("int"))


def first_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("first_id", first_item(F.col("prey"))).withColumn("first_gene", first_item(F.col("gene")))


def join_proteins(df: DataFrame, proteins: DataFrame) -> DataFrame:
    """df(first_id) with the columns of proteins(entry, ...)."""
    return df.join(proteins.withColumnRenamed("entry", "first_id"), "first_id", "left")


def clean_proteins(proteins: DataFrame) -> DataFrame:
    """proteins with the first location (null if it occurs once in the table), plain ontology names and feature notes."""
    rows = proteins.withColumn("location", first_location(F.col("location")))
    rows = null_singletons(rows, "location")
    go = {c: clean_go(F.col(c)) for c in GO_COLUMNS if c in rows.columns}
    notes = {c: feature_notes(F.col(c)) for c in NOTE_COLUMNS if c in rows.columns}
    return rows.withColumns({"go_ids": F.concat(*[go_ids(F.col(c)) for c in go])} if go else {}).withColumns(go | notes)


def null_singletons(df: DataFrame, column: str) -> DataFrame:
    """Values that occur in a single row become null."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return df.join(counts, F.col(column) == F.col("_v"), "left").withColumn(column, F.col("_v")).drop("_v", "_n")


def match_by_synonym(genes: DataFrame, proteins: DataFrame, atlas: DataFrame) -> DataFrame:
    """(gene, atlas_gene): the gene itself if the atlas has it; else of the first protein row (ordinal) whose names list
    it, the first name that the atlas has. proteins(names, ordinal) with blank-separated names."""
    have = atlas.select(F.col("gene").alias("atlas_gene")).distinct()
    own = genes.select("gene").distinct()
    direct = own.join(have, own.gene == have.atlas_gene).select("gene", "atlas_gene")
    rest = own.join(have, own.gene == have.atlas_gene, "left_anti")
    names = proteins.select("ordinal", F.posexplode(F.split("names", " +")).alias("pos", "name"))
    first = rest.join(names.select("ordinal", F.col("name").alias("gene")), "gene").groupBy("gene").agg(F.min("ordinal").alias("ordinal"))
    found = first.join(names, "ordinal").join(have, F.col("name") == F.col("atlas_gene"))
    other = found.groupBy("gene").agg(F.min_by("atlas_gene", "pos").alias("atlas_gene"))
    return own.join(direct.union(other), "gene", "left")


def prey_is_bait(df: DataFrame, bait_ids: DataFrame) -> DataFrame:
    """df with prey_is_bait: any of the prey's ids is a bait id. bait_ids(bait_id) has one row a bait."""
    ids = F.broadcast(bait_ids.select("bait_id").distinct())
    hits = cut(df.select("prey", F.explode(F.split("prey", ";")).alias("bait_id")).join(ids, "bait_id", "left_semi").select("prey", F.lit(True).alias("prey_is_bait")).distinct())
    hits = F.broadcast(hits) if hits.count() <= MOST_EXPERIMENTS else hits
    return df.join(hits, "prey", "left").withColumn("prey_is_bait", F.coalesce("prey_is_bait", F.lit(False)))


def self_interaction(df: DataFrame) -> DataFrame:
    """df(prey, bait_id) with self_interaction: the prey's ids hold the row's own bait."""
    return df.withColumn("self_interaction", F.coalesce(F.array_contains(F.split("prey", ";"), F.col("bait_id")), F.lit(False)))


def complex_membership(df: DataFrame, complexes: DataFrame) -> DataFrame:
    """df(prey) with complex: of the first prey id in any complex, the first complex in file order.

    complexes(complex, subunits, ordinal); of rows that repeat a name the last one's subunits count, in the place of
    the first.
    """
    last = complexes.groupBy("complex").agg(F.max_by("subunits", "ordinal").alias("subunits"), F.min("ordinal").alias("place"))
    members = last.select("complex", "place", F.explode(F.split("subunits", ";")).alias("id"))
    ids = df.select("prey").distinct().select("prey", F.posexplode(F.split("prey", ";")).alias("pos", "id"))
    best = ids.join(members, "id").groupBy("prey").agg(F.min_by("complex", F.struct("pos", "place")).alias("complex"))
    return df.join(best, "prey", "left")


def summarise_known(physical: DataFrame, multivalidated: DataFrame, organism: int) -> DataFrame:
    """Known pairs of an organism by directed (a, b): systems, authors and sources in file order, and multivalidated.

    physical(organism_a, organism_b, system_type, system, author, source, a, b, ordinal); multivalidated(a, b, ...).
    """
    within = lambda df: df.where((F.col("organism_a") == organism) & (F.col("organism_b") == organism) & (F.col("system_type") == "physical"))
    mv = within(multivalidated).select("a", "b", F.lit(True).alias("mv")).distinct()
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce(F.col(c), F.lit("")).alias("v")))), lambda x: x["v"]), "; ").alias(f"{c}s")
    rows = within(physical).where("a is not null and b is not null").join(mv, ["a", "b"], "left")
    return rows.groupBy("a", "b").agg(listed("system"), listed("author"), listed("source"), F.coalesce(F.bool_or("mv"), F.lit(False)).alias("multivalidated"))


def join_known(df: DataFrame, known: DataFrame, bait_ids: DataFrame | None = None) -> DataFrame:
    """df(first_id, bait_id) with the known pair (a = first_id, b = bait_id), directed; no pair gives false flags. With the
    design's bait_ids(bait_id) known pairs of others are not shuffled."""
    if bait_ids is not None:
        known = known.join(F.broadcast(bait_ids.select(F.col("bait_id").alias("b")).distinct()), "b", "left_semi")
    side = known.select(F.col("a").alias("first_id"), F.col("b").alias("bait_id"), *[c for c in known.columns if c not in ("a", "b")], F.lit(True).alias("is_known"))
    rows = df.join(side, ["first_id", "bait_id"], "left")
    return rows.withColumn("is_known", F.coalesce("is_known", F.lit(False))).withColumn("multivalidated", F.coalesce("multivalidated", F.lit(False)))


def component_terms(proteins: DataFrame) -> DataFrame:
    """(gene, term): the cellular-component terms of each protein, by its entry."""
    return proteins.select(F.col("entry").alias("gene"), F.explode(go_ids(F.col("go_cellular"))).alias("term")).distinct()


def component_similarity(rows: DataFrame, proteins: DataFrame, values: DataFrame) -> DataFrame:
    """(bait_id, first_id, similarity) of rows by their cellular-component terms; values are ontology.semantic_values()."""
    found = ontology.semantic_pairs(rows, component_terms(proteins), values.where(F.col("namespace") == COMPONENT))
    return found.drop("namespace")


def annotate(
    merged: DataFrame, design: DataFrame, proteins: DataFrame, known: DataFrame, atlas: DataFrame | None = None, complexes: DataFrame | None = None,
    similarity: DataFrame | None = None, values: DataFrame | None = None, organism: str = "human",
) -> DataFrame:
    """A written table merged(prey, gene, bait, ...) with protein columns, flags, known pairs; atlas and complexes where they are given
    (human data alone), and the similarity of bait and prey: a table (bait_id, first_id, similarity), or from the
    semantic values of the ontology and the proteins' cellular components."""
    ids = cut(design.select("bait", "bait_id").distinct())
    rows = first_ids(merged.join(F.broadcast(ids), "bait", "left"))
    if similarity is None and values is not None and "go_cellular" in proteins.columns:
        rows = cut(rows)
        similarity = component_similarity(rows, proteins, values)
    rows = join_known(self_interaction(prey_is_bait(join_proteins(rows, clean_proteins(proteins)), ids)), known, ids)
    human = ORGANISMS[organism]["human_tables"]
    if atlas is not None and human:
        rows = cut(rows)
        named = match_by_synonym(rows.select(F.col("first_gene").alias("gene")), proteins, atlas).withColumnRenamed("gene", "first_gene")
        places = atlas.groupBy(F.col("gene").alias("atlas_gene")).agg(F.min("main_location").alias("atlas_location"))
        rows = rows.join(named.join(places, "atlas_gene", "left"), "first_gene", "left")
    if complexes is not None and human:
        rows = complex_membership(cut(rows), complexes)
    return rows.join(similarity, ["bait_id", "first_id"], "left") if similarity is not None else rows
