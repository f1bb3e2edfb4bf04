"""Readers of protein quantification files, as long or wide DataFrames with fixed column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "ISO-8859-1")

# Column names and prefixes of the file formats.
DESIGN_COLUMNS = ("Experiment Name", "Type", "Bait", "Replicate")
QUANT_PREFIX = {"intensity": "Intensity ", "lfq": "LFQ intensity ", "spc": "MS/MS count "}
FRAGPIPE_SUFFIX = {"intensity": " Intensity", "lfq": " MaxLFQ Intensity", "spc": " Total Spectral Count"}
MAXQUANT_COLUMNS = {
    "Majority protein IDs": "prey", "Protein names": "description", "Gene names": "gene", "Sequence length": "length",
    "Reverse": "reverse", "Only identified by site": "only_by_site", "Potential contaminant": "contaminant",
}
ANNOTATION_FORMATS = {
    "proteins": {"sep": "\t"}, "atlas": {"sep": "\t"}, "complexes": {"sep": "\t", "encoding": "ISO-8859-1"},
    "physical": {"sep": "\t"}, "multivalidated": {"sep": "\t"}, "known": {"sep": ","},
}
_PAIR_COLUMNS = {
    "Organism ID Interactor A": "organism_a", "Organism ID Interactor B": "organism_b", "Experimental System Type": "system_type", "Experimental System": "system",
    "Author": "author", "Publication Source": "source", "SWISS-PROT Accessions Interactor A": "a", "SWISS-PROT Accessions Interactor B": "b",
}
ANNOTATION_COLUMNS = {
    "proteins": {
        "Entry": "entry", "Gene Names": "names", "Subcellular location [CC]": "location", "Gene Ontology (cellular component)": "go_cellular",
        "Gene Ontology (biological process)": "go_process", "Gene Ontology (molecular function)": "go_function", "Motif": "motif", "Region": "region",
        "Repeat": "repeat", "Compositional bias": "bias", "Domain [FT]": "domain",
    },
    "atlas": {"Gene name": "gene", "Main location": "main_location"},
    "complexes": {"complex_name": "complex", "subunits_uniprot_id": "subunits"},
    "physical": _PAIR_COLUMNS, "multivalidated": _PAIR_COLUMNS,
    "known": {
        "SWISS-PROT Accessions Interactor A": "a", "SWISS-PROT Accessions Interactor B": "b", "Experimental System": "systems", "Author": "authors",
        "Publication Source": "sources", "Multivalidated": "multivalidated",
    },
}
MSSTATS_COLUMNS = ("Protein", "originalRUN", "GROUP", "SUBJECT", "LABEL", "LogIntensities")
REQUIRED = {"maxquant": tuple(MAXQUANT_COLUMNS), "diann": ("Protein.Group", "Genes"), "fragpipe": ("Protein", "Protein ID", "Gene", "Protein Length"), "msstats": MSSTATS_COLUMNS}


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the header lacks, in their order."""
    return [c for c in required if c not in df.columns]


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A file with a header, all columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, **options)
    return df.toDF(*[c.lstrip("﻿").removeprefix("ï»¿") for c in df.columns])


def _bad_utf8(df: DataFrame) -> bool:
    """Whether any value holds the replacement character that wrong bytes turn into."""
    return not df.where(F.exists(F.array(*[F.col(f"`{c}`").contains("�") for c in df.columns]), lambda x: F.coalesce(x, F.lit(False)))).isEmpty()


def read_text_table(spark: SparkSession, path: str, encoding: str | None = None, **options: str) -> DataFrame:
    """A file with a header in UTF-8 with or without a mark, else Latin-1, which takes any byte; any other encoding has
    to be named. Of those that Spark has no reader for, windows-1252 is Latin-1 with other signs at 0x80 to 0x9F."""
    if encoding == "windows-1252":
        df = _csv(spark, path, encoding=ENCODINGS[1], **options)
        own = {chr(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
        return df.select(*[F.translate(F.col(f"`{c}`"), "".join(own), "".join(own.values())).alias(c.translate(str.maketrans(own))) for c in df.columns])
    df = _csv(spark, path, encoding=encoding or ENCODINGS[0], **options)
    return _csv(spark, path, encoding=ENCODINGS[1], **options) if not encoding and df.columns and _bad_utf8(df) else df


def read_design(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """experiment, type, bait, bait_id, replicate, grp (strings)."""
    df = read_text_table(spark, path, encoding)
    check_columns(df, DESIGN_COLUMNS)
    optional = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.select(
        F.trim("Experiment Name").alias("experiment"), F.trim("Type").alias("type"), F.trim("Bait").alias("bait"),
        F.trim(optional("Bait ID")).alias("bait_id"), F.trim("Replicate").alias("replicate"), F.trim(optional("Group")).alias("grp"),
    )


def read_protein_groups(spark: SparkSession, path: str, quant: str = "intensity") -> DataFrame:
    """A wide MaxQuant table: metadata by short name, and the quant columns by experiment name (doubles)."""
    df = check_columns(_csv(spark, path, sep="\t", quote="'"), [*MAXQUANT_COLUMNS])
    prefix = QUANT_PREFIX[quant]
    quants = [c for c in df.columns if c.startswith(prefix)]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in MAXQUANT_COLUMNS.items()], *[F.col(f"`{c}`").cast("double").alias(c.removeprefix(prefix)) for c in quants])


def _wide(df: DataFrame, meta: dict[str, Column], quants: dict[str, str]) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in meta.items()], *[F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(n) for c, n in quants.items()])


def _no_flags() -> dict[str, Column]:
    return {c: F.lit("-") for c in ("reverse", "only_by_site")}


def read_diann(spark: SparkSession, path: str, experiments: Sequence[str]) -> DataFrame:
    """A wide DIA-NN matrix in the same shape: run columns are named by experiment, missing is 0, length is 1."""
    df = check_columns(_csv(spark, path, sep="\t"), ["Protein.Group", "Genes"])
    description = F.col("`First.Protein.Description`") if "First.Protein.Description" in df.columns else F.lit(None).cast("string")
    meta = {"prey": F.col("`Protein.Group`"), "description": description, "gene": F.col("Genes"), "length": F.lit("1"), **_no_flags(), "contaminant": F.lit("-")}
    return _wide(df, meta, {c: c for c in df.columns if c in {*experiments}})


def read_fragpipe(spark: SparkSession, path: str, experiments: Sequence[str], quant: str = "intensity") -> DataFrame:
    """A wide FragPipe table in the same shape; proteins that begin with contam_ are contaminants."""
    df = check_columns(_csv(spark, path, sep="\t"), ["Protein", "Protein ID", "Gene", "Protein Length"])
    suffix = FRAGPIPE_SUFFIX[quant]
    found = {c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix) and not (quant == "intensity" and c.endswith(FRAGPIPE_SUFFIX["lfq"]))}
    contaminant = F.when(F.startswith(F.col("Protein"), F.lit("contam_")), "+").otherwise("-")
    description = F.col("Description") if "Description" in df.columns else F.lit(None).cast("string")
    meta = {"prey": F.col("`Protein ID`"), "description": description, "gene": F.col("Gene"), "length": F.col("`Protein Length`"), **_no_flags(), "contaminant": contaminant}
    return _wide(df, meta, {c: n for c, n in found.items() if n in {*experiments}})


def read_msstats(spark: SparkSession, path: str) -> DataFrame:
    """prey, label, log_intensity (log2), experiment of a protein-level file."""
    df = check_columns(read_text_table(spark, path), ["Protein", "LABEL", "LogIntensities", "originalRUN"])
    return df.select(F.col("Protein").alias("prey"), F.col("LABEL").alias("label"), F.col("LogIntensities").try_cast("double").alias("log_intensity"), F.col("originalRUN").alias("experiment"))


def read_scoring_inputs(spark: SparkSession, baits: str, preys: str, interactions: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three TSVs without headers: (experiment, bait, type), (prey, gene[, imputed_mu]), (experiment, bait, prey, value, ordinal).

    A prey file of three columns whose second is a number is (prey, length, gene).
    """
    tsv = lambda path: spark.read.csv(path, sep="\t", inferSchema=False)
    b = tsv(baits).toDF("experiment", "bait", "type")
    p = tsv(preys)
    if len(p.columns) == 2:
        p = p.toDF("prey", "gene")
    elif p.where(F.col("_c1").isNotNull() & F.col("_c1").try_cast("double").isNull()).isEmpty():
        p = p.select(F.col("_c0").alias("prey"), F.col("_c2").alias("gene"), F.col("_c1").cast("double").alias("length"))
    else:
        p = p.select(F.col("_c0").alias("prey"), F.col("_c1").alias("gene"), F.col("_c2").try_cast("double").alias("imputed_mu"))
    i = tsv(interactions)
    i = i.select(*i.columns, file_order().alias("ordinal")).toDF("experiment", "bait", "prey", "value", "ordinal")
    return b, p, i.withColumn("value", F.col("value").cast("double"))


def file_order() -> Column:
    """A number by which rows sort as they stand in their file, and files by name: name and start of the block read,
    then the row's place in what a task reads of it."""
    meta = F.col("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))


def read_annotations(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """proteins, atlas, complexes (Latin-1), physical and multivalidated pairs, or known (their summary), with short
    column names and an ordinal that sorts as the rows stand in the file. Columns that the file lacks are left out."""
    names = ANNOTATION_COLUMNS[kind]
    raw = spark.read.csv(path, header=True, **ANNOTATION_FORMATS[kind])
    named = {c.lstrip("\ufeff").removeprefix("ï»¿"): c for c in raw.columns}
    rows = raw.select(*[F.col(f"`{named[c]}`").alias(n) for c, n in names.items() if c in named], file_order().alias("ordinal"))
    numbers = {c: F.col(c).try_cast("int") for c in ("organism_a", "organism_b") if c in rows.columns}
    flags = {"multivalidated": F.coalesce(F.lower("multivalidated") == "true", F.lit(False))} if "multivalidated" in rows.columns else {}
    return rows.withColumns(numbers | flags)


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(term, namespace, parent, kind) of an ontology file, one stanza a row while reading; obsolete terms are dropped.

    Terms without a parent have one row with null parent and kind.
    """
    stanzas = spark.read.text(path, lineSep="\n\n").where(F.col("value").rlike(r"(?m)^\[Term\]"))
    one = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}: *(\S+)", 1), F.lit(""))
    every = lambda pattern, kind: F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), lambda p: F.struct(p.alias("parent"), F.lit(kind).alias("kind")))
    parents = F.concat(every(r"(?m)^is_a: *(\S+)", "isa"), every(r"(?m)^relationship: *part_of +(\S+)", "partof"))
    live = stanzas.where(~F.col("value").rlike(r"(?m)^is_obsolete: *true")).select(one("id").alias("term"), one("namespace").alias("namespace"), parents.alias("p"))
    return live.select("term", "namespace", F.explode_outer("p").alias("p")).select("term", "namespace", "p.parent", "p.kind")
