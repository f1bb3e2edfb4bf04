"""What the text operators share: the documents table, let-bindings, checkpoints and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import Workspace, cut, shared_folder

#: Java and Python spelling of the contract's word: anything but ASCII white space.
BLANKS = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it.

    A plain reference inside a lambda can be inlined by the optimizer and is then evaluated for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, unlike lower()."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, reread: compressed, and it outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60, ws: Workspace | None = None) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Each round alternates two star steps (every node hands its smallest neighbour to its larger, then to its smaller
    neighbours), which needs a number of rounds logarithmic in the longest path. All steps are min-aggregates and
    equi-joins on the node; a round ends in a checkpoint, and only the number of changed edges reaches the driver.
    Self-edges only declare a node; nulls are dropped. In a workspace a round's table goes when the next one is there.
    """
    keep = ws.keep if ws else cut
    edges = edges.select("a", "b").where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    pairs = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        before, pairs = pairs, keep(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        if ws:
            ws.drop(before)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not stable after {max_rounds} rounds")
    return nodes.join(pairs.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
