"""Semantic similarity of ontology terms and of genes by their terms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.lineage import Workspace, cut, stored, tasks_of

# Weights of the two kinds of edges, and the constant of the weight.
KIND_WEIGHT = {"isa": 0.4, "partof": 0.3}
OFFSET = 0.67

#: Buckets of the table that the closure of an ontology is appended to.
BUCKETS = 16


def edges(terms: DataFrame) -> DataFrame:
    """(namespace, child, parent, kind, n_children) of read_obo() rows; parents outside the namespace are ignored."""
    inside = terms.select("namespace", F.col("term").alias("parent")).distinct()
    rows = terms.where("parent is not null").select("namespace", F.col("term").alias("child"), "parent", "kind").distinct().join(inside, ["namespace", "parent"], "left_semi")
    counts = rows.groupBy("namespace", "parent").agg(F.count(F.lit(1)).alias("n_children"))
    return rows.join(counts, ["namespace", "parent"]).select("namespace", "child", "parent", "kind", "n_children")


def weigh(edge: DataFrame) -> DataFrame:
    """edges with weight: 1 / (0.67 + children of the parent) + the kind's weight."""
    kind = F.when(F.col("kind") == "isa", KIND_WEIGHT["isa"]).otherwise(KIND_WEIGHT["partof"])
    return edge.withColumn("weight", 1 / (OFFSET + F.col("n_children")) + kind)


def semantic_values(edge: DataFrame, most: int = 1000) -> DataFrame:
    """(namespace, term, ancestor, value): 1 for the term, for ancestors the best product of weights over all paths.

    Terms are taken when all their parents are done, so a term's values are the best of its parents', times the edge,
    and final: each row of the closure is written once, appended to a table in buckets of the term, whose parents' part
    the next round looks up. Rounds are as many as the ontology is deep. Edges from a term to itself count for nothing;
    a longer cycle is an error.
    """
    weighed = edge if "weight" in edge.columns else weigh(edge)
    spark, name, keys = edge.sparkSession, f"closure_{uuid.uuid4().hex}", ["namespace", "term"]
    with Workspace(spark) as ws:
        step = ws.keep(weighed.where("child <> parent").groupBy("namespace", "child", "parent").agg(F.max("weight").alias("weight")))
        terms = [weighed.select("namespace", F.col(c).alias("term")) for c in ("child", "parent")]
        left, waiting = ws.keep(terms[0].union(terms[1]).distinct()), step
        try:
            for n in range(most):
                ready = ws.keep(left.join(waiting.select("namespace", F.col("child").alias("term")), keys, "left_anti"))
                if ready.isEmpty() and not left.isEmpty():
                    raise ValueError("terms that are their own ancestors")
                rows = ready.select(*keys, F.col("term").alias("ancestor"), F.lit(1.0).alias("value"))
                if n:
                    asked = step.join(ready.withColumnRenamed("term", "child"), ["namespace", "child"], "left_semi")
                    found = asked.join(spark.table(name).select("namespace", F.col("term").alias("parent"), "ancestor", "value"), ["namespace", "parent"])
                    rows = rows.union(found.groupBy("namespace", F.col("child").alias("term"), "ancestor").agg(F.max(F.col("value") * F.col("weight")).alias("value")))
                rows.write.mode("append").bucketBy(BUCKETS, *keys).option("path", f"{ws.folder}/closure").format("parquet").saveAsTable(name)
                before, left = left, ws.keep(left.join(ready, keys, "left_anti"))
                ws.drop(before)
                if left.isEmpty():
                    return cut(spark.table(name))
                waiting = ws.keep(waiting.join(ready.withColumnRenamed("term", "parent"), ["namespace", "parent"], "left_anti").select(step.columns))
            raise RuntimeError(f"an ontology of more than {most} levels")
        finally:
            spark.sql(f"drop table if exists {name}")


def term_similarity(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with similarity by namespace: shared ancestors' values of both over all values of both; unknown or
    unrelated namespaces give no row."""
    total = values.groupBy("namespace", "term").agg(F.sum("value").alias("total"))
    want = pairs.select("a", "b").distinct()
    left = want.join(values.select("namespace", F.col("term").alias("a"), "ancestor", F.col("value").alias("va")), "a")
    right = values.select("namespace", F.col("term").alias("b"), "ancestor", F.col("value").alias("vb"))
    shared = left.join(right, ["namespace", "b", "ancestor"]).groupBy("namespace", "a", "b").agg(F.sum(F.col("va") + F.col("vb")).alias("common"))
    both = want.join(total.select("namespace", F.col("term").alias("a"), F.col("total").alias("ta")), "a").join(total.select("namespace", F.col("term").alias("b"), F.col("total").alias("tb")), ["namespace", "b"])
    return both.join(shared, ["namespace", "a", "b"], "left").select("namespace", "a", "b", (F.coalesce("common", F.lit(0.0)) / (F.col("ta") + F.col("tb"))).alias("similarity"))


def _few(df: DataFrame) -> DataFrame:
    """df written, and broadcast where it is used if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= stats.MOST_VALUES else df


def gene_similarity(values: DataFrame, genes: DataFrame, pairs: DataFrame, digits: int = 3) -> DataFrame:
    """pairs(a, b) of genes by namespace: the mean of every term's best match on the other side, both ways.

    genes(gene, term). A side without known terms gives no row. Similarities are computed once for each distinct pair
    of terms. Pairs move once, by b; where the genes a are few, as baits are, and so the pairs of terms, both are broadcast.
    """
    known = values.select("namespace", "term").distinct()
    own = stored(genes.join(known, "term").select("namespace", "gene", "term").distinct())
    want = stored(pairs.select("a", "b").distinct())
    tasks = tasks_of(want)
    right = want.repartition(tasks, "b").join(own.select("namespace", F.col("gene").alias("b"), F.col("term").alias("y")).repartition(tasks, "b"), "b")
    left = _few(own.select("namespace", F.col("gene").alias("a"), F.col("term").alias("x")).join(want.select("a").distinct(), "a", "left_semi"))
    met = right.select("namespace", "a", "y").distinct().join(left, ["namespace", "a"]).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    similar = _few(term_similarity(values, met).toDF("namespace", "x", "y", "s"))
    rows = right.join(left, ["namespace", "a"]).join(similar, ["namespace", "x", "y"])
    side = lambda term, one, two: F.struct(F.col(term).alias("t"), F.lit(one).alias("one"), F.lit(two).alias("two"))
    sides = rows.select("namespace", "a", "b", "s", F.inline(F.array(side("x", 1, 0), side("y", 0, 1))))
    # A term of both sides has one best match, the larger, and counts twice.
    best = sides.groupBy("namespace", "a", "b", "t").agg(F.max("s").alias("s"), (F.max("one") + F.max("two")).alias("n"))
    return best.groupBy("namespace", "a", "b").agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), digits).alias("similarity"))


def by_ontology(similar: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """One row for each pair with a column for each namespace {name: column}, and `first`: the first that is not null."""
    columns = [F.max(F.when(F.col("namespace") == n, F.col("similarity"))).alias(c) for n, c in namespaces.items()]
    rows = similar.groupBy("a", "b").agg(*columns)
    return rows.withColumn("first", F.coalesce(*namespaces.values()))


#: Genes of a list that are paired with all others in one task.
PAIRED = 1000


def all_pairs(genes: DataFrame, listed: DataFrame) -> DataFrame:
    """Every pair a < b of the genes in listed(gene) that have terms: a stated list, so its square is the result's size.

    Genes are dealt by hash to parts of about PAIRED, and each part meets each other by an equi-join.
    """
    own = cut(listed.join(genes.select("gene").distinct(), "gene", "left_semi").select("gene").distinct())
    parts = own.count() // PAIRED + 1
    part = F.pmod(F.xxhash64("gene"), F.lit(parts))
    a = own.select(F.col("gene").alias("a"), part.alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("right"))
    b = own.select(F.col("gene").alias("b"), part.alias("right"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("left"))
    return a.join(b, ["left", "right"]).where("a < b").select("a", "b")


def upper_median(similar: DataFrame) -> DataFrame:
    """The upper median similarity by namespace."""
    return stats.upper_median(similar, "similarity", ["namespace"]).withColumnRenamed("median", "preference")


def semantic_pairs(scored: DataFrame, terms: DataFrame, values: DataFrame) -> DataFrame:
    """(bait_id, first_id, similarity) in each namespace for scored pairs with terms on both sides."""
    pairs = scored.where("bait_id is not null").select(F.col("bait_id").alias("a"), F.col("first_id").alias("b")).distinct()
    return gene_similarity(values, terms, pairs).select("namespace", F.col("a").alias("bait_id"), F.col("b").alias("first_id"), "similarity")
