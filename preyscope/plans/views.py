"""Proteomics-shaped views over the order tables, for queries that run on the given data.

Suppliers act as baits (ten of them, the last two as controls), orders as replicates and parts as preys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment, bait, bait_id, type, replicate, grp: the bait and replicate pairs that the order lines hold."""
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("b"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("r")).distinct()
    grp = F.when(F.col("b") == 8, "*").when(F.col("b") == 9, "1,2").otherwise((F.col("b") % 2 + 1).cast("string"))
    return pairs.select(
        F.expr("concat('E', b, '_', r)").alias("experiment"), F.expr("concat('B', b)").alias("bait"), F.expr("concat('P', b)").alias("bait_id"),
        F.when(F.col("b") >= 8, "C").otherwise("T").alias("type"), F.col("r").alias("replicate"), grp.alias("grp"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment, bait, prey, spc, intensity; only cells with a value. Lines are added up by numbers, names come last."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("b"), (F.col("l_orderkey") % 3 + 1).alias("r"), "l_partkey", "l_quantity", "l_extendedprice")
    # Without a bait there is no experiment, whatever the replicate.
    cells = lines.groupBy("b", F.when(F.col("b").isNotNull(), F.col("r")).alias("r"), "l_partkey").agg(F.sum("l_quantity").alias("spc"), F.round(F.sum("l_extendedprice"), 2).alias("intensity"))
    names = [F.expr("concat('E', b, '_', r)").alias("experiment"), F.expr("concat('B', b)").alias("bait"), F.expr("concat('P', l_partkey)").alias("prey")]
    return cells.select(*names, "spc", "intensity")


def preys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prey, gene, features (`;` list)."""
    part = table(spark, sf_dir, "part")
    gene = F.when(F.col("p_partkey") < 10, F.expr("concat('B', p_partkey)")).otherwise(F.expr("concat('G', p_partkey)"))
    features = F.concat_ws("; ", "p_type", "p_brand", F.translate("p_name", " ", ";"))
    return part.select(F.expr("concat('P', p_partkey)").alias("prey"), gene.alias("gene"), features.alias("features"))


#: Lines of orders whose pairs one task counts.
LINES_OF_A_TASK = 250_000

#: Orders with a wanted part that are broadcast, some 50 bytes each.
MOST_ORDERS = 200_000


def _part_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(a, b of each order's parts, a < b, part numbers; number of tasks to count them in).

    An order has a few lines at most, so the pairs within orders grow with the lines, and so do the tasks.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_OF_A_TASK + 1)
    parts = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    first = parts.select("p", F.posexplode("p").alias("i", "a"))
    return first.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")), tasks


def known_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, n: pairs of preys in common orders, each in one direction, with the number of orders."""
    pairs, tasks = _part_pairs(spark, sf_dir)
    counts = pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.expr("concat('P', a)").alias("a"), F.expr("concat('P', b)").alias("b"), "n")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pa, pb, n: directed pairs of parts in common orders, with the number of orders."""
    return known_once(spark, sf_dir).select(F.inline(F.array(F.struct(F.col("a").alias("pa"), F.col("b").alias("pb")), F.struct(F.col("b").alias("pa"), F.col("a").alias("pb")))), "n")


def known_of(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The rows of known() whose pb is one of ids(pb), a table to broadcast; other pairs are not counted at all.

    The orders that hold these parts come first, then all lines are held against them.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("concat('P', l_partkey)").alias("pa"))
    orders = cut(lines.withColumnRenamed("pa", "pb").join(F.broadcast(ids.distinct()), "pb", "left_semi").distinct())
    orders = F.broadcast(orders) if orders.count() <= MOST_ORDERS else orders
    return lines.join(orders, "l_orderkey").where("pa <> pb").distinct().groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n"))


def term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent, kind: types and brands as terms of a small ontology."""
    part = table(spark, sf_dir, "part")
    tb = part.select("p_type", "p_brand").distinct()
    child = F.concat(F.lit("TB:"), "p_type", F.lit("|"), "p_brand")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    root = lambda df, c: df.select(c.alias("child"), F.lit("ROOT").alias("parent"), F.lit("isa").alias("kind"))
    return (
        tb.select(child.alias("child"), F.concat(F.lit("T:"), "p_type").alias("parent"), F.lit("isa").alias("kind"))
        .union(tb.select(child, F.concat(F.lit("B:"), "p_brand"), F.lit("partof")))
        .union(root(tb.select("p_type").distinct(), F.concat(F.lit("T:"), "p_type")))
        .union(root(tb.select("p_brand").distinct(), F.concat(F.lit("B:"), "p_brand")))
        .union(root(words, F.concat(F.lit("W:"), "w")))
    )


def prey_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prey, term."""
    part = table(spark, sf_dir, "part")
    terms = F.array_union(F.array(F.concat(F.lit("TB:"), "p_type", F.lit("|"), "p_brand")), F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("W:"), w)))
    return part.select(F.expr("concat('P', p_partkey)").alias("prey"), F.explode(terms).alias("term"))


#: The same views for the oracle.
SQL = """
ed as (select distinct 'E' || b || '_' || r experiment, 'B' || b bait, 'P' || b bait_id, case when b >= 8 then 'C' else 'T' end "type", r replicate,
  case when b = 8 then '*' when b = 9 then '1,2' else (b % 2 + 1)::varchar end grp from (select (l_suppkey % 10)::int b, (l_orderkey % 3 + 1)::int r from lineitem)),
inter as (select 'E' || l_suppkey % 10 || '_' || (l_orderkey % 3 + 1) experiment, 'B' || l_suppkey % 10 bait, 'P' || l_partkey prey, sum(l_quantity) spc,
  round(sum(l_extendedprice), 2) intensity from lineitem group by 1, 2, 3),
prey as (select 'P' || p_partkey prey, case when p_partkey < 10 then 'B' || p_partkey else 'G' || p_partkey end gene,
  p_type || '; ' || p_brand || '; ' || replace(p_name, ' ', ';') features from part),
known as (select 'P' || a.l_partkey pa, 'P' || b.l_partkey pb, count(distinct a.l_orderkey) n from lineitem a join lineitem b using (l_orderkey)
  where a.l_partkey <> b.l_partkey group by 1, 2),
tb as (select distinct p_type, p_brand from part),
term_edges as (select 'TB:' || p_type || '|' || p_brand child, 'T:' || p_type parent, 'isa' kind from tb union all select 'TB:' || p_type || '|' || p_brand, 'B:' || p_brand, 'partof' from tb
  union all select distinct 'T:' || p_type, 'ROOT', 'isa' from tb union all select distinct 'B:' || p_brand, 'ROOT', 'isa' from tb
  union all select distinct 'W:' || w, 'ROOT', 'isa' from (select unnest(string_split(p_name, ' ')) w from part)),
prey_terms as (select distinct 'P' || p_partkey prey, unnest(list_concat(['TB:' || p_type || '|' || p_brand], list_transform(string_split(p_name, ' '), lambda w: 'W:' || w))) term from part)
"""
