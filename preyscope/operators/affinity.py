"""Exemplar clusters by message passing over a similarity edge list."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def affinity_clusters(similar: DataFrame, preference: float, damping: float = 0.5, rounds: int = 100, stable: int = 10) -> DataFrame:
    """(node, exemplar) of similar(a, b, similarity), both directions taken from each undirected edge.

    Responsibilities need a node's two best sums, availabilities the positive responsibilities of a target: a shuffle of
    the edges by node and one by target a round, checkpointed every few rounds. It ends when the exemplars stay the same for
    `stable` rounds, and warns if `rounds` run out before. Ties go to the smaller name; nodes without an exemplar among their edges stand for themselves.
    """
    both = similar.select("a", "b", "similarity").union(similar.select("b", "a", "similarity")).toDF("i", "k", "s")
    nodes = both.select("i").distinct()
    edge = both.groupBy("i", "k").agg(F.max("s").alias("s")).union(nodes.select("i", F.col("i").alias("k"), F.lit(float(preference)).alias("s")))
    state = cut(edge.withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)))
    last, same = None, 0
    for n in range(rounds):
        best = Window.partitionBy("i").orderBy(F.desc("v"), "k")
        rows = state.withColumn("v", F.col("a") + F.col("s")).withColumn("rank", F.row_number().over(best))
        by_node, by_target, mine = Window.partitionBy("i"), Window.partitionBy("k"), F.col("i") == F.col("k")
        second = F.coalesce(F.max(F.when(F.col("rank") > 1, F.col("v"))).over(by_node), F.lit(-1e30))
        new = F.col("s") - F.when(F.col("rank") == 1, second).otherwise(F.max("v").over(by_node))
        rows = rows.withColumn("r", damping * F.col("r") + (1 - damping) * F.greatest(F.lit(-1e30), new))
        total = F.sum(F.when(~mine, F.greatest(F.lit(0.0), "r")).otherwise(0.0)).over(by_target)
        rows = rows.withColumn("p", total).withColumn("self_r", F.max(F.when(mine, F.col("r"))).over(by_target))
        a = F.when(mine, F.col("p")).otherwise(F.least(F.lit(0.0), F.col("self_r") + F.col("p") - F.greatest(F.lit(0.0), "r")))
        state = rows.withColumn("a", damping * F.col("a") + (1 - damping) * a).select("i", "k", "s", "r", "a")
        if n % 5 == 4:
            state = cut(state)
            heads = tuple(state.where("i = k and r + a > 0").agg(F.count(F.lit(1)), F.sum(F.xxhash64("i").cast("decimal(38,0)"))).first())
            same = same + 5 if heads == last else 0
            last = heads
            if same >= stable and heads[0]:
                break
    else:
        warnings.warn(f"affinity_clusters: exemplars not stable for {stable} of {rounds} rounds", RuntimeWarning, stacklevel=2)
    heads = state.where("i = k and r + a > 0").select(F.col("i").alias("k"))
    choice = state.join(heads, "k").groupBy("i").agg(F.min_by("k", F.struct(-F.when(F.col("i") == F.col("k"), F.lit(1e30)).otherwise(F.col("s")), F.col("k"))).alias("exemplar"))
    assigned = nodes.join(choice, "i", "left").select("i", F.coalesce("exemplar", "i").alias("exemplar"))
    # Refine: the member with the greatest sum of similarities to its cluster becomes the exemplar.
    member = assigned.select(F.col("i").alias("x"), F.col("exemplar").alias("c"))
    inner = both.join(assigned, "i").join(member, both.k == member.x).where("exemplar = c").groupBy("exemplar", "k").agg(F.sum("s").alias("total"))
    centre = inner.groupBy("exemplar").agg(F.min_by("k", F.struct(-F.col("total"), F.col("k"))).alias("best"))
    return assigned.join(centre, "exemplar", "left").select(F.col("i").alias("node"), F.coalesce("best", "exemplar").alias("exemplar"))
