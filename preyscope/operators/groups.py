"""Paired-control groups: one membership table, so that all groups are scored in the same jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_spec


def is_grouped(design: DataFrame) -> bool:
    g = group_spec(F.col("grp"))
    return not design.where(g["is_universal"] | (F.size(g["groups"]) > 0)).isEmpty()


def list_groups(design: DataFrame) -> DataFrame:
    """(source_group) of test rows."""
    return design.where("type = 'T'").select(F.explode(group_spec(F.col("grp"))["groups"]).alias("source_group")).distinct()


def memberships(design: DataFrame) -> DataFrame:
    """The design with source_group: tests and controls in each group they name, controls with * in all groups."""
    rows = design.withColumn("g", group_spec(F.col("grp")))
    groups = F.broadcast(list_groups(design))
    named = rows.select(*design.columns, F.explode("g.groups").alias("source_group")).join(groups, "source_group", "left_semi")
    universal = rows.where("type = 'C' and g.is_universal").select(*design.columns).crossJoin(groups)
    return named.select(*design.columns, "source_group").unionByName(universal).distinct()


def scope_to_groups(inter: DataFrame, members: DataFrame) -> DataFrame:
    """Interaction rows in each group their experiment belongs to; preys stay common to all groups."""
    return inter.join(F.broadcast(members.select("experiment", "source_group")), "experiment")
