"""Looking up nodes: by group, by id, for the ends of edges and for search hits; lists as comma-separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.projections import looked_up


def nodes_of_groups(nodes: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """Nodes whose ``group`` is one of ``groups``; null belongs to none."""
    return nodes.join(groups.select(group).distinct(), group, "left_semi")


def edge_ends(edges: DataFrame, nodes: DataFrame, take: Sequence[str]) -> DataFrame:
    """Edges whose two ends are nodes (node), with source_{column} and target_{column} for each of ``take``; others are left out."""
    out = edges
    for side in ("source", "target"):
        out = out.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in take]), side)
    return out.select(*edges.columns, *[f"{side}_{c}" for side in ("source", "target") for c in take])


def hits_with_nodes(hits: DataFrame, nodes: DataFrame, take: Sequence[str]) -> DataFrame:
    """Search hits (orig_id, node_id) with ``take`` of their node, by orig_id, else by number; hits without a node are left out."""
    known = looked_up(hits, nodes.withColumn("_known", F.lit(True)), "orig_id", "node_id", [*take, "_known"])
    return known.where("_known").drop("_known")


def comma_list(value: Column | str) -> Column:
    """An array as text, items joined by commas; null for null."""
    return F.array_join(F.col(value) if isinstance(value, str) else value, ",")


def from_comma_list(value: Column | str) -> Column:
    """The trimmed items of comma-separated text that are not blank; an empty array for null."""
    text = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
