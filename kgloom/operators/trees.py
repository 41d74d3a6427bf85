"""Page trees in the graph: vectors that rise from children to parents, and links along the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.contraction import contract_forest
from kgloom.operators.similarity import normalised, pooled
from kgloom.session import cut


def raised_vectors(pages: DataFrame) -> DataFrame:
    """node and vector, missing vectors being the unit mean of the children's, from the deepest level up.

    ``pages`` has node, parent and vector (null where a page has no content). One join for each level that misses any;
    pages without content anywhere beneath stay null, as do those on or beneath a ring.
    """
    depth = contract_forest(pages, "node", "parent").select("node", "depth")
    rows = cut(pages.join(depth, "node").select("node", "parent", "depth", normalised("vector").alias("vector")))
    missing = [r.depth for r in rows.where("vector is null and depth >= 0").select("depth").distinct().orderBy(F.desc("depth")).collect()]  # one row for each level
    done = rows.where("vector is not null")
    for level in missing:
        below = done.where(F.col("depth") == level + 1).select("parent", "vector")
        means = pooled(below.where("parent is not null"), ["parent"], "vector", unit_length=True).select(F.col("parent").alias("node"), F.col("vector").alias("mean"))
        fresh = rows.where((F.col("depth") == level) & F.col("vector").isNull()).join(means, "node").select("node", "parent", "depth", F.col("mean").alias("vector"))
        done = cut(done.unionByName(fresh))
    return rows.select("node").join(done.select("node", "vector"), "node", "left")


def tree_edges(tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, weight and type of links from parent to child that ``edges`` lacks in either direction.

    ``tree`` has id and parent_id, ``nodes`` id (bigint), orig_id (``{prefix}_{page id}``) and cluster_id.
    """
    named = nodes.select(F.col("id").alias("node"), F.regexp_replace("orig_id", "^[^_]*_", "").alias("page"), "cluster_id")
    a = named.select(F.col("page").alias("parent_id"), F.col("node").alias("source"), F.col("cluster_id").alias("a"))
    b = named.select(F.col("page").alias("id"), F.col("node").alias("target"), F.col("cluster_id").alias("b"))
    links = tree.join(a, "parent_id").join(b, "id").where("source <> target")
    key = [F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")]
    fresh = links.select("source", "target", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("is_intra"), *key).dropDuplicates(["x", "y"])
    return fresh.join(edges.select(*key).distinct(), ["x", "y"], "left_anti").select("source", "target", F.lit(1.0).alias("weight"), F.lit("hierarchical").alias("type"), "is_intra")
