"""Inserting a batch of new items into an existing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.assignment import MISC, by_words, guarded
from kgloom.operators.entities import upserted
from kgloom.operators.similarity import dot, norm, similar_pairs
from kgloom.session import cut


def inserted(items: DataFrame, vectors: DataFrame, clusters: DataFrame, threshold: float = 0.6, k: int = 5) -> dict[str, DataFrame]:
    """The tables nodes, edges and vectors after a batch.

    ``items`` has item (bigint), pos (their order), keywords and vector, ``vectors`` item, cluster_id, vector and version,
    ``clusters`` cluster_id, name, description, themes and, optionally, vector. An item goes to the cluster that
    shares most with its keywords; one that would be new to the nearest by words and vectors, else to a cluster for such
    items. It is linked to its ``k`` most similar items of the same cluster, or, if there is none, of all: those that
    were there and those before it in the batch. Items are never linked to themselves.
    """
    chosen = cut(by_words(items.select("item", "keywords"), clusters))
    open_ = chosen.where("is_new").select("item")
    words = by_words(items.select("item", "keywords").join(open_, "item", "left_semi"), clusters, least=0.0).select("item", F.col("score").alias("word_score"), "cluster_id")
    centre = clusters.select("cluster_id", F.col("vector").alias("cv")) if "vector" in clusters.columns else clusters.select("cluster_id", F.lit(None).cast("array<double>").alias("cv"))
    size = norm("vector") * norm("cv")
    scores = words.where("cluster_id is not null").join(centre, "cluster_id").join(items.select("item", "vector"), "item").select("item", "cluster_id", "word_score", F.coalesce(F.when(size > 0, dot("vector", "cv") / size), F.lit(0.0)).alias("vector_score"))
    second = guarded(scores).select("item", F.col("cluster_id").alias("guard"))
    placed = chosen.join(second, "item", "left").select("item", F.when(~F.col("is_new"), F.col("cluster_id")).otherwise(F.coalesce("guard", F.lit(MISC))).alias("cluster_id"), "confidence")
    nodes = cut(items.join(placed, "item").select("item", "pos", "keywords", "vector", "cluster_id", "confidence"))
    there = vectors.select("item", "cluster_id", F.lit(-1).cast("bigint").alias("pos"), "vector").join(nodes.select("item"), "item", "left_anti")
    every = cut(there.unionByName(nodes.select("item", "cluster_id", F.col("pos").cast("bigint").alias("pos"), "vector")))
    pairs = similar_pairs(nodes, "item", "vector", threshold, other=every)
    about = pairs.join(nodes.select(F.col("item").alias("source"), F.col("pos").alias("sp"), F.col("cluster_id").alias("sc")), "source").join(every.select(F.col("item").alias("target"), F.col("pos").alias("tp"), F.col("cluster_id").alias("tc")), "target")
    valid = about.where("source <> target and tp < sp").withColumn("same", F.col("sc") == F.col("tc"))
    any_same = F.max("same").over(Window.partitionBy("source"))
    order = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    edges = valid.withColumn("has", any_same).where("same or not has").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fresh = nodes.select("item", "cluster_id", "vector", F.lit(2**62).alias("version"))
    return {"nodes": nodes.drop("vector"), "edges": edges.select("source", "target", F.col("similarity").alias("weight"), "same", "rank"), "vectors": upserted(vectors.select("item", "cluster_id", "vector", F.col("version").cast("bigint").alias("version")), fresh, ["item"], "version")}
