"""From source documents to a clustered graph of their nodes, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import preprocessed, seeded_vector
from kgloom.operators.graph import communities, group_metrics, refined_clusters, representatives
from kgloom.operators.keywords import text_grams
from kgloom.operators.ranking import numbered
from kgloom.operators.similarity import adaptive_thresholds, candidate_edges, pooled, similar_pairs, similarity_stats
from kgloom.session import cut


@dataclass(frozen=True)
class Settings:
    keywords: int = 5
    longest_gram: int = 3
    clusters: int = 5
    high: float = 0.8
    medium: float = 0.6
    dimension: int = 64
    seed: int = 42


def features(sections: DataFrame, settings: Settings = Settings(), embed=None) -> DataFrame:
    """id (dense), orig_id, title, keywords (term and score), num_sections and vector of each source.

    ``sections`` has source_id, title, pos, role and content. Vectors are means of the sections' ones at unit length.
    Terms score by how often a source uses them against how many sources do.
    """
    embed = embed or seeded_vector(settings.dimension)
    rows = sections.where("content is not null").select("source_id", "title", "pos", preprocessed("content").alias("text")).where("text <> ''")
    rows = cut(rows.withColumn("vector", embed("text")))
    vectors = pooled(rows.select("source_id", "vector"), ["source_id"], "vector", unit_length=True)
    terms = text_grams(rows, "source_id", "text", settings.longest_gram).groupBy("source_id", "term").agg(F.count(F.lit(1)).alias("n"))
    spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("sources"))
    total = rows.agg(F.count_distinct("source_id").alias("total"))
    scored = terms.join(spread, "term").crossJoin(F.broadcast(total)).withColumn("score", F.col("n") * F.log1p(F.col("total") / F.col("sources")))  # one row
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "term")
    best = scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= settings.keywords).groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term", "score"))), lambda k: F.struct(k["term"].alias("term"), F.round(k["score"], 4).alias("score"))).alias("keywords"))
    about = rows.groupBy("source_id").agg(F.max("title").alias("title"), F.count(F.lit(1)).cast("int").alias("num_sections"))
    joined = about.join(best, "source_id", "left").join(vectors, "source_id").withColumn("one", F.lit(1))
    return cut(numbered(joined, ["one"], ["source_id"], "id").select("id", F.col("source_id").alias("orig_id"), "title", "keywords", "num_sections", "vector"))


def assigned(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """node, cluster and confidence by k-means on the vectors, the offline stand-in for a model's choice."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = nodes.select(F.col("id").alias("node"), array_to_vector(F.col("vector")).alias("features"), "vector")
    model = KMeans(k=settings.clusters, seed=settings.seed).fit(rows)
    centres = nodes.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    got = model.transform(rows).join(F.broadcast(centres), "prediction")  # one row for each cluster
    from kgloom.operators.similarity import cosine_distance

    return got.select("node", F.concat(F.lit("cluster_"), F.col("prediction") + 1).alias("cluster"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine_distance("vector", "centre"))).alias("confidence"))


def graph(sections: DataFrame, settings: Settings = Settings(), embed=None) -> dict[str, DataFrame]:
    """The tables nodes, edges, candidates, clusters and subclusters of a corpus of sections."""
    found = features(sections, settings, embed)
    chosen = cut(assigned(found, settings))
    vectors = found.select("id", "vector")
    limits = adaptive_thresholds(similarity_stats(vectors, "id", "vector"), settings.high, settings.medium).first()
    pairs = similar_pairs(vectors, "id", "vector", limits.medium)
    links = cut(candidate_edges(pairs, chosen.select("node", "cluster"), limits.high, limits.medium))
    edges = links.where("tier = 'high'")
    ordered = edges.select("source", "target", "weight", (F.col("source") * F.lit(2**31) + F.col("target")).alias("pos"))
    moved = cut(refined_clusters(chosen.select(F.col("node").alias("pos"), "node", "cluster"), ordered))
    after = moved.select("node", F.col("cluster").alias("group"))
    parts = cut(communities(edges.select("source", "target", "weight"), after, "louvain"))
    named = parts.select(F.concat_ws("_", F.lit("sub"), "group", F.col("community").cast("string")).alias("group"), "node")
    subclusters = group_metrics(edges, named).join(representatives(edges, named), "group").withColumnRenamed("group", "subcluster_id")
    nodes = found.drop("vector").join(moved.select(F.col("node").alias("id"), "cluster", "cluster_before"), "id").join(chosen.select(F.col("node").alias("id"), "confidence"), "id").join(named.select(F.col("node").alias("id"), F.col("group").alias("subcluster_id")), "id", "left")
    before = moved.select("node", "cluster")
    final = edges.select("source", "target", "weight", F.col("is_intra").alias("is_intra_initial")).join(before.select(F.col("node").alias("source"), F.col("cluster").alias("a")), "source").join(before.select(F.col("node").alias("target"), F.col("cluster").alias("b")), "target")
    final = final.select("source", "target", "weight", "is_intra_initial", (F.col("a") == F.col("b")).alias("is_intra"), F.lit("semantic").alias("type"))
    clusters = nodes.groupBy(F.col("cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return {"nodes": nodes, "edges": final, "candidates": links.where("tier = 'medium'"), "clusters": clusters, "subclusters": subclusters}
