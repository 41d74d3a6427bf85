"""Queries over vectors and the similarity graph between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.graph import both_ways, communities, group_metrics, inner_edges, merged_centroids, neighbours, refined_clusters, representatives, shortest_paths, subgraph
from kgloom.operators.similarity import adaptive_thresholds, candidate_edges, cosine_distance, normalised, pooled, similar_pairs, similarity_stats, stratified_approval, top_matches
from kgloom.session import cut
from kgloom.sources.tables import table

HIGH, MEDIUM, LINK = 0.4, 0.3, 0.33


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def edges(spark: SparkSession, folder: str, threshold: float = LINK) -> DataFrame:
    """source, target, weight of pairs of at least ``threshold``."""
    return cut(similar_pairs(vectors(spark, folder), "vec_id", "embedding", threshold).withColumnRenamed("similarity", "weight"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select(F.col("label").alias("group"), F.col("vec_id").alias("node"))


def d1_similar_pairs(spark, folder):
    return similar_pairs(vectors(spark, folder), "vec_id", "embedding", MEDIUM).withColumn("similarity", F.round("similarity", 6))


def d3_pairs_to_labels(spark, folder):
    """Every vector against the mean vector of every label."""
    means = pooled(vectors(spark, folder), ["label"], "embedding").select(F.col("label").cast("bigint").alias("id"), F.col("vector").alias("embedding"))
    new = vectors(spark, folder).select(F.col("vec_id").alias("id"), "embedding")
    return similar_pairs(new, "id", "embedding", 0.2, other=means).select(F.col("source").alias("vec_id"), F.col("target").alias("label"), F.round("similarity", 6).alias("similarity"))


def e1_similarity_stats(spark, folder):
    stats = similarity_stats(vectors(spark, folder), "vec_id", "embedding")
    return stats.select("count", *[F.round(c, 8).alias(c) for c in ("max", "min", "mean", "p90", "p75")])


def i30_thresholds(spark, folder):
    got = adaptive_thresholds(similarity_stats(vectors(spark, folder), "vec_id", "embedding"))
    return got.select(F.round("high", 8).alias("high"), F.round("medium", 8).alias("medium"), "adjusted")


def _candidates(spark, folder):
    pairs = similar_pairs(vectors(spark, folder), "vec_id", "embedding", MEDIUM)
    return candidate_edges(pairs, members(spark, folder).select("node", F.col("group").alias("cluster")), HIGH, MEDIUM)


def d2_candidate_edges(spark, folder):
    return _candidates(spark, folder).select("source", "target", F.round("weight", 6).alias("weight"), "tier", "is_intra")


def e2_edge_stats(spark, folder):
    return _candidates(spark, folder).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_intra").alias("intra"), F.count_if(~F.col("is_intra")).alias("inter"), F.count_if(F.col("tier") == "high").alias("high"))


def f14_early_stop(spark, folder):
    verdicts = similar_pairs(vectors(spark, folder), "vec_id", "embedding", 0.25).withColumn("draw", F.pmod(F.col("source") * 7 + F.col("target"), F.lit(13)))
    verdicts = verdicts.withColumn("approved", F.when(F.col("similarity") >= 0.35, F.col("draw") < 12).otherwise(F.col("draw") < 1))  # stands for a model's answers
    return stratified_approval(verdicts).groupBy("stratum").agg(F.count(F.lit(1)).alias("approved"))


def g1_top_matches(spark, folder):
    pairs = similar_pairs(vectors(spark, folder), "vec_id", "embedding", 0.25)
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), "similarity"))
    return top_matches(both, 5).select("source", "target", "rank")


def e23_label_centroids(spark, folder):
    got = pooled(vectors(spark, folder), ["label"], "embedding", unit_length=True)
    return got.select("label", F.posexplode("vector").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


def e24_weighted_pool(spark, folder):
    rows = vectors(spark, folder).withColumn("weight", F.greatest(F.col("vec_id") % 5, F.lit(1)))
    got = pooled(rows, ["label"], "embedding", "weight")
    return got.select("label", F.posexplode("vector").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


def i25_distances(spark, folder):
    """Cosine distance of every vector to the unit mean of its label."""
    rows = vectors(spark, folder)
    means = pooled(rows, ["label"], "embedding", unit_length=True)
    return rows.join(F.broadcast(means), "label").select("vec_id", F.round(cosine_distance("embedding", "vector"), 6).alias("distance"))  # one row for each label


def i26_norms(spark, folder):
    return vectors(spark, folder).select("vec_id", F.round(F.aggregate(normalised("embedding"), F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


def e4_graph_metadata(spark, folder):
    n = vectors(spark, folder).agg(F.count(F.lit(1)).alias("nodes"))
    got = edges(spark, folder).agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(got).select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2), 4).alias("density"))  # one row each


def e5_group_metrics(spark, folder):
    got = group_metrics(edges(spark, folder, MEDIUM), members(spark, folder))
    return got.select(F.col("group").alias("label"), "size", "internal_edges", F.round("density", 6).alias("density"), F.round("cohesion", 6).alias("cohesion"))


def e7_representatives(spark, folder):
    rounded = edges(spark, folder, MEDIUM).withColumn("weight", F.round("weight", 6).cast("decimal(12,6)"))
    return representatives(rounded, members(spark, folder)).select(F.col("group").alias("label"), "representative")


def e11_hubs(spark, folder):
    got = both_ways(edges(spark, folder)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.avg("weight"), 3).alias("avg_weight"))
    return got.where("degree >= 3")


def e13_label_metrics(spark, folder):
    """Per label: inner edges, edges that leave it, and centrality min(1, leaving / 2n)."""
    m = members(spark, folder)
    rows = edges(spark, folder).join(m.select(F.col("node").alias("source"), F.col("group").alias("a")), "source").join(m.select(F.col("node").alias("target"), F.col("group").alias("b")), "target")
    ends = rows.select("a", "b").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("label"), (F.col("a") == F.col("b")).alias("inner"))
    counts = ends.groupBy("label").agg(F.count_if("inner").alias("inner_edges"), F.count_if(~F.col("inner")).alias("leaving_edges"))
    sizes = m.groupBy(F.col("group").alias("label")).agg(F.count(F.lit(1)).alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(counts, "label", "left").select("label", "size", zero("inner_edges").alias("inner_edges"), zero("leaving_edges").alias("leaving_edges"), F.round(F.least(F.lit(1.0), zero("leaving_edges") / (2 * F.col("size"))), 6).alias("centrality"))


def e14_connections(spark, folder):
    m = members(spark, folder)
    rows = edges(spark, folder).join(m.select(F.col("node").alias("source"), F.col("group").alias("a")), "source").join(m.select(F.col("node").alias("target"), F.col("group").alias("b")), "target").where("a <> b")
    got = rows.groupBy(F.least("a", "b").alias("label_a"), F.greatest("a", "b").alias("label_b")).agg(F.count(F.lit(1)).alias("edges"))
    return got.select("*", F.least(F.lit(1.0), F.col("edges") / 5).alias("strength")).orderBy(F.desc("edges"), "label_a", "label_b").limit(10)


def d7_inner_edges(spark, folder):
    return inner_edges(edges(spark, folder), members(spark, folder)).select(F.col("group").alias("label"), "source", "target")


def j4_components(spark, folder):
    return communities(edges(spark, folder, MEDIUM), members(spark, folder), "components", least_weight=LINK).select(F.col("group").cast("int").alias("label"), "community", "node")


def j3_louvain(spark, folder):
    return communities(edges(spark, folder, MEDIUM), members(spark, folder), "louvain")


def j5_cliques(spark, folder):
    return communities(edges(spark, folder, MEDIUM), members(spark, folder), "cliques", least_weight=MEDIUM, least_size=3)


def j1_refined_clusters(spark, folder):
    nodes = vectors(spark, folder).select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("node"), F.col("label").alias("cluster"))
    links = edges(spark, folder).withColumn("pos", F.col("source") * 1_000_000 + F.col("target"))
    return refined_clusters(nodes, links)


def j2_refine_stats(spark, folder):
    got = j1_refined_clusters(spark, folder)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("cluster") != F.col("cluster_before")).alias("came"))


def j8_two_hops(spark, folder):
    return neighbours(edges(spark, folder), vectors(spark, folder).select(F.col("vec_id").alias("seed")), 2, limit=20)


def j9_one_hop(spark, folder):
    return both_ways(edges(spark, folder)).select("node", "peer", F.round("weight", 6).alias("weight"))


def _ends(spark, folder):
    return vectors(spark, folder).groupBy("label").agg(F.min("vec_id").alias("start"), F.max("vec_id").alias("goal")).select("start", "goal")


def j10_shortest_paths(spark, folder):
    got = shortest_paths(edges(spark, folder, MEDIUM), _ends(spark, folder).distinct(), 4)
    return got.select("start", "goal", "length", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def j11_subgraph(spark, folder):
    """Nodes and edges one step around the first vector of each label."""
    nodes, inside = subgraph(vectors(spark, folder).select(F.col("vec_id").alias("node")), edges(spark, folder), _ends(spark, folder).select(F.col("start").alias("seed")))
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(inside.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


def k4_merged_centroids(spark, folder):
    means = pooled(vectors(spark, folder), ["label"], "embedding").select(F.col("label").cast("bigint").alias("label"), "vector")
    return merged_centroids(means, "label", "vector", 0.5).select(F.col("key").alias("label"), "merged")


def k2_nearest_centroid(spark, folder):
    """Each vector's nearest label mean, with the cosine, held to [0, 1], as confidence."""
    means = pooled(vectors(spark, folder), ["label"], "embedding").select(F.col("label").cast("bigint").alias("id"), F.col("vector").alias("embedding"))
    pairs = similar_pairs(vectors(spark, folder).select(F.col("vec_id").alias("id"), "embedding"), "id", "embedding", -1.0, other=means)
    best = pairs.groupBy(F.col("source").alias("vec_id")).agg(F.max_by(F.struct("target", "similarity"), F.struct(F.round("similarity", 9), -F.col("target"))).alias("m"))
    return best.select("vec_id", F.col("m.target").alias("label"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m.similarity"))), 6).alias("confidence"))


_NAMES = [
    "d1_similar_pairs", "d2_candidate_edges", "d3_pairs_to_labels", "d7_inner_edges", "e1_similarity_stats", "e2_edge_stats", "e4_graph_metadata", "e5_group_metrics", "e7_representatives", "e11_hubs", "e13_label_metrics", "e14_connections",
    "e23_label_centroids", "e24_weighted_pool", "f14_early_stop", "g1_top_matches", "i25_distances", "i26_norms", "i30_thresholds", "j1_refined_clusters", "j2_refine_stats", "j3_louvain", "j4_components", "j5_cliques", "j8_two_hops", "j9_one_hop",
    "j10_shortest_paths", "j11_subgraph", "k2_nearest_centroid", "k4_merged_centroids",
]
QUERIES = {n: globals()[n] for n in _NAMES}

_V = """v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS source, b.vec_id AS target, a.label AS la, b.label AS lb, list_dot_product(a.u, b.u) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id),
m AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v) GROUP BY label, d) GROUP BY label),
mu AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM m),
l AS (SELECT * FROM p WHERE s >= 0.33), l3 AS (SELECT * FROM p WHERE s >= 0.3),
both_l AS (SELECT source AS node, target AS peer, s FROM l UNION ALL SELECT target, source, s FROM l)"""
_STATS = "SELECT count(*) AS count, max(s) AS max, min(s) AS min, avg(s) AS mean, quantile_cont(s, 0.9) AS p90, quantile_cont(s, 0.75) AS p75 FROM p"
_W, _R = f"WITH {_V} ", f"WITH RECURSIVE {_V}, "
SQL = {
    "d1_similar_pairs": _W + "SELECT source, target, round(s, 6) AS similarity FROM p WHERE s >= 0.3",
    "d2_candidate_edges": _W + "SELECT source, target, round(s, 6) AS weight, CASE WHEN s >= 0.4 THEN 'high' ELSE 'medium' END AS tier, coalesce(la = lb, false) AS is_intra FROM l3",
    "d3_pairs_to_labels": _W + "SELECT vec_id, mu.label::BIGINT AS label, round(list_dot_product(u, c), 6) AS similarity FROM v, mu WHERE list_dot_product(u, c) >= 0.2",
    "d7_inner_edges": _W + "SELECT la AS label, source, target FROM l WHERE la = lb",
    "e1_similarity_stats": _W + f"SELECT count, round(max, 8) AS max, round(min, 8) AS min, round(mean, 8) AS mean, round(p90, 8) AS p90, round(p75, 8) AS p75 FROM ({_STATS})",
    "i30_thresholds": _W + f""", st AS ({_STATS}),
f AS (SELECT *, greatest(least(greatest(least(0.6, max * 0.85), p90), max - 1e-4), 0) AS lm FROM st), g AS (SELECT *, greatest(least(greatest(least(0.8, max * 0.95), p90), max - 5e-4), lm + 5e-3) AS lh FROM f),
h AS (SELECT max, lh, CASE WHEN max < 0.6 THEN lm ELSE 0.6 END AS m, CASE WHEN max < 0.8 THEN lh ELSE 0.8 END AS h, max < 0.8 AS adjusted FROM g), k AS (SELECT *, CASE WHEN h <= m THEN least(max - 1e-4, greatest(m + 0.01, lh)) ELSE h END AS h2 FROM h)
SELECT round(h2, 8) AS high, round(CASE WHEN h <= m THEN greatest(least(m, h2 - 0.01), 0) ELSE m END, 8) AS medium, adjusted FROM k""",
    "e2_edge_stats": _W + "SELECT count(*) AS total, count(*) FILTER (la = lb) AS intra, count(*) FILTER (la IS DISTINCT FROM lb) AS inter, count(*) FILTER (s >= 0.4) AS high FROM l3",
    "f14_early_stop": _W + """, x AS (SELECT floor(s / 0.05 + 1e-9)::BIGINT AS stratum, CASE WHEN s >= 0.35 THEN (source * 7 + target) % 13 < 12 ELSE (source * 7 + target) % 13 < 1 END AS ok FROM p WHERE s >= 0.25), r AS (SELECT stratum FROM x GROUP BY stratum HAVING avg(ok::INT) < 0.1)
SELECT stratum, count(*) AS approved FROM x WHERE ok AND stratum >= coalesce((SELECT max(stratum) FROM r), -100) GROUP BY stratum""",
    "g1_top_matches": _W + "SELECT source, target, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS r FROM (SELECT source, target, s FROM p UNION ALL SELECT target, source, s FROM p) WHERE s >= 0.25) WHERE r <= 5",
    "e23_label_centroids": _W + "SELECT label, (d - 1)::INT AS dim, round(x, 6) AS x FROM (SELECT label, unnest(c) AS x, generate_subscripts(c, 1) AS d FROM mu)",
    "e24_weighted_pool": _W + "SELECT label, (d - 1)::INT AS dim, round(sum(w * x) / sum(w), 6) AS x FROM (SELECT label, greatest(vec_id % 5, 1) AS w, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v) GROUP BY label, d",
    "i25_distances": _W + "SELECT vec_id, round(1 - list_dot_product(u, c), 6) AS distance FROM v JOIN mu USING (label)",
    "i26_norms": _W + "SELECT vec_id, round(list_dot_product(u, u), 6) AS squared FROM v",
    "e4_graph_metadata": _W + "SELECT n AS nodes, e AS edges, round(e / (n * (n - 1) / 2), 4) AS density FROM (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM l) AS e)",
    "e5_group_metrics": _W + "SELECT label, n AS size, coalesce(k, 0) AS internal_edges, round(CASE WHEN n > 1 THEN coalesce(k, 0) / (n * (n - 1) / 2) ELSE 0 END, 6) AS density, round(coalesce(w, 0), 6) AS cohesion FROM (SELECT label, count(*) AS n FROM v GROUP BY 1) LEFT JOIN (SELECT la AS label, count(*) AS k, avg(s) AS w FROM l3 WHERE la = lb GROUP BY 1) USING (label)",
    "e7_representatives": _W + """, d AS (SELECT label, node, sum(w) AS deg FROM (SELECT la AS label, source AS node, round(s, 6)::DECIMAL(12,6) AS w FROM l3 WHERE la = lb UNION ALL SELECT la, target, round(s, 6)::DECIMAL(12,6) FROM l3 WHERE la = lb) GROUP BY ALL)
SELECT label, vec_id AS representative FROM (SELECT v.label, vec_id, row_number() OVER (PARTITION BY v.label ORDER BY coalesce(deg, 0) DESC, vec_id) AS r FROM v LEFT JOIN d ON d.node = vec_id) WHERE r = 1""",
    "e11_hubs": _W + "SELECT node, count(*) AS degree, round(avg(s), 3) AS avg_weight FROM both_l GROUP BY node HAVING count(*) >= 3",
    "e13_label_metrics": _W + """, c AS (SELECT label, count(*) FILTER (a = b) AS i, count(*) FILTER (a <> b) AS o FROM (SELECT la AS label, la AS a, lb AS b FROM l UNION ALL SELECT lb, la, lb FROM l WHERE la <> lb) GROUP BY label)
SELECT label, n AS size, coalesce(i, 0) AS inner_edges, coalesce(o, 0) AS leaving_edges, round(least(1.0, coalesce(o, 0) / (2 * n)), 6) AS centrality FROM (SELECT label, count(*) AS n FROM v GROUP BY 1) LEFT JOIN c USING (label)""",
    "e14_connections": _W + "SELECT least(la, lb) AS label_a, greatest(la, lb) AS label_b, count(*) AS edges, least(1.0, count(*) / 5) AS strength FROM l WHERE la <> lb GROUP BY 1, 2 ORDER BY edges DESC, label_a, label_b LIMIT 10",
    "j4_components": _R + """x AS (SELECT la AS label, source AS a, target AS b FROM l WHERE la = lb UNION ALL SELECT la, target, source FROM l WHERE la = lb),
r AS (SELECT label, a AS node, a AS other FROM x UNION SELECT r.label, r.node, x.b FROM r JOIN x ON r.other = x.a AND r.label = x.label)
SELECT label, min(other) AS community, node FROM r GROUP BY label, node""",
    "j8_two_hops": _W + """, h AS (SELECT DISTINCT node AS seed, peer AS node, 1 AS distance FROM both_l), h2 AS (SELECT DISTINCT h.seed, b.peer AS node, 2 AS distance FROM h JOIN both_l b ON h.node = b.node WHERE b.peer <> h.seed AND (h.seed, b.peer) NOT IN (SELECT (seed, node) FROM h))
SELECT seed, node, distance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS r FROM (SELECT * FROM h UNION ALL SELECT * FROM h2)) WHERE r <= 20""",
    "j9_one_hop": _W + "SELECT node, peer, round(s, 6) AS weight FROM both_l",
    "j10_shortest_paths": _R + """ends AS (SELECT DISTINCT min(vec_id) AS start, max(vec_id) AS goal FROM v GROUP BY label), b AS (SELECT source AS a, target AS b FROM l3 UNION ALL SELECT target, source FROM l3),
w AS (SELECT DISTINCT start, start AS node, [start] AS path FROM ends UNION ALL SELECT w.start, b.b, list_append(path, b.b) FROM w JOIN b ON w.node = b.a WHERE len(path) <= 4 AND NOT list_contains(path, b.b))
SELECT start, goal, (len(path) - 1)::INT AS length, array_to_string(path, ',') AS path FROM (SELECT e.start, e.goal, path, row_number() OVER (PARTITION BY e.start, e.goal ORDER BY len(path), path) AS r FROM ends e JOIN w ON w.start = e.start AND w.node = e.goal) WHERE r = 1""",
    "j11_subgraph": _W + """, one AS MATERIALIZED (SELECT source, target FROM l), seeds AS MATERIALIZED (SELECT min(vec_id) AS seed FROM v GROUP BY label),
n AS MATERIALIZED (SELECT seed AS node FROM seeds UNION SELECT target FROM one JOIN seeds ON source = seed UNION SELECT source FROM one JOIN seeds ON target = seed)
SELECT 'node' AS kind, node AS a, NULL::BIGINT AS b FROM n UNION ALL SELECT 'edge', source, target FROM one WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)""",
    "k2_nearest_centroid": _W + "SELECT vec_id, label, confidence FROM (SELECT vec_id, mu.label::BIGINT AS label, round(least(1.0, greatest(0.0, list_dot_product(u, c))), 6) AS confidence, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 9) DESC, mu.label) AS r FROM v, mu) WHERE r = 1",
    "k4_merged_centroids": _R + """x AS (SELECT a.label AS a, b.label AS b FROM mu a, mu b WHERE a.label = b.label OR list_dot_product(a.c, b.c) > 0.5), r AS (SELECT a AS label, b AS other FROM x UNION SELECT r.label, x.b FROM r JOIN x ON r.other = x.a)
SELECT label::BIGINT AS label, min(other)::BIGINT AS merged FROM r GROUP BY label""",
}
