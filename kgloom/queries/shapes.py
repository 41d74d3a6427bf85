"""Queries over the small reshaping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators.current import current_rows, trimmed
from kgloom.operators.graph import both_ways
from kgloom.operators.projections import appended, close_pairs_with_words, first_by_id, labelled_groups, looked_up, matched_keywords, names_containing, profile_text, read_assignments, safe_id, stored_density, unique_terms
from kgloom.queries import graph as G
from kgloom.queries.insights import _N, _cluster, nodes
from kgloom.sources.tables import table


def a4_source_groups(spark, folder):
    """Sections by what their id has before the last ``#``."""
    rows = table(spark, folder, "sections").select(F.regexp_extract(trimmed("section_id"), "^(.*)#[^#]*$", 1).alias("source"), trimmed("section_id").alias("section"))
    return rows.groupBy("source").agg(F.count_distinct("section").alias("sections"))


def a23_safe_ids(spark, folder):
    return nodes(spark, folder).select("id", safe_id(trimmed("title"), 20).alias("safe"))


def c11_titles_containing(spark, folder):
    return names_containing(nodes(spark, folder).select("id", F.col("title").alias("name")), "plan")


def c12_matched_keywords(spark, folder):
    rows = nodes(spark, folder).select("id", matched_keywords(F.col("terms"), F.lit("binary tree")).alias("m"))
    return rows.where(F.size("m") > 0).select("id", F.array_join("m", "|").alias("matched"))


def d6_members(spark, folder):
    """Clusters of nodes by assignment, else by the sub-cluster that lists them."""
    rows = table(spark, folder, "assignments").select(F.col("conversation_id").alias("node"), _cluster("cluster_id").alias("cluster"), "assigned_at")
    direct = current_rows(rows, ["node"], ["assigned_at"], ["cluster"]).where("cluster is not null")
    listed = table(spark, folder, "subclusters").where("cluster_id is not null").select(_cluster("cluster_id").alias("cluster"), F.array_distinct("node_ids").alias("members"))
    return read_assignments(direct, listed).distinct()


def d9_looked_up(spark, folder):
    """Assignments with the title of their node, by orig_id, else by number."""
    rows = table(spark, folder, "assignments").select(F.col("conversation_id").alias("no"), F.col("orig_id").alias("key")).distinct()
    return looked_up(rows, nodes(spark, folder).select("id", trimmed("orig_id").alias("orig_id"), "title"), "key", "no", ["title"])


def d14_first_by_id(spark, folder):
    """Customers and suppliers by number, customers first."""
    a = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return first_by_id([b, a])


def d15_appended(spark, folder):
    a = table(spark, folder, "subclusters").select(_cluster("cluster_id").alias("cluster")).where("cluster is not null").distinct()
    b = table(spark, folder, "graph_nodes").select(_cluster(trimmed("cluster_id")).alias("cluster")).where("cluster is not null")
    return appended(a, b, "cluster")


def d17_endpoint_words(spark, folder):
    """Edges with the number of terms of either end."""
    e = G.edges(spark, folder, 0.35)
    n = nodes(spark, folder).select("id", F.size(F.coalesce("terms", F.array().cast("array<string>"))).alias("n"))
    rows = e.join(n.select(F.col("id").alias("source"), F.col("n").alias("source_terms")), "source").join(n.select(F.col("id").alias("target"), F.col("n").alias("target_terms")), "target")
    return rows.select("source", "target", "source_terms", "target_terms")


def e12_stored_density(spark, folder):
    m = G.members(spark, folder).select("node", F.col("group").alias("cluster"))
    links = G._candidates(spark, folder).select("source", "target", "is_intra")
    return stored_density(m, links).withColumn("density", F.round("density", 6))


def g10_close_pairs(spark, folder):
    n = nodes(spark, folder).select(F.col("id").alias("node"), F.array_distinct(F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.col("source_type")))).alias("terms"))
    return close_pairs_with_words(G.edges(spark, folder, 0.35), n, 0.35).select("source", "target", F.array_join("shared", "|").alias("shared"))


def g7_unique_terms(spark, folder):
    return unique_terms(nodes(spark, folder), "id", "top_keywords", 3).withColumn("pos", F.col("pos").cast("int"))


def i38_profiles(spark, folder):
    return nodes(spark, folder).select("id", profile_text(F.coalesce(F.col("cluster_name"), F.lit("")), F.coalesce(F.col("title"), F.lit("")), F.col("top_keywords"), 2).alias("profile"))


def k9_labels(spark, folder):
    groups = table(spark, folder, "subclusters").select("id", "top_keywords")
    none = spark.createDataFrame([], "id string, label string")
    return labelled_groups(groups, none, "id").select("id", "label", F.size("top_keywords").alias("n"))


def s1_incident_edges(spark, folder):
    """Edges at each node, a self-loop counting once."""
    return both_ways(G.edges(spark, folder)).groupBy("node").agg(F.count_distinct("peer").alias("edges"))


_NAMES = ["a4_source_groups", "a23_safe_ids", "c11_titles_containing", "c12_matched_keywords", "d6_members", "d9_looked_up", "d14_first_by_id", "d15_appended", "d17_endpoint_words", "e12_stored_density", "g7_unique_terms", "g10_close_pairs", "i38_profiles", "k9_labels", "s1_incident_edges"]
QUERIES = {n: globals()[n] for n in _NAMES}

_V = G._V
_C = lambda c: f"CASE WHEN regexp_extract({c}, '([0-9]+)\\s*$', 1) <> '' THEN 'cluster_' || regexp_extract({c}, '([0-9]+)\\s*$', 1)::INT END"
_TRIM = lambda c: f"trim({c}, E' \\t\\r\\n' || chr(160))"
SQL = {
    "a4_source_groups": f"SELECT regexp_extract({_TRIM('section_id')}, '^(.*)#[^#]*$', 1) AS source, count(DISTINCT {_TRIM('section_id')}) AS sections FROM sections GROUP BY 1",
    "a23_safe_ids": f"WITH {_N} SELECT id, left(regexp_replace({_TRIM('title')}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 20) AS safe FROM n",
    "c11_titles_containing": f"WITH {_N} SELECT id, title AS name FROM n WHERE contains(lower(title), 'plan')",
    "c12_matched_keywords": f"WITH {_N}, x AS (SELECT id, list_filter(list_filter(terms, lambda t: t IS NOT NULL)[1:10], lambda t: contains(lower(t), 'binary tree') OR contains('binary tree', lower(t))) AS m FROM n) SELECT id, array_to_string(m, '|') AS matched FROM x WHERE len(m) > 0",
    "d6_members": f"""WITH d AS (SELECT conversation_id AS node, {_C('cluster_id')} AS cluster FROM assignments QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY assigned_at DESC, {_C('cluster_id')} DESC NULLS LAST) = 1),
k AS (SELECT * FROM d WHERE cluster IS NOT NULL), l AS (SELECT DISTINCT unnest(node_ids) AS node, {_C('cluster_id')} AS cluster FROM subclusters WHERE cluster_id IS NOT NULL)
SELECT node, cluster FROM k UNION SELECT node, cluster FROM l WHERE node NOT IN (SELECT node FROM k)""",
    "d9_looked_up": f"WITH {_N}, r AS (SELECT DISTINCT conversation_id AS no, orig_id AS key FROM assignments) SELECT no, key, coalesce(a.title, b.title) AS title FROM r LEFT JOIN n a ON a.orig_id = key LEFT JOIN n b ON b.id = no",
    "d14_first_by_id": "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
    "d15_appended": f"SELECT DISTINCT cluster FROM (SELECT {_C('cluster_id')} AS cluster FROM subclusters UNION ALL SELECT {_C(_TRIM('cluster_id'))} FROM graph_nodes) WHERE cluster IS NOT NULL",
    "d17_endpoint_words": f"WITH {_V}, {_N} SELECT source, target, len(coalesce(a.terms, []))::INT AS source_terms, len(coalesce(b.terms, []))::INT AS target_terms FROM p JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE s >= 0.35",
    "e12_stored_density": f"WITH {_V} SELECT label AS cluster, k AS nodes, coalesce(c, 0) AS edges, round(CASE WHEN k * (k - 1) // 2 > 0 THEN coalesce(c, 0) / (k * (k - 1) // 2) ELSE 0 END, 6) AS density FROM (SELECT label, count(*) AS k FROM v GROUP BY 1) LEFT JOIN (SELECT la AS label, count(*) AS c FROM l3 WHERE la = lb GROUP BY 1) USING (label)",
    "g7_unique_terms": f"""WITH {_N}, x AS (SELECT id, unnest(top_keywords[1:30]) AS term, generate_subscripts(top_keywords[1:30], 1) AS pos FROM n), f AS (SELECT id, lower(trim(term, ' ')) AS plain, min(pos) AS pos, arg_min(term, pos) AS term FROM x WHERE trim(term, ' ') <> '' GROUP BY ALL)
SELECT id, trim(term, ' ') AS term, (r - 1)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM f) WHERE r <= 3""",
    "g10_close_pairs": f"WITH {_V}, {_N}, w AS (SELECT id, list_distinct(list_append(coalesce(terms, []), source_type)) AS t FROM n) SELECT source, target, array_to_string(list_sort(list_intersect(a.t, b.t)), '|') AS shared FROM p JOIN w a ON a.id = source JOIN w b ON b.id = target WHERE s >= 0.35",
    "i38_profiles": f"WITH {_N}, y AS (SELECT id, cluster_name AS name FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) SELECT id, concat_ws(' ', nullif(trim(coalesce(name, ''), ' '), ''), nullif(trim(coalesce(title, ''), ' '), ''), coalesce(array_to_string(top_keywords[1:2], ' '), '')) AS profile FROM n JOIN y USING (id)",
    "k9_labels": "SELECT id, top_keywords[1] AS label, len(CASE WHEN top_keywords[1] IS NULL THEN top_keywords ELSE list_distinct(top_keywords) END)::INT AS n FROM subclusters",
    "s1_incident_edges": f"WITH {_V} SELECT node, count(DISTINCT peer) AS edges FROM both_l GROUP BY 1",
}
