"""Queries over knowledge-graph nodes, their clusters, keywords, conversations and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.operators.current import current_rows, trimmed
from kgloom.operators.ranking import numbered
from kgloom.operators.sequence import packed_batches, question_answer_pairs, with_previous, within_budget
from kgloom.session import cut
from kgloom.sources.tables import table

#: The moment that stands for now, in epoch seconds.
NOW = 1_735_689_600
DAY = 86_400


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of each graph node; keywords is an array of its terms, trimmed, and scores the array of scores."""
    rows = table(spark, folder, "graph_nodes").where("id is not null")
    keep = ["orig_id", "title", "cluster_id", "cluster_name", "cluster_confidence", "terms", "scores", "top_keywords", "create_time", "num_sections", "source_type"]
    rows = rows.withColumns({"terms": F.transform("keywords", lambda k: trimmed(k["term"])), "scores": F.transform("keywords", lambda k: k["score"]), "cluster_id": trimmed("cluster_id")})
    return current_rows(rows, ["id"], ["updated_at"], keep)


def _terms(spark, folder, most: int | None = 5) -> DataFrame:
    got = nodes(spark, folder).select("id", "cluster_id", F.posexplode(F.arrays_zip("terms", "scores")).alias("pos", "k"))
    got = got.where(F.col("pos") < most) if most else got
    return got.select("id", "cluster_id", F.col("k.terms").alias("term"), F.col("k.scores").alias("score")).where("term <> ''")


def a28_nodes(spark, folder):
    return nodes(spark, folder).select("id", trimmed("orig_id").alias("orig_id"), "cluster_id", "num_sections", "source_type", F.size("terms").alias("n_terms"))


def c3_keyword_string(spark, folder):
    return nodes(spark, folder).select("id", F.array_join(F.slice(F.filter("terms", lambda t: t.isNotNull()), 1, 3), ",").alias("keywords"))


def c10_keyword_search(spark, folder):
    """Nodes with a keyword that contains ``plan``, in any case."""
    return nodes(spark, folder).where(F.exists("terms", lambda t: F.contains(F.lower(t), F.lit("plan")))).select("id", "cluster_id")


def d4_assignments(spark, folder):
    """Every node with its assigned cluster, written cluster_{n}, and defaults where there is none."""
    rows = table(spark, folder, "assignments").select(F.col("conversation_id").alias("id"), _cluster("cluster_id").alias("assigned"), "confidence", "assigned_at")
    last = current_rows(rows, ["id"], ["assigned_at"], ["assigned", "confidence"])
    return nodes(spark, folder).select("id").join(last, "id", "left").select("id", F.coalesce("assigned", F.lit("unknown")).alias("cluster_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _cluster(c: str):
    number = F.regexp_extract(c, "([0-9]+)\\s*$", 1)
    return F.when(number != "", F.concat(F.lit("cluster_"), number.try_cast("int").cast("string")))


def e3_cluster_sizes(spark, folder):
    return d4_assignments(spark, folder).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 4).alias("confidence"))


def _members(spark, folder):
    return table(spark, folder, "subclusters").select(F.col("id").alias("subcluster_id"), F.explode(F.array_distinct("node_ids")).alias("id"))


def d5_subcluster_of(spark, folder):
    return nodes(spark, folder).select("id").join(_members(spark, folder), "id", "left")


def e6_subcluster_keywords(spark, folder):
    """The five terms of the largest summed score in each sub-cluster."""
    sums = _members(spark, folder).join(_terms(spark, folder, None).withColumn("score", F.round("score", 6).cast("decimal(12,6)")), "id").groupBy("subcluster_id", "term").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("subcluster_id").orderBy(F.desc("score"), "term")
    return sums.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("subcluster_id", "term", F.col("score").cast("double").alias("score"), "rank")


def e8_coverage(spark, folder):
    n = nodes(spark, folder).select("id").join(_members(spark, folder).select("id", F.lit(1).alias("hit")).distinct(), "id", "left")
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


def e9_keyword_frequency(spark, folder):
    got = _terms(spark, folder).groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("id").alias("nodes"), F.count_distinct("cluster_id").alias("clusters"))
    return got.where("count >= 2")


def e10_cross_cluster(spark, folder):
    return e9_keyword_frequency(spark, folder).where("clusters >= 2").select("term", "clusters")


def e15_graph_stats(spark, folder):
    n = nodes(spark, folder)
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("cluster_id").alias("clusters"), F.min("create_time").alias("first"), F.max("create_time").alias("last"), F.round(F.avg("num_sections"), 6).alias("sections"))


def e16_cluster_keywords(spark, folder):
    order = Window.partitionBy("cluster_id").orderBy(F.desc("count"), "term")
    got = _terms(spark, folder).where("cluster_id is not null").groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("count"))
    return got.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


def e17_time_stats(spark, folder):
    got = nodes(spark, folder).where("cluster_id is not null").groupBy("cluster_id").agg(F.min("create_time").alias("earliest"), F.max("create_time").alias("latest"))
    return got.select("*", F.expr(f"(latest - earliest) div {DAY}").alias("span_days"), F.expr(f"({NOW} - latest) div {DAY}").alias("days_since"))


def e29_best_scores(spark, folder):
    """The best score of each keyword of a cluster, first five."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    got = _terms(spark, folder, None).where("cluster_id is not null").groupBy("cluster_id", "term").agg(F.max("score").alias("score"))
    return got.withColumn("rank", F.row_number().over(order)).where("rank <= 5")


def e20_store_stats(spark, folder):
    n = nodes(spark, folder)
    return n.agg(F.count_distinct("id").alias("ids"), F.count_distinct("orig_id").alias("orig_ids"), F.count_distinct("source_type").alias("types"))


def e28_majority_cluster(spark, folder):
    """The most frequent cluster of each source type, the smaller of equal ones."""
    got = nodes(spark, folder).where("cluster_id is not null").groupBy("source_type", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy("source_type").agg(F.min_by("cluster_id", F.struct(-F.col("n"), "cluster_id")).alias("cluster_id"), F.max("n").alias("votes"))


def e30_evidence(spark, folder):
    got = e9_keyword_frequency(spark, folder)
    repeated = got.select(F.lit("repeated keyword").alias("kind"), "term", F.least(F.lit(1.0), F.col("count") / 5).alias("confidence"))
    crossing = got.where("clusters >= 2").select(F.lit("cross cluster").alias("kind"), "term", F.least(F.lit(1.0), F.col("clusters") / 3).alias("confidence"))
    return repeated.unionByName(crossing).withColumn("confidence", F.round("confidence", 6))


def _visits(spark, folder) -> DataFrame:
    """Every user's nodes in time with the cluster before, where it differs: one row for each run in a cluster."""
    owned = table(spark, folder, "node_vectors").select(trimmed("id").alias("vid"), "user_id").where("user_id is not null").distinct()
    owned = owned.select(trimmed("user_id").alias("user_id"), F.expr("substring(vid, length(trim(user_id)) + 2)").alias("orig_id")).distinct()
    n = nodes(spark, folder).where("cluster_id is not null and create_time is not null").select("id", trimmed("orig_id").alias("orig_id"), "cluster_id", "create_time")
    rows = with_previous(n.join(owned, "orig_id"), ["user_id"], ["create_time", "id"], ["cluster_id"])
    return rows.where("prev_cluster_id is null or prev_cluster_id <> cluster_id")


def f3_cluster_runs(spark, folder):
    return _visits(spark, folder).select("user_id", "id", "cluster_id", "create_time")


def f4_revisits(spark, folder):
    return _visits(spark, folder).groupBy("user_id", "cluster_id").agg((F.count(F.lit(1)) - 1).alias("revisits")).where("revisits >= 2").withColumn("significance", F.when(F.col("revisits") >= 3, "high").otherwise("medium"))


def f5_progression(spark, folder):
    """Clusters whose last third of nodes brings at least three terms that the first third lacks, and more terms than it."""
    n = numbered(nodes(spark, folder).where("cluster_id is not null and create_time is not null").select("id", "cluster_id", "create_time"), ["cluster_id"], ["create_time", "id"], "at")
    sized = n.join(n.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id").withColumn("third", F.expr("n div 3"))
    part = sized.withColumn("part", F.when(F.col("at") < F.col("third"), "early").when(F.col("at") >= F.col("n") - F.col("third"), "late")).where("part is not null").select("id", "part")
    seen = _terms(spark, folder).join(part, "id").groupBy("cluster_id", "term").agg(F.max((F.col("part") == "early").cast("int")).alias("early"), F.max((F.col("part") == "late").cast("int")).alias("late"))
    got = seen.groupBy("cluster_id").agg(F.sum("early").alias("early"), F.sum("late").alias("late"), F.count_if((F.col("late") == 1) & (F.col("early") == 0)).alias("fresh"))
    return got.where("fresh >= 3 and late > early")


def f6_surge(spark, folder):
    """Nodes of the last 14 days before the newest one, by cluster, if there are at least five and three in the largest cluster."""
    n = nodes(spark, folder).where("create_time is not null")
    latest = n.agg(F.max("create_time").alias("top"))
    recent = n.crossJoin(F.broadcast(latest)).where(F.col("create_time") >= F.col("top") - 14 * DAY)  # one row
    counts = cut(recent.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")))
    both = counts.agg(F.sum("n").alias("whole"), F.max("n").alias("largest"))
    return counts.crossJoin(F.broadcast(both)).where("whole >= 5 and largest >= 3 and cluster_id is not null").select("cluster_id", "n")  # one row


def f7_transitions(spark, folder):
    return _visits(spark, folder).where("prev_cluster_id is not null").groupBy(F.col("prev_cluster_id").alias("from_cluster"), F.col("cluster_id").alias("to_cluster")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def recency(created, updated, now: int):
    """new, active, recent, dormant, stale or unknown, from the latest creation and update in epoch seconds."""
    since = lambda c: (F.lit(now) - c) / DAY
    by = lambda c: F.when(since(c) <= 30, "recent").when(since(c) <= 90, "dormant").otherwise("stale")
    return F.when(created.isNull() & updated.isNull(), "unknown").when(since(created) <= 7, "new").when(updated.isNotNull(), F.when(since(updated) <= 7, "active").otherwise(by(updated))).otherwise(by(created))


def f8_recency(spark, folder):
    rows = table(spark, folder, "graph_nodes").where("id is not null").select("id", "updated_at", trimmed("cluster_id").alias("cluster_id"), "create_time", F.unix_seconds(F.col("updated_at").cast("timestamp")).alias("update_time"))
    got = current_rows(rows, ["id"], ["updated_at"], ["cluster_id", "create_time", "update_time"]).where("cluster_id is not null").groupBy("cluster_id").agg(F.max("create_time").alias("c"), F.max("update_time").alias("u"))
    return got.select("cluster_id", recency(F.col("c"), F.col("u"), NOW).alias("recency"))


def _talk(spark, folder) -> DataFrame:
    rows = table(spark, folder, "messages").select(trimmed("conversation_id").alias("conversation_id"), trimmed("msg_id").alias("msg_id"), "loaded_at", "row_id", "created_at", "deleted_at", "content", F.lower(trimmed("role")).alias("role"))
    last = current_rows(rows.where("conversation_id <> ''"), ["conversation_id", "msg_id"], ["loaded_at", "row_id"], ["created_at", "deleted_at", "role", "content", "row_id"])
    return last.where("deleted_at is null").withColumn("undated", F.col("created_at").isNull()).drop("loaded_at", "deleted_at")


def a25_messages(spark, folder):
    """Messages that are not deleted, numbered by time within their conversation."""
    return numbered(_talk(spark, folder).select("conversation_id", "msg_id", "role", "undated", "created_at"), ["conversation_id"], ["undated", "created_at", "msg_id"], "turn").select("conversation_id", "turn", "msg_id", "role")


def a26_rendered(spark, folder):
    """Messages as lines, questions and answers marked."""
    return _talk(spark, folder).where("content is not null").select("conversation_id", "msg_id", F.concat(F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise(""), "content").alias("line"))


def f1_qa_pairs(spark, folder):
    got = question_answer_pairs(_talk(spark, folder), ["conversation_id"], ["undated", "created_at", "msg_id"])
    return got.select("conversation_id", "qa_index", F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars"))


def e21_role_usage(spark, folder):
    """Messages and estimated tokens by role."""
    rows = table(spark, folder, "messages").select(F.lower(trimmed("role")).alias("stage"), F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4).alias("tokens"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def e22_cost(spark, folder):
    """The cost of each role's tokens, by prices a million; records are rounded to 8 digits before they are summed."""
    prices = spark.createDataFrame([("user", 0.15), ("human", 0.15), ("assistant", 0.6), ("ai", 0.6), ("model", 0.6), ("system", 0.05)], "stage string, price double")
    rows = table(spark, folder, "messages").select(F.lower(trimmed("role")).alias("stage"), F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4).alias("tokens"))
    priced = rows.join(F.broadcast(prices), "stage").withColumn("cost", F.round(F.col("tokens") * F.col("price") / 1e6, 8).cast("decimal(20,8)"))
    return priced.groupBy("stage").agg(F.sum("cost").cast("double").alias("cost"))


def _sections(spark, folder) -> DataFrame:
    rows = table(spark, folder, "sections").select(trimmed("section_id").alias("section_id"), trimmed("source_id").alias("source_id"), "pos", "role", "content", "loaded_at")
    return current_rows(rows, ["section_id"], ["loaded_at"], ["source_id", "pos", "role", "content"])


def c1_merged_lines(spark, folder):
    return _sections(spark, folder).where("content is not null").select("section_id", F.concat(F.when(F.col("role").isNotNull(), F.concat("role", F.lit(": "))).otherwise(""), "content").alias("line"))


def f9_context_budget(spark, folder):
    """Sections of each source, in order, up to 4,000 characters."""
    got = within_budget(_sections(spark, folder), ["source_id"], ["pos", "section_id"], F.when(F.trim("content") != "", F.length("content")).otherwise(0), 4000)
    return got.select("source_id", "section_id", "running")


def f10_batches(spark, folder):
    """Sections of each source in batches of at most 2,000 estimated tokens."""
    rows = _sections(spark, folder).withColumns({"tokens": F.ceil(F.length(F.coalesce("content", F.lit(""))) / 4), "at": F.struct("pos", "section_id")})
    return packed_batches(rows, ["source_id"], "at", "tokens", 2000, 150).select("source_id", F.col("at.section_id").alias("section_id"), "batch")


def a20_group_hints(spark, folder):
    from kgloom.queries.nested import pages

    return pages(spark, folder).where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("page_id").alias("first_child")).where("children >= 2")


def a6_export_times(spark, folder):
    from kgloom.functions.text import epoch_of_any_unit, epoch_seconds

    return table(spark, folder, "chat_exports").select("export_id", epoch_seconds("create_time").alias("whole"), epoch_of_any_unit("create_time", NOW).alias("any_unit"))


def b8_upserted_vectors(spark, folder):
    """The last vector sent for each id."""
    rows = table(spark, folder, "node_vectors").select(trimmed("id").alias("id"), "updated_at", F.size("embedding").alias("dims"), trimmed("cluster_id").alias("cluster_id"))
    return current_rows(rows.where("id is not null"), ["id"], ["updated_at"], ["dims", "cluster_id"])


def b10_metadata(spark, folder):
    """Node metadata as a store takes it: no nulls, lists as text."""
    return nodes(spark, folder).select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("cluster_id", F.lit("")).alias("cluster_id"), F.coalesce(F.array_join("top_keywords", ","), F.lit("")).alias("top_keywords"))


_NAMES = [
    "a6_export_times", "a20_group_hints", "a25_messages", "a26_rendered", "a28_nodes", "b8_upserted_vectors", "b10_metadata", "c1_merged_lines", "c3_keyword_string", "c10_keyword_search", "d4_assignments", "d5_subcluster_of", "e3_cluster_sizes",
    "e6_subcluster_keywords", "e8_coverage", "e9_keyword_frequency", "e10_cross_cluster", "e15_graph_stats", "e16_cluster_keywords", "e17_time_stats", "e20_store_stats", "e21_role_usage", "e22_cost", "e28_majority_cluster", "e29_best_scores",
    "e30_evidence", "f1_qa_pairs", "f3_cluster_runs", "f4_revisits", "f5_progression", "f6_surge", "f7_transitions", "f8_recency", "f9_context_budget", "f10_batches",
]
QUERIES = {n: globals()[n] for n in _NAMES}

_T = "E' \\t\\r\\n' || chr(160)"
_N = f"""n AS (SELECT id, trim(orig_id, {_T}) AS orig_id, title, trim(cluster_id, {_T}) AS cluster_id, list_transform(keywords, lambda k: trim(k.term, {_T})) AS terms, list_transform(keywords, lambda k: k.score) AS scores, top_keywords, create_time, num_sections, source_type, updated_at
  FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
kt AS (SELECT id, cluster_id, pos, term, score FROM (SELECT id, cluster_id, unnest(terms) AS term, unnest(scores) AS score, generate_subscripts(terms, 1) AS pos FROM n) WHERE term <> ''), k5 AS (SELECT * FROM kt WHERE pos <= 5)"""
_A = f"""a AS (SELECT conversation_id AS id, CASE WHEN regexp_extract(cluster_id, '([0-9]+)\\s*$', 1) <> '' THEN 'cluster_' || regexp_extract(cluster_id, '([0-9]+)\\s*$', 1)::INT END AS assigned, confidence FROM assignments
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY assigned_at DESC, assigned DESC NULLS LAST, confidence DESC NULLS LAST) = 1),
na AS (SELECT n.id, coalesce(assigned, 'unknown') AS cluster_id, coalesce(confidence, 0.0) AS confidence FROM n LEFT JOIN a USING (id)), sm AS (SELECT id AS subcluster_id, unnest(list_distinct(node_ids)) AS id FROM subclusters)"""
_MSG = f"""t AS (SELECT trim(conversation_id, {_T}) AS conversation_id, trim(msg_id, {_T}) AS msg_id, lower(trim(role, {_T})) AS role, content, created_at, created_at IS NULL AS undated FROM (
  SELECT * FROM messages WHERE trim(conversation_id, {_T}) <> '' QUALIFY row_number() OVER (PARTITION BY trim(conversation_id, {_T}), trim(msg_id, {_T}) ORDER BY loaded_at DESC, row_id DESC) = 1) WHERE deleted_at IS NULL)"""
_SEC = f"s AS (SELECT trim(section_id, {_T}) AS section_id, trim(source_id, {_T}) AS source_id, pos, role, content FROM sections QUALIFY row_number() OVER (PARTITION BY trim(section_id, {_T}) ORDER BY loaded_at DESC) = 1)"
_RUNS = f"""o AS (SELECT DISTINCT trim(user_id, {_T}) AS user_id, substring(trim(id, {_T}), length(trim(user_id)) + 2) AS orig_id FROM node_vectors WHERE user_id IS NOT NULL),
q AS (SELECT user_id, id, cluster_id, create_time, lag(cluster_id) OVER (PARTITION BY user_id ORDER BY create_time, id) AS p FROM n JOIN o USING (orig_id) WHERE cluster_id IS NOT NULL AND create_time IS NOT NULL), r AS (SELECT * FROM q WHERE p IS NULL OR p <> cluster_id)"""
_W = f"WITH {_N}, {_A} "
SQL = {
    "a28_nodes": _W + "SELECT id, orig_id, cluster_id, num_sections, source_type, coalesce(len(terms), -1)::INT AS n_terms FROM n".replace("coalesce(len(terms), -1)", "len(terms)"),
    "c3_keyword_string": _W + "SELECT id, array_to_string(list_filter(terms, lambda t: t IS NOT NULL)[1:3], ',') AS keywords FROM n",
    "c10_keyword_search": _W + "SELECT id, cluster_id FROM n WHERE len(list_filter(terms, lambda t: contains(lower(t), 'plan'))) > 0",
    "d4_assignments": _W + "SELECT * FROM na", "e3_cluster_sizes": _W + "SELECT cluster_id, count(*) AS size, round(avg(confidence), 4) AS confidence FROM na GROUP BY 1",
    "d5_subcluster_of": _W + "SELECT n.id, subcluster_id FROM n LEFT JOIN sm USING (id)",
    "e6_subcluster_keywords": _W + "SELECT subcluster_id, term, score::DOUBLE AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subcluster_id ORDER BY score DESC, term) AS r FROM (SELECT subcluster_id, term, sum(round(score, 6)::DECIMAL(12,6)) AS score FROM sm JOIN kt USING (id) GROUP BY ALL)) WHERE r <= 5",
    "e8_coverage": _W + "SELECT count(*) AS nodes, count(h) AS covered, round(count(h) / count(*), 6) AS share FROM n LEFT JOIN (SELECT DISTINCT id, 1 AS h FROM sm) USING (id)",
    "e9_keyword_frequency": _W + "SELECT term, count(*) AS count, count(DISTINCT id) AS nodes, count(DISTINCT cluster_id) AS clusters FROM k5 GROUP BY term HAVING count(*) >= 2",
    "e10_cross_cluster": _W + "SELECT term, count(DISTINCT cluster_id) AS clusters FROM k5 GROUP BY term HAVING count(*) >= 2 AND count(DISTINCT cluster_id) >= 2",
    "e15_graph_stats": _W + "SELECT count(*) AS nodes, count(DISTINCT cluster_id) AS clusters, min(create_time) AS first, max(create_time) AS last, round(avg(num_sections), 6) AS sections FROM n",
    "e16_cluster_keywords": _W + "SELECT cluster_id, term, count, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, term) AS r FROM (SELECT cluster_id, term, count(*) AS count FROM k5 WHERE cluster_id IS NOT NULL GROUP BY ALL)) WHERE r <= 10",
    "e17_time_stats": _W + f"SELECT cluster_id, min(create_time) AS earliest, max(create_time) AS latest, (max(create_time) - min(create_time)) // {DAY} AS span_days, ({NOW} - max(create_time)) // {DAY} AS days_since FROM n WHERE cluster_id IS NOT NULL GROUP BY 1",
    "e29_best_scores": _W + "SELECT cluster_id, term, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS r FROM (SELECT cluster_id, term, max(score) AS score FROM kt WHERE cluster_id IS NOT NULL GROUP BY ALL)) WHERE r <= 5",
    "e20_store_stats": "SELECT count(DISTINCT id) AS ids, count(DISTINCT orig_id) AS orig_ids, count(DISTINCT source_type) AS types FROM (SELECT * FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)",
    "e28_majority_cluster": _W + "SELECT source_type, arg_min(cluster_id, (-c, cluster_id)) AS cluster_id, max(c) AS votes FROM (SELECT source_type, cluster_id, count(*) AS c FROM n WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "e30_evidence": _W + """, f AS (SELECT term, count(*) AS c, count(DISTINCT cluster_id) AS d FROM k5 GROUP BY term HAVING count(*) >= 2)
SELECT 'repeated keyword' AS kind, term, round(least(1.0, c / 5), 6) AS confidence FROM f UNION ALL SELECT 'cross cluster', term, round(least(1.0, d / 3), 6) FROM f WHERE d >= 2""",
    "f3_cluster_runs": f"WITH {_N}, {_RUNS} SELECT user_id, id, cluster_id, create_time FROM r",
    "f4_revisits": f"WITH {_N}, {_RUNS} SELECT user_id, cluster_id, count(*) - 1 AS revisits, CASE WHEN count(*) > 3 THEN 'high' ELSE 'medium' END AS significance FROM r GROUP BY 1, 2 HAVING count(*) > 2",
    "f7_transitions": f"WITH {_N}, {_RUNS} SELECT p AS from_cluster, cluster_id AS to_cluster, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "f5_progression": f"""WITH {_N}, o AS (SELECT id, row_number() OVER (PARTITION BY cluster_id ORDER BY create_time, id) - 1 AS o_at, count(*) OVER (PARTITION BY cluster_id) AS c FROM n WHERE cluster_id IS NOT NULL AND create_time IS NOT NULL),
g AS (SELECT cluster_id, term, max((o_at < c // 3)::INT) AS e, max((o_at >= c - c // 3)::INT) AS l FROM k5 JOIN o USING (id) WHERE o_at < c // 3 OR o_at >= c - c // 3 GROUP BY ALL)
SELECT cluster_id, sum(e)::BIGINT AS early, sum(l)::BIGINT AS late, count(*) FILTER (l = 1 AND e = 0) AS fresh FROM g GROUP BY 1 HAVING count(*) FILTER (l = 1 AND e = 0) >= 3 AND sum(l) > sum(e)""",
    "f6_surge": _W + f"""SELECT cluster_id, c AS n FROM (SELECT cluster_id, count(*) AS c, sum(count(*)) OVER () AS w, max(count(*)) OVER () AS m FROM n WHERE create_time >= (SELECT max(create_time) FROM n) - {14 * DAY} GROUP BY 1) WHERE w >= 5 AND m >= 3 AND cluster_id IS NOT NULL""",
    "f8_recency": _W + f"""SELECT cluster_id, CASE WHEN c IS NULL AND u IS NULL THEN 'unknown' WHEN ({NOW} - c) / {DAY} <= 7 THEN 'new' WHEN u IS NOT NULL THEN CASE WHEN ({NOW} - u) / {DAY} <= 7 THEN 'active' WHEN ({NOW} - u) / {DAY} <= 30 THEN 'recent' WHEN ({NOW} - u) / {DAY} <= 90 THEN 'dormant' ELSE 'stale' END
  WHEN ({NOW} - c) / {DAY} <= 30 THEN 'recent' WHEN ({NOW} - c) / {DAY} <= 90 THEN 'dormant' ELSE 'stale' END AS recency FROM (SELECT cluster_id, max(create_time) AS c, max(floor(epoch(updated_at))) AS u FROM n WHERE cluster_id IS NOT NULL GROUP BY 1)""",
    "a25_messages": f"WITH {_MSG} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY undated, created_at, msg_id) - 1 AS turn, msg_id, role FROM t",
    "a26_rendered": f"WITH {_MSG} SELECT conversation_id, msg_id, CASE role WHEN 'user' THEN 'Q: ' WHEN 'assistant' THEN 'A: ' ELSE '' END || content AS line FROM t WHERE content IS NOT NULL",
    "f1_qa_pairs": f"""WITH {_MSG}, z AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM t WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conversation_id ORDER BY undated, created_at, msg_id)),
y AS (SELECT conversation_id, pc, content, row_number() OVER (PARTITION BY conversation_id ORDER BY undated, created_at, msg_id) - 1 AS qa_index FROM z WHERE role = 'assistant' AND pr = 'user')
SELECT conversation_id, qa_index, length(pc)::INT AS question_chars, length(content)::INT AS answer_chars FROM y WHERE length(pc) >= 5 AND length(content) >= 20""",
    "e21_role_usage": f"SELECT lower(trim(role, {_T})) AS stage, count(*) AS calls, sum(ceil(length(coalesce(content, '')) / 4)::BIGINT)::BIGINT AS tokens FROM messages GROUP BY 1",
    "e22_cost": f"""SELECT stage, sum(round(ceil(length(coalesce(content, '')) / 4) * price / 1e6, 8)::DECIMAL(20,8))::DOUBLE AS cost FROM (SELECT lower(trim(role, {_T})) AS stage, content FROM messages)
JOIN (VALUES ('user', 0.15), ('human', 0.15), ('assistant', 0.6), ('ai', 0.6), ('model', 0.6), ('system', 0.05)) v(stage, price) USING (stage) GROUP BY 1""",
    "c1_merged_lines": f"WITH {_SEC} SELECT section_id, coalesce(role || ': ', '') || content AS line FROM s WHERE content IS NOT NULL",
    "f9_context_budget": f"""WITH {_SEC} SELECT source_id, section_id, run AS running FROM (SELECT *, sum(length(content)) OVER (PARTITION BY source_id ORDER BY pos, section_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s WHERE trim(content, ' ') <> '') WHERE run <= 4000""",
    "a20_group_hints": r"""SELECT parent, count(*) AS children, min(page_id) AS first_child FROM (SELECT lower(regexp_replace(id, '[\s\-]', '', 'g')) AS page_id, lower(regexp_replace(parent_id, '[\s\-]', '', 'g')) AS parent FROM page_tree
QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '[\s\-]', '', 'g')) ORDER BY loaded_at DESC) = 1) WHERE parent <> '' GROUP BY 1 HAVING count(*) >= 2""",
    "a6_export_times": f"""SELECT export_id, floor(try_cast(create_time AS DOUBLE))::BIGINT AS whole, coalesce(floor(CASE WHEN try_cast(create_time AS DOUBLE) > 1e10 THEN try_cast(create_time AS DOUBLE) / 1000 ELSE try_cast(create_time AS DOUBLE) END)::BIGINT, {NOW}) AS any_unit FROM chat_exports""",
    "b8_upserted_vectors": f"SELECT trim(id, {_T}) AS id, len(embedding)::INT AS dims, trim(cluster_id, {_T}) AS cluster_id FROM node_vectors QUALIFY row_number() OVER (PARTITION BY trim(id, {_T}) ORDER BY updated_at DESC) = 1",
    "b10_metadata": _W + "SELECT id, coalesce(title, '') AS title, coalesce(cluster_id, '') AS cluster_id, coalesce(array_to_string(top_keywords, ','), '') AS top_keywords FROM n",
}
