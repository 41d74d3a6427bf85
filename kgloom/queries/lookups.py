"""Queries over lookups, merged entities, retrieval and texts that carry records, and relational forms of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom.functions.register import register
from kgloom.functions.text import cluster_number, epoch_of_any_unit, epoch_of_date, json_is_whole, without_outer_punctuation
from kgloom.operators import entities as E
from kgloom.operators import lookup as L
from kgloom.operators import parsing as T
from kgloom.operators import projections as P
from kgloom.operators import retrieval as R
from kgloom.operators.density import density_clusters
from kgloom.operators.similarity import pooled
from kgloom.operators.trees import tree_edges
from kgloom.queries import graph as G
from kgloom.queries.nested import BLOCK_TABLES, block_nodes
from kgloom.sources.graph_files import shown_edges
from kgloom.sources.tables import table


def a7_epochs(spark, folder):
    return table(spark, folder, "chat_exports").select("export_id", epoch_of_any_unit("create_time", 0).alias("created"))


def a10_front_matter(spark, folder):
    text = F.concat(F.lit("---\ntitle: \""), F.col("s_name"), F.lit("\"\ncreated: 2024-02-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit("\nnation:  "), F.col("s_nationkey").cast("string"), F.lit(" \n---\nBody of "), F.col("s_name"))
    rows = T.front_matter(table(spark, folder, "supplier").select("s_suppkey", text.alias("text")), "text")
    return rows.select("s_suppkey", F.col("fm_title").alias("title"), F.col("fm_created").alias("created"), F.try_element_at("front", F.lit("nation")).alias("nation"), "body")


def b5_shown_edges(spark, folder):
    rows = G.edges(spark, folder).withColumn("confidence", F.when(F.col("weight") >= 0.4, "high").otherwise("medium")).withColumn("is_intra_cluster", F.when(F.col("source") % 2 == 0, True))
    return shown_edges(rows).withColumn("weight", F.round("weight", 6))


def b12_merged_entities(spark, folder):
    side = lambda t, key, nation: table(spark, folder, t).groupBy(F.col(nation).alias("name")).agg(F.array_sort(F.collect_set(F.col(key) % 50)).alias("ids"), F.lit(t).alias("first_seen"))
    rows = E.merged_entities(side("supplier", "s_suppkey", "s_nationkey"), side("customer", "c_custkey", "c_nationkey"), ["name"], ["ids"])
    return rows.select("name", F.array_join(F.array_sort("ids"), ",").alias("ids"), "first_seen")


def b13_merged_relations(spark, folder):
    side = lambda t, start, target, weight: table(spark, folder, t).groupBy((F.col(start) % 10).alias("start"), F.lit("in").alias("type"), F.col(target).alias("target")).agg(F.array_sort(F.collect_set(F.concat(F.lit(t[0]), (F.col(start) % 7).cast("string")))).alias("source_ids"), F.lit(weight).alias("weight"))
    rows = E.merged_relations(side("supplier", "s_suppkey", "s_nationkey", 1.0), side("customer", "c_custkey", "c_nationkey", 2.0))
    return rows.select("start", "type", "target", F.array_join("source_ids", ",").alias("source_ids"), "weight")


def _ingested(spark, folder):
    every = block_nodes(spark, folder).where("key is not null").distinct()
    chunk = F.concat_ws(":", F.col("rec_id").cast("string"), "parent_key")
    found = every.where("kind = 'micro_node'").select("pre", F.col("pre").alias("pos"), F.col("key").alias("name"), F.lit("thing").alias("type"), F.lit(None).cast("string").alias("description"), chunk.alias("chunk_id"))
    end = lambda c: F.trim(F.get_json_object("body", f"$.{c}")).alias(c)
    links = every.where("kind = 'micro_edge'").select(end("start"), end("type"), end("target"), chunk.alias("chunk_id")).where("start is not null and type is not null and target is not null")
    chunks = every.where("kind = 'block'").select(F.concat_ws(":", F.col("rec_id").cast("string"), "key").alias("chunk_id"), F.lit("x").alias("text"))
    return E.ingested(found.select("pos", "name", "type", "description", "chunk_id"), links, chunks.distinct())


def b14_entity_chunks(spark, folder):
    return _ingested(spark, folder)["entity_chunk"]


def b15_relations(spark, folder):
    return _ingested(spark, folder)["relations"].select("start", "type", "target", F.size("source_ids").alias("sources"))


def b20_filled_ids(spark, folder):
    nodes = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("conv_"), F.col("n_regionkey").cast("string")).alias("orig_id"))
    return P.filled_ids(nodes, table(spark, folder, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("uuid")))


def c2_merged_sources(spark, folder):
    parts = [table(spark, folder, t).select(F.col(f"{t[0]}_{k}").cast("string").alias("source_id"), F.lit(t).alias("kind")) for t, k in (("supplier", "suppkey"), ("customer", "custkey"))]
    return P.merged_sources(parts)


def c13_local_types(spark, folder):
    names = table(spark, folder, "region").where("r_regionkey < 3").select(F.col("r_name").alias("name"), F.lower("r_name").alias("local"))
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("types"))
    return P.localised(rows, "types", names).select("n_nationkey", F.array_join("types", "|").alias("types"))


def _pictured(spark, folder):
    n = F.col("s_suppkey")
    return table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("See <image page=\""), (n % 5).cast("string"), F.lit("\" index=\"1\"> and <image page="), (n % 3).cast("string"), F.lit(" index=2 />.")).alias("text"))


def c14_image_tags(spark, folder):
    return P.image_tags(_pictured(spark, folder), "s_suppkey", "text")


def i36_captions(spark, folder):
    captions = table(spark, folder, "region").select(F.col("r_regionkey").alias("page"), F.lit(1).alias("index"), F.col("r_name").alias("caption"))
    return P.with_captions(_pictured(spark, folder), "s_suppkey", "text", captions).select("s_suppkey", "text")


def c15_chat_sources(spark, folder):
    return P.chat_sources(table(spark, folder, "sections"))


def c18_fits_one_run(spark, folder):
    return P.fits_one_run(table(spark, folder, "lineitem").select("l_suppkey"), "l_suppkey", 5, 30)


def d8_edge_ends(spark, folder):
    nodes = G.vectors(spark, folder).select(F.col("vec_id").alias("node"), "label")
    return L.edge_ends(G.edges(spark, folder).select("source", "target"), nodes, ["label"])


def d10_hits_with_nodes(spark, folder):
    hits = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string"))).alias("orig_id"), (F.col("c_custkey") % 33).alias("node_id"))
    nodes = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("orig_id"), F.col("n_name").alias("title"))
    return L.hits_with_nodes(hits, nodes, ["title"]).select("c_custkey", "title")


def d11_tree_edges(spark, folder):
    n = table(spark, folder, "nation")
    text = lambda c: F.col(c).cast("string")
    tree = n.select(text("n_nationkey").alias("id"), text("n_regionkey").alias("parent_id"))
    nodes = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("page_"), text("n_nationkey")).alias("orig_id"), (F.col("n_nationkey") % 3).alias("cluster_id"))
    known = n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("bigint").alias("source"), F.col("n_regionkey").cast("bigint").alias("target"))
    return tree_edges(tree, nodes, known)


def d12_entities_of_graphs(spark, folder):
    links = _ingested(spark, folder)["entity_chunk"]
    hits = links.select("chunk_id").distinct().select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("bigint").alias("query"), "chunk_id")
    return R.entities_of_chunks(hits, links)


def l3_chunks_of_entities(spark, folder):
    links = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("chunk_id")).distinct()
    found = table(spark, folder, "part").select((F.col("p_partkey") % 10).alias("query"), F.col("p_partkey").alias("name"))
    return R.chunks_of_entities(found, links).select("query", "chunk_id", F.size("names").alias("names"))


def d13_joined_chunks(spark, folder):
    vectors = G.g1_top_matches(spark, folder).select(F.col("source").alias("query"), F.col("target").alias("chunk_id"), "rank")
    linked = G.j9_one_hop(spark, folder).select(F.col("node").alias("query"), F.col("peer").alias("chunk_id"))
    return R.joined_chunks(vectors, linked)


def _label_questions(spark, folder):
    means = pooled(G.vectors(spark, folder), ["label"], "embedding")
    return means.select(F.col("label").cast("bigint").alias("query"), "vector")


def g3_nearest_items(spark, folder):
    """The five vectors nearest to each label's mean among those of even id."""
    items = G.vectors(spark, folder).select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return R.vector_search(_label_questions(spark, folder), items, 5, F.col("item") % 2 == 0).withColumn("score", F.round("score", 6))


def f16_ordered_blocks(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("string").alias("block_id")).distinct()
    paths = lines.where("block_id <> '2'").groupBy("graph_id").agg(F.array(F.sort_array(F.collect_set("block_id"), False)).alias("paths"))
    return P.ordered_blocks(lines, paths).select("graph_id", "block_id", "order_index")


def g8_most_significant(spark, folder):
    level = F.element_at(F.array(*map(F.lit, ("low", "high", "odd", "medium"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return P.most_significant(table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("title"), level.alias("level")), "level", 3)


def i7_bare_words(spark, folder):
    rows = table(spark, folder, "graph_nodes").select("id", F.explode(F.split("title", " ")).alias("w")).distinct()
    return rows.select("id", "w", without_outer_punctuation("w").alias("bare"))


def i28_dates(spark, folder):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, folder, "orders").select("o_orderkey", epoch_of_date(text).alias("at"))


def i31_answers(spark, folder):
    """JSON out of answers of models, by the function registered for SQL."""
    register(spark)
    n = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Sure! ```json\n{\"id\": "), n, F.lit("}\n``` Anything else?"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("The list is [1, "), n, F.lit("] as asked"))).otherwise("none {")
    return table(spark, folder, "orders").select("o_orderkey", text.alias("text")).selectExpr("o_orderkey", "kg_extract_json(text) AS json")


def i32_whole_json(spark, folder):
    rows = table(spark, folder, "block_graphs").select("graph_id", "block_graph").distinct()
    return rows.select("graph_id", json_is_whole("block_graph").alias("whole"), json_is_whole(F.left("block_graph", F.lit(200))).alias("part"))


def i33_assignments(spark, folder):
    text = F.expr("concat('conversation_id=', o_orderkey, ' | cluster_id=', if(o_orderkey % 2 = 0, '', 'cluster_'), o_custkey % 7, if(o_orderkey % 3 = 0, '', concat(' | confidence: ', o_custkey % 100, '%')))")
    return T.assignment_lines(table(spark, folder, "orders").select(text.alias("line")), "line").withColumn("confidence", F.round("confidence", 6))


def i37_numbers(spark, folder):
    return table(spark, folder, "assignments").select("cluster_id").distinct().select("cluster_id", cluster_number(F.trim("cluster_id")).alias("number"))


def i42_progress(spark, folder):
    line = F.expr("if(s_suppkey % 2 = 0, concat('PROGRESS:step', s_suppkey, ':12.5:', s_suppkey % 8, ':8:3.25'), concat('STEP_START:step', s_suppkey))")
    return T.progress_lines(table(spark, folder, "supplier").select(line.alias("line")), "line")


def j12_nodes_of_groups(spark, folder):
    nodes = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("group"))
    return L.nodes_of_groups(nodes, table(spark, folder, "region").where("r_name like 'A%'").select(F.col("r_regionkey").alias("group")))


def j15_standard_names(spark, folder):
    variants = table(spark, folder, "nation").select(F.lit("place").alias("type"), F.upper("n_name").alias("variant"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("standard")).where("standard <> 'N3'")
    frame = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.concat(F.lit("  "), F.initcap("n_name")).alias("place"))
    return E.standard_names(frame, ["place"], variants)


def k3_density_clusters(spark, folder):
    """Clusters of different density among each label's vectors."""
    return density_clusters(G.vectors(spark, folder), "label", "vec_id", "embedding", least_size=3)


def l6_contexts(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("chunk_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"))
    chunks = table(spark, folder, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("text"))
    return R.contexts(rows, chunks, 40)


def l8_prompts(spark, folder):
    questions = table(spark, folder, "customer").select(F.col("c_custkey").alias("query"), F.col("c_name").alias("question"))
    return R.prompts(l6_contexts(spark, folder), questions)


def s13_lists(spark, folder):
    rows = table(spark, folder, "graph_nodes").select("id", L.comma_list("top_keywords").alias("text")).distinct()
    return rows.select("id", "text", F.size(L.from_comma_list("text")).alias("items"))


def r_ntile(spark, folder):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("place"), F.round(F.cume_dist().over(w), 6).alias("share"))


def r_range_frame(spark, folder):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey").rangeBetween(-100, 100)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("near"))


def r_right_join(spark, folder):
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), F.expr("o_custkey = c_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


_SQL_VIEW = "SELECT n_name AS nation, count(*) AS customers, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS owing FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1"


def r_sql_view(spark, folder):
    """A query given as SQL."""
    for name in ("customer", "nation"):
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(_SQL_VIEW)


_NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"]
QUERIES = {n: globals()[n] for n in _NAMES}

_W = G._W
_INGESTED = f"""WITH {BLOCK_TABLES},
mn AS (SELECT DISTINCT trim(CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE x->>'$.name' END) AS name, rec_id, block_id FROM n WHERE json_type(x) <> 'NULL'),
me AS (SELECT DISTINCT rec_id, block_id, trim(coalesce(x->>'$.start', x->>'$.source')) AS s, trim(CASE json_type(x, '$.type') WHEN 'ARRAY' THEN x->>'$.type[0]' ELSE x->>'$.type' END) AS t, trim(x->>'$.target') AS g FROM d)
"""
SQL = {
    "a7_epochs": "SELECT export_id, coalesce(floor(CASE WHEN x > 1e10 THEN x / 1000 ELSE x END)::BIGINT, 0) AS created FROM (SELECT export_id, TRY_CAST(create_time AS DOUBLE) AS x FROM chat_exports)",
    "a10_front_matter": "SELECT s_suppkey, s_name AS title, epoch(DATE '2024-02-01' + (s_suppkey % 28)::INT)::BIGINT AS created, s_nationkey::VARCHAR AS nation, 'Body of ' || s_name AS body FROM supplier",
    "b5_shown_edges": _W + "SELECT source, target, round(s, 6) AS weight, CASE WHEN s >= 0.4 THEN 'hard' ELSE 'insight' END AS type, source % 2 = 0 AS is_intra_cluster FROM l",
    "b12_merged_entities": """WITH a AS (SELECT s_nationkey AS name, s_suppkey % 50 AS id, 1 AS o FROM supplier UNION SELECT c_nationkey, c_custkey % 50, 2 FROM customer)
SELECT name, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids, CASE min(o) WHEN 1 THEN 'supplier' ELSE 'customer' END AS first_seen FROM a GROUP BY name""",
    "b13_merged_relations": """WITH a AS (SELECT s_suppkey % 10 AS start, s_nationkey AS target, 's' || (s_suppkey % 7) AS src, 1.0 AS w FROM supplier UNION SELECT c_custkey % 10, c_nationkey, 'c' || (c_custkey % 7), 2.0 FROM customer)
SELECT start, 'in' AS type, target, array_to_string(list(src ORDER BY w, src), ',') AS source_ids, min(w)::DOUBLE AS weight FROM a GROUP BY start, target""",
    "b14_entity_chunks": _INGESTED + "SELECT DISTINCT name, rec_id || ':' || block_id AS chunk_id FROM mn WHERE name <> ''",
    "b15_relations": _INGESTED + "SELECT s AS start, t AS type, g AS target, count(DISTINCT (rec_id, block_id)) AS sources FROM me WHERE s IS NOT NULL AND t IS NOT NULL AND g IS NOT NULL GROUP BY ALL",
    "b20_filled_ids": "SELECT n_nationkey, 'conv_' || n_regionkey AS orig_id, r_name AS uuid FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "c2_merged_sources": "SELECT 'src0_' || s_suppkey AS source_id, 'supplier' AS kind FROM supplier UNION ALL SELECT 'src1_' || c_custkey, 'customer' FROM customer",
    "c13_local_types": "SELECT n_nationkey, CASE WHEN r_regionkey < 3 THEN lower(r_name) ELSE r_name END || '|' || n_name AS types FROM nation JOIN region ON n_regionkey = r_regionkey",
    "c14_image_tags": """SELECT s_suppkey, 0 AS pos, (s_suppkey % 5)::INT AS page, 1 AS "index" FROM supplier UNION ALL SELECT s_suppkey, 1, (s_suppkey % 3)::INT, 2 FROM supplier""",
    "i36_captions": "SELECT s_suppkey, 'See ' || coalesce(r_name, '') || ' and .' AS text FROM supplier LEFT JOIN region ON r_regionkey = s_suppkey % 5",
    "c15_chat_sources": "SELECT DISTINCT source_id FROM sections WHERE lower(trim(role)) IN ('user', 'assistant', 'system', 'human', 'ai', 'model', 'tool')",
    "c18_fits_one_run": "SELECT l_suppkey, count(*) AS chunks, count(*) // 5 AS batches, count(*) // 5 < 30 AS fits FROM lineitem GROUP BY l_suppkey",
    "d8_edge_ends": _W + "SELECT source, target, la AS source_label, lb AS target_label FROM l",
    "d10_hits_with_nodes": "SELECT c_custkey, coalesce(a.n_name, b.n_name) AS title FROM customer LEFT JOIN nation a ON c_custkey % 2 = 0 AND a.n_nationkey = c_custkey % 40 LEFT JOIN nation b ON b.n_nationkey = c_custkey % 33 WHERE coalesce(a.n_name, b.n_name) IS NOT NULL",
    "d11_tree_edges": """WITH e AS (SELECT n_regionkey::BIGINT AS source, n_nationkey::BIGINT AS target FROM nation WHERE n_regionkey <> n_nationkey), k AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey % 4 = 0)
SELECT source, target, 1.0::DOUBLE AS weight, 'hierarchical' AS type, source % 3 = target % 3 AS is_intra FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE (a = source AND b = target) OR (a = target AND b = source))
QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target)) = 1""",
    "d12_entities_of_graphs": _INGESTED + "SELECT DISTINCT rec_id AS query, name FROM mn WHERE name <> ''",
    "l3_chunks_of_entities": "SELECT l_partkey % 10 AS query, l_orderkey AS chunk_id, count(DISTINCT l_partkey)::INT AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "d13_joined_chunks": _W + """, g AS (SELECT source AS query, target AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS r FROM (SELECT source, target, s FROM p UNION ALL SELECT target, source, s FROM p) WHERE s >= 0.25),
a AS (SELECT query, chunk_id, 0 AS w, r FROM g WHERE r <= 5 UNION ALL SELECT node, peer, 1, 0 FROM both_l), f AS (SELECT query, chunk_id, min((w, r)) AS k FROM a GROUP BY ALL)
SELECT query, chunk_id, CASE k[1] WHEN 0 THEN 'vector' ELSE 'graph' END AS way, row_number() OVER (PARTITION BY query ORDER BY k, chunk_id) AS position FROM f""",
    "g3_nearest_items": _W + "SELECT query, item, score, rank FROM (SELECT mu.label::BIGINT AS query, vec_id AS item, round(least(1.0, greatest(0.0, list_dot_product(u, c))), 6) AS score, row_number() OVER (PARTITION BY mu.label ORDER BY list_dot_product(u, c) DESC, vec_id) AS rank FROM v, mu WHERE vec_id % 2 = 0) WHERE rank <= 5",
    "f16_ordered_blocks": "SELECT graph_id, block_id, CASE WHEN block_id <> '2' THEN row_number() OVER (PARTITION BY graph_id, block_id <> '2' ORDER BY block_id DESC) - 1 END AS order_index FROM (SELECT DISTINCT l_orderkey AS graph_id, l_linenumber::VARCHAR AS block_id FROM lineitem)",
    "g8_most_significant": "SELECT s_suppkey, s_name AS title, ['low', 'high', 'odd', 'medium'][s_suppkey % 4 + 1] AS level FROM supplier ORDER BY CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 0 THEN 3 ELSE 4 END, s_name LIMIT 3",
    "i7_bare_words": r"SELECT id, w, regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS bare FROM (SELECT DISTINCT id, unnest(string_split(title, ' ')) AS w FROM graph_nodes)",
    "i28_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN epoch(o_orderdate::DATE)::BIGINT END AS at FROM orders",
    "i31_answers": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"id": ' || o_orderkey || '}' WHEN 1 THEN '[1, ' || o_orderkey || ']' END AS json FROM orders""",
    "i32_whole_json": """WITH t AS (SELECT DISTINCT graph_id, block_graph AS a, left(block_graph, 200) AS b FROM block_graphs),
w AS (SELECT graph_id, unnest([a, b]) AS x, unnest(['a', 'b']) AS k, a FROM t), c AS (SELECT graph_id, a, k, coalesce(regexp_matches(trim(x), '[}\\]]$') AND len(replace(x, '{', '')) = len(replace(x, '}', '')) AND len(replace(x, '[', '')) = len(replace(x, ']', '')), false) AS y FROM w)
SELECT graph_id, bool_or(y) FILTER (k = 'a') AS whole, bool_or(y) FILTER (k = 'b') AS part FROM c GROUP BY graph_id, a""",
    "i33_assignments": "SELECT o_orderkey AS conversation_id, 'cluster_' || (o_custkey % 7) AS cluster_id, round(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_custkey % 100 > 1 THEN (o_custkey % 100) / 100 ELSE o_custkey % 100 END, 6)::DOUBLE AS confidence FROM orders",
    "i37_numbers": "SELECT DISTINCT cluster_id, TRY_CAST(regexp_extract(trim(cluster_id), '([0-9]+)$', 1) AS INT) AS number FROM assignments",
    "i42_progress": "SELECT CASE WHEN e THEN 'progress' ELSE 'start' END AS kind, 'step' || s_suppkey AS step, CASE WHEN e THEN 12.5::DOUBLE END AS percent, CASE WHEN e THEN (s_suppkey % 8)::INT END AS done, CASE WHEN e THEN 8 END AS total, CASE WHEN e THEN 3.25::DOUBLE END AS eta FROM (SELECT s_suppkey, s_suppkey % 2 = 0 AS e FROM supplier)",
    "j12_nodes_of_groups": """SELECT n_nationkey, n_regionkey AS "group" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'""",
    "j15_standard_names": "SELECT c_custkey, CASE WHEN n_nationkey <> 3 THEN 'N' || n_nationkey ELSE '  ' || array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(n_name, ' ')], ' ') END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "l6_contexts": """WITH t AS (SELECT o_custkey AS query, o_orderkey AS k, o_orderpriority AS x FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT *, sum(len(x)) OVER (PARTITION BY query ORDER BY k) AS s FROM t)
SELECT query, string_agg(x, E'\\n\\n' ORDER BY k) AS context FROM r WHERE s <= 40 GROUP BY query""",
    "s13_lists": "SELECT DISTINCT id, array_to_string(list_filter(top_keywords, lambda x: x IS NOT NULL), ',') AS text, len(list_filter(string_split(coalesce(array_to_string(list_filter(top_keywords, lambda x: x IS NOT NULL), ','), ''), ','), lambda x: trim(x) <> '')) AS items FROM graph_nodes",
    "r_ntile": "SELECT c_custkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS place, round(cume_dist() OVER w, 6) AS share FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)",
    "r_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM lineitem",
    "r_right_join": "SELECT c_custkey, count(o_orderkey) AS orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
    "r_sql_view": _SQL_VIEW,
}
SQL["l8_prompts"] = f"SELECT c_custkey AS query, CASE WHEN context IS NULL THEN 'No passage was found.' ELSE 'Answer from these passages only.' || E'\\n\\n' || context END || E'\\n\\nQuestion: ' || c_name AS prompt FROM customer LEFT JOIN ({SQL['l6_contexts']}) ON query = c_custkey"
