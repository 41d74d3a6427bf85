"""Queries of the training-data problems, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import usable_vectors
from kgloom.llm.chunking import LIMIT, block_texts, cut_texts
from kgloom.llm.leaks import leaks
from kgloom.llm.mixing import mix
from kgloom.llm.mixture import clusters, groups, typical
from kgloom.llm.neighbours import nearest
from kgloom.llm.stuffing import stuffed
from kgloom.llm.terms import marked, ngram_counts
from kgloom.llm.conversations import export_verdicts, fold_events, speaker, verdicts
from kgloom.operators.current import current_rows, trimmed
from kgloom.operators.ranking import numbered
from kgloom.session import cut
from kgloom.sources.tables import table

# 3: splitting oversized items


def _items(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    """The pieces of the current row of every section and block."""
    sections = table(spark, folder, "sections").select(F.lit("section").alias("item_kind"), trimmed("section_id").alias("item_key"), "loaded_at", F.col("content").alias("body"))
    blocks = block_texts(table(spark, folder, "block_graphs")).select(F.lit("block").alias("item_kind"), F.concat_ws(":", F.col("graph_id").cast("string"), "block_id").alias("item_key"), "loaded_at", F.col("raw_text").alias("body"))
    done = cut_texts(sections.unionByName(blocks), "body", with_text=with_text)
    return done.groupBy("item_kind", "item_key").agg(F.max(F.struct("loaded_at", "n_chars", "pieces")).alias("r")).select("item_kind", "item_key", "r.n_chars", "r.pieces")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder, with_text=False).where(F.col("n_chars") > LIMIT)
    return items.select("item_kind", "item_key", F.expr("if(exists(pieces, p -> p.cut = 'forced'), 'forced', 'natural')").alias("cut"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every item as pieces with their place in it."""
    return _items(spark, folder, with_text=True).selectExpr("item_kind", "item_key", "inline(pieces)")


# 7: conversations


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = verdicts(fold_events(table(spark, folder, "messages"))).where("faults > 0").select(F.lit("messages").alias("origin"), F.col("conversation_id").alias("conv_key"))
    exports = export_verdicts(table(spark, folder, "chat_exports")).where("faults > 0").select(F.lit("chat_exports").alias("origin"), F.col("export_id").cast("string").alias("conv_key"))
    return rows.unionByName(exports)


def p7_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The usable turns of the conversations that stay, in order."""
    messages = table(spark, folder, "messages")
    turns = verdicts(fold_events(messages), turns=True).withColumn("undated", F.col("created_at").isNull())
    turns = numbered(turns, ["conversation_id"], ["depth", "undated", "created_at", "msg_id"], "turn")
    said = turns.join(messages.select("row_id", speaker(F.col("role")).alias("role"), "content"), "row_id")
    rows = said.select(F.lit("messages").alias("origin"), F.col("conversation_id").alias("conv_key"), "turn", "role", "content")
    exports = export_verdicts(table(spark, folder, "chat_exports"), turns=True)
    return rows.unionByName(exports.select(F.lit("chat_exports").alias("origin"), F.col("export_id").cast("string").alias("conv_key"), F.col("turn").cast("bigint").alias("turn"), "role", "content"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p7_found": p7_found, "p7_conversations": p7_conversations}

SQL: dict[str, str] = {
    "p3_found": r"""WITH items AS (
  SELECT 'section' AS item_kind, trim(section_id, E' \t\r\n') AS item_key, trim(content, E' \t\r\n') AS body FROM sections QUALIFY row_number() OVER (PARTITION BY trim(section_id, E' \t\r\n') ORDER BY loaded_at DESC) = 1
  UNION ALL
  SELECT 'block', graph_id || ':' || trim(v->>'$.block_id'), trim(v->>'$.raw_text', E' \t\r\n') FROM (
    SELECT graph_id, unnest(CASE json_type(j, '$.blocks') WHEN 'ARRAY' THEN json_extract(j, '$.blocks[*]') ELSE CASE WHEN json_extract(j, '$.blocks.block_id') IS NULL THEN json_extract(j, '$.blocks.*') ELSE [json_extract(j, '$.blocks')] END END) AS v FROM (
      SELECT graph_id, CASE json_type(block_graph::JSON, '$.block_graph') WHEN 'VARCHAR' THEN (block_graph->>'$.block_graph')::JSON WHEN 'OBJECT' THEN json_extract(block_graph::JSON, '$.block_graph') ELSE block_graph::JSON END AS j FROM block_graphs QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY loaded_at DESC) = 1)))
SELECT item_kind, item_key, CASE WHEN list_max([length(s) FOR s IN regexp_split_to_array(body, '[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}.!?。！？]+')]) > 1500 THEN 'forced' ELSE 'natural' END AS cut
FROM items WHERE length(body) > 1500""",
    "p7_found": r"""WITH RECURSIVE m AS (
  SELECT trim(conversation_id, E' \t\r\n') AS c, trim(msg_id, E' \t\r\n') AS id, nullif(trim(parent_id, E' \t\r\n'), '') AS parent, lower(trim(role, E' \t\r\n')) AS r, deleted_at IS NULL AND coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false) AS ok
  FROM messages WHERE trim(conversation_id, E' \t\r\n') <> '' QUALIFY row_number() OVER (PARTITION BY trim(conversation_id, E' \t\r\n'), trim(msg_id, E' \t\r\n') ORDER BY loaded_at DESC, row_id DESC) = 1),
x AS (
  SELECT rec_id, key, v, pos FROM (
    SELECT export_id AS rec_id, k AS key, json_extract(j, '$."' || k || '"') AS v, pos FROM (SELECT export_id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos FROM (
      SELECT export_id, CASE json_type(mapping) WHEN 'VARCHAR' THEN json_extract_string(mapping, '$')::JSON ELSE mapping::JSON END AS j FROM chat_exports WHERE json_valid(mapping)) WHERE json_type(j) = 'OBJECT')
    UNION ALL
    SELECT export_id, v->>'$.id', v, pos FROM (SELECT export_id, unnest(json_extract(mapping::JSON, '$[*]')) AS v, generate_subscripts(json_extract(mapping::JSON, '$[*]'), 1) AS pos FROM chat_exports WHERE json_valid(mapping) AND json_type(mapping) = 'ARRAY') WHERE v->>'$.id' IS NOT NULL)),
listed AS (SELECT rec_id, child, arg_min(key, pos) AS by_key FROM (SELECT rec_id, key, pos, unnest(json_extract_string(v, '$.children[*]')) AS child FROM x) GROUP BY ALL),
e AS (
  SELECT x.rec_id::VARCHAR AS c, key AS id, coalesce(nullif(v->>'$.parent', ''), by_key) AS parent, lower(trim(v->>'$.message.author.role', E' \t\r\n')) AS r,
    coalesce(regexp_matches(CASE json_type(v, '$.message.content') WHEN 'VARCHAR' THEN v->>'$.message.content' ELSE coalesce(
      array_to_string([p->>'$' FOR p IN json_extract(v, '$.message.content.parts[*]') IF json_type(p) = 'VARCHAR'], ' '), v->>'$.message.content.text') END, '[\p{L}\p{N}]')
      OR regexp_matches(v->>'$.message.content.text', '[\p{L}\p{N}]'), false) AS ok
  FROM x LEFT JOIN listed l ON l.rec_id = x.rec_id AND l.child = x.key),
a AS (SELECT 'messages' AS o, * FROM m UNION ALL SELECT 'chat_exports', * FROM e),
n AS (SELECT o, c, id, parent, CASE WHEN NOT ok THEN '' WHEN r IN ('user', 'human') THEN 'u' WHEN r IN ('assistant', 'ai', 'model') THEN 'a' ELSE 'o' END AS k FROM a),
climb AS (
  SELECT o, c, parent AS id FROM n WHERE k = 'a' AND parent IS NOT NULL
  UNION
  SELECT n.o, n.c, n.parent FROM climb JOIN n USING (o, c, id) WHERE n.parent IS NOT NULL),
free AS (
  SELECT o, c, id FROM n WHERE parent IS NULL
  UNION
  SELECT n.o, n.c, n.id FROM free JOIN n ON n.o = free.o AND n.c = free.c AND n.parent = free.id)
SELECT DISTINCT o AS origin, c AS conv_key FROM (
  SELECT o, c FROM n WHERE (o, c, id) NOT IN (SELECT (o, c, id) FROM free)
  UNION ALL SELECT o, c FROM n GROUP BY o, c HAVING count(*) FILTER (k = 'u') = 0 OR count(*) FILTER (k = 'a') = 0
  UNION ALL SELECT o, c FROM n WHERE k = 'u' AND (o, c, id) NOT IN (SELECT (o, c, id) FROM climb)
  UNION ALL SELECT 'chat_exports', export_id::VARCHAR FROM chat_exports WHERE export_id NOT IN (SELECT rec_id FROM x))""",
}

# 5: frequency of terms


def _node_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of both fields of each node's current row, as two sequences."""
    rows = table(spark, folder, "graph_nodes").where("id is not null").select("id", "updated_at", F.expr("transform(keywords, k -> k.term)").alias("a"), F.col("top_keywords").alias("b"))
    return current_rows(rows, ["id"], ["updated_at"], ["a", "b"]).select("id", F.array("a", "b").alias("terms"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term, as the run of words that it is, with its number of occurrences and of nodes."""
    nodes = cut(_node_terms(spark, folder))
    whole = ngram_counts(nodes, "terms", 3, words=True).where("wholes > 0").select("term", F.col("wholes").alias("occurrences"), F.col("whole_records").alias("records"))
    return marked(whole, nodes.count())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its number of occurrences and of nodes."""
    return _terms(spark, folder).select("term", "occurrences", F.col("records").alias("nodes"), "mark")


def p5_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """The same for up to three consecutive words within a term."""
    return ngram_counts(_node_terms(spark, folder), "terms", 3, words=True).where("n <= 3").select("term", "n", "occurrences", "records")


# 8: evaluation texts in training text


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose tiles of six words or more cover three fifths of an item, in whatever order."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), 6, 0.6)


QUERIES |= {"p5_found": p5_found, "p5_terms": p5_terms, "p5_ngrams": p5_ngrams, "p8_found": p8_found, "p8_coverage": p8_coverage}

# NFKC of what these tables hold: full-width forms, hard spaces and ligatures
_NODE_TERMS = r"""cur AS (SELECT id, keywords, top_keywords FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
raw AS (SELECT id, unnest(list_concat(coalesce([k.term FOR k IN keywords], []), coalesce(top_keywords, []))) AS t FROM cur),
plain AS (SELECT id, trim(regexp_replace(nfc_normalize(lower(replace(replace(array_to_string([CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN (160, 12288) THEN ' ' ELSE c END FOR c IN string_split(t, '')], ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'))), '\s+', ' ', 'g')) AS term FROM raw WHERE t IS NOT NULL),
terms AS (SELECT id, term FROM plain WHERE term <> ''),
marks AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS nodes, CASE WHEN count(DISTINCT id) > 0.1 * (SELECT count(*) FROM cur) THEN 'common' WHEN count(DISTINCT id) = 1 THEN 'rare' END AS mark FROM terms GROUP BY term)"""
SQL["p5_found"] = f"WITH {_NODE_TERMS} SELECT term, mark FROM marks WHERE mark IS NOT NULL"
SQL["p5_terms"] = f"WITH {_NODE_TERMS} SELECT * FROM marks"
SQL["p5_ngrams"] = f"""WITH {_NODE_TERMS},
words AS (SELECT id, string_split(term, ' ') AS w FROM terms),
grams AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS term, n FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS t(n)))
SELECT term, n, count(*) AS occurrences, count(DISTINCT id) AS records FROM grams GROUP BY term, n"""

_DOC_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
SQL["p8_found"] = f"""WITH grams AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT item_id, {_DOC_WORDS} AS w FROM eval_items) WHERE len(w) >= 12)),
seen AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_DOC_WORDS} AS w FROM documents) WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM seen JOIN grams USING (g)"""

# 4: most similar vectors


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(usable_vectors(table(spark, folder, "node_vectors")))
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector its ten most similar ones, however similar, ranked; the larger budget is for those that have no close one."""
    return nearest(usable_vectors(table(spark, folder, "node_vectors")), beyond=True, budget=4096).withColumn("cosine", F.round("cosine", 6))


QUERIES |= {"p4_found": p4_found, "p4_neighbours": p4_neighbours}

_UNIT = """usable AS (
  SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM (
    SELECT trim(id, E' \\t\\r\\n') AS id, embedding::DOUBLE[] AS e FROM node_vectors QUALIFY row_number() OVER (PARTITION BY trim(id, E' \\t\\r\\n') ORDER BY updated_at DESC) = 1)
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""
SQL["p4_found"] = f"""WITH {_UNIT},
near AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM usable a JOIN usable b ON a.id <> b.id WHERE c >= 0.85)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS r FROM near) WHERE r <= 10"""

# 1: groups of similar vectors


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups(usable_vectors(table(spark, folder, "node_vectors")))


def _described(spark: SparkSession, folder: str, members: DataFrame, by: str, typical_ids: int, terms: int) -> DataFrame:
    """``by``, the densest members and the most frequent top keywords of the nodes, of members (``by``, id, density)."""
    dense = Window.partitionBy(by).orderBy(F.desc("density"), "id")
    best = members.withColumn("at", F.row_number().over(dense)).where(F.col("at") <= typical_ids).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("typical_ids"))
    nodes = current_rows(table(spark, folder, "graph_nodes").where("id is not null").select("id", "updated_at", trimmed("orig_id").alias("orig_id"), "top_keywords"), ["id"], ["updated_at"], ["orig_id", "top_keywords"])
    words = nodes.select("orig_id", F.explode("top_keywords").alias("term")).select("orig_id", F.lower(trimmed("term")).alias("term")).where("term <> ''").distinct()
    owners = current_rows(table(spark, folder, "node_vectors").select(trimmed("id").alias("id"), trimmed("user_id").alias("user_id"), "updated_at").where("id is not null"), ["id"], ["updated_at"], ["user_id"])
    named = members.select(by, "id").join(owners, "id").select(by, F.expr("if(startswith(id, concat(user_id, '_')), substring(id, length(user_id) + 2), id)").alias("orig_id"))
    held = named.join(words, "orig_id").groupBy(by, "term").count()
    often = Window.partitionBy(by).orderBy(F.desc("count"), "term")
    top = held.withColumn("at", F.row_number().over(often)).where(F.col("at") <= terms).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("top_keywords"))
    return best.join(top, by, "left")


def p1_clusters(spark: SparkSession, folder: str, typical: int = 5, terms: int = 5) -> DataFrame:
    """The mixture's clusters, each with its size, its densest members and the most frequent top keywords of its nodes."""
    members = cut(clusters(usable_vectors(table(spark, folder, "node_vectors"))))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return sizes.join(_described(spark, folder, members, "cluster", typical, terms), "cluster", "left")


def p1_groups(spark: SparkSession, folder: str, typical_ids: int = 5, terms: int = 5) -> DataFrame:
    """The groups of p1_found, each with its size, the members nearest to its mean direction and the most frequent top keywords of its nodes."""
    vectors = cut(usable_vectors(table(spark, folder, "node_vectors")))
    members = cut(typical(groups(vectors), vectors))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("density"), 4).alias("closeness"))
    return sizes.join(_described(spark, folder, members, "group_id", typical_ids, terms), "group_id", "left")


QUERIES |= {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_groups": p1_groups}

SQL["p1_found"] = f"""WITH RECURSIVE {_UNIT},
near AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id WHERE list_dot_product(a.u, b.u) >= 0.85),
reach AS (SELECT a AS id, a AS other FROM near UNION SELECT r.id, n.b FROM reach r JOIN near n ON r.other = n.a)
SELECT min(other) AS group_id, id FROM reach GROUP BY id HAVING count(*) >= 3"""

# 10: pages of keywords and links


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed(table(spark, folder, "documents")).where("stuffed").select("doc_id").distinct()


def p10_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its measures and what speaks against it."""
    return stuffed(table(spark, folder, "documents"))


QUERIES |= {"p10_found": p10_found, "p10_measures": p10_measures}

# 9: mixing sources


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source, and how often it is repeated."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES |= {"p9_mix": p9_mix, "p9_report": p9_report}

_P7 = SQL["p7_found"][: SQL["p7_found"].index("SELECT DISTINCT o AS origin")].rstrip()
SQL["p7_conversations"] = (
    _P7
    + ",\nbad AS ("
    + SQL["p7_found"][len(_P7) :]
    + r"""),
dep AS (
  SELECT o, c, id, 0 AS depth FROM n WHERE parent IS NULL
  UNION ALL
  SELECT n.o, n.c, n.id, depth + 1 FROM dep JOIN n ON n.o = dep.o AND n.c = dep.c AND n.parent = dep.id),
kept AS (SELECT dep.*, n.k FROM dep JOIN n USING (o, c, id) LEFT JOIN bad ON bad.origin = dep.o AND bad.conv_key = dep.c WHERE n.k <> '' AND bad.origin IS NULL),
said AS (
  SELECT 'messages' AS o, trim(conversation_id, E' \t\r\n') AS c, trim(msg_id, E' \t\r\n') AS id, lower(trim(role, E' \t\r\n')) AS r, content, created_at, 0 AS pos FROM messages
  WHERE trim(conversation_id, E' \t\r\n') <> '' QUALIFY row_number() OVER (PARTITION BY trim(conversation_id, E' \t\r\n'), trim(msg_id, E' \t\r\n') ORDER BY loaded_at DESC, row_id DESC) = 1
  UNION ALL
  SELECT 'chat_exports', rec_id::VARCHAR, key, lower(trim(v->>'$.message.author.role', E' \t\r\n')), CASE json_type(v, '$.message.content') WHEN 'VARCHAR' THEN v->>'$.message.content' ELSE
    CASE json_type(v, '$.message.content.parts') WHEN 'ARRAY' THEN array_to_string([p->>'$' FOR p IN json_extract(v, '$.message.content.parts[*]') IF json_type(p) = 'VARCHAR'], E'\n') ELSE v->>'$.message.content.text' END END, NULL, pos FROM x)
SELECT o AS origin, c AS conv_key, row_number() OVER (PARTITION BY o, c ORDER BY depth, created_at IS NULL, created_at, CASE o WHEN 'messages' THEN id END, pos) - 1 AS turn,
  CASE k WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE r END AS role, content FROM kept JOIN said USING (o, c, id)"""
)
SQL["p4_neighbours"] = f"""WITH {_UNIT},
near AS (SELECT a.id AS id, b.id AS near_id, round(list_dot_product(a.u, b.u), 12) AS c FROM usable a JOIN usable b ON a.id <> b.id)
SELECT id, near_id, round(c, 6) AS cosine, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, near_id) AS r FROM near) WHERE r <= 10"""
