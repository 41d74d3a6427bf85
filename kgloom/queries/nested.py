"""Queries over the JSON records (problem 2) and the page tree (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.operators.contraction import contract_forest, interval_labels
from kgloom.operators.current import current_rows
from kgloom.operators.nested import block_kinds, contained, entry_kinds, nodes_of
from kgloom.session import cut
from kgloom.sources.tables import table


def block_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled blocks, micro nodes and micro edges of each graph's current row, each with the key of the block around it."""
    nodes = nodes_of(table(spark, folder, "block_graphs"), "graph_id", "block_graph", block_kinds, carry=["loaded_at"])
    latest = Window.partitionBy("rec_id")
    return contained(nodes, "block", within=("rec_id", "loaded_at")).withColumn("_last", F.max("loaded_at").over(latest)).where("loaded_at <=> _last").drop("_last")


def export_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nodes_of(table(spark, folder, "chat_exports"), "export_id", "mapping", entry_kinds)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = export_nodes(spark, folder).where("kind = 'entry'").select(
        F.lit("mapping").alias("kind"), "rec_id", F.get_json_object("body", "$.parent").alias("parent_key"), F.col("key").alias("child_key")
    )
    inner = block_nodes(spark, folder).where("key is not null").select(
        "kind", "rec_id", F.when(F.col("kind") == "block", F.lit("")).otherwise(F.coalesce("parent_key", F.lit(""))).alias("parent_key"), F.col("key").alias("child_key")
    )
    return entries.unionByName(inner).distinct()


def p2_micro_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of micro nodes with their interval labels."""
    return block_nodes(spark, folder).where("kind = 'micro_node'").select("rec_id", "pre", "post", "level", "parent_key", "parent_pre", "key", F.get_json_object("body", "$.type").alias("types")).distinct()


def p2_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of export messages, each with the mapping entry that contains it."""
    found = contained(export_nodes(spark, folder), "entry").where("kind = 'message'")
    return found.select("rec_id", "pre", "post", "parent_key", "key", *[F.get_json_object("body", f"$.{c}").alias(c) for c in ("role", "text", "create_time")])


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows of the page tree: id and parent as 32 lower-case hex digits, parent null where blank."""
    plain = [F.lower(F.regexp_replace(c, r"[\s\-]", "")).alias(n) for c, n in (("id", "page_id"), ("parent_id", "parent"))]
    rows = table(spark, folder, "page_tree").select(*plain, "loaded_at").where("page_id is not null")
    return current_rows(rows, ["page_id"], ["loaded_at"], ["parent"]).withColumn("parent", F.nullif("parent", F.lit("")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    done = contract_forest(pages(spark, folder), "page_id", "parent")
    return done.select(F.col("node").alias("page_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its interval: the pages beneath it are those of its root with a pre in (pre, last]."""
    done = interval_labels(pages(spark, folder), "page_id", "parent")
    return done.where("depth >= 0").select(F.col("node").alias("page_id"), F.col("root").alias("root_id"), "pre", "last")


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    done = contract_forest(pages(spark, folder), "page_id", "parent", with_path=True)
    return done.select(F.col("node").alias("page_id"), F.array_join("path", "/").alias("path"), F.when(F.col("depth") >= 0, F.col("below")).alias("pages_below"))


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with every page beneath it; pages beneath a ring come in p6_hung_descendants, those on it in p6_found."""
    return _descendants(contract_forest(pages(spark, folder), "page_id", "parent", with_path=True))


def _descendants(done: DataFrame) -> DataFrame:
    return done.where("depth > 0").select(F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("pos", "page_id"), F.col("node").alias("descendant_id"), "depth").select(
        "page_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance")
    )


def _hung(spark: SparkSession, folder: str) -> DataFrame:
    """The forest of the pages that hang beneath a ring; those whose parent is on the ring are its tops."""
    rows = cut(pages(spark, folder))
    loose = contract_forest(rows, "page_id", "parent").where("depth < 0 and below is not null").select(F.col("node").alias("page_id"))
    return contract_forest(cut(rows.join(loose, "page_id")), "page_id", "parent", with_path=True)


def p6_hung_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every page beneath a ring with its path from the page that hangs on the ring, and the number of pages beneath it."""
    return _hung(spark, folder).select(F.col("node").alias("page_id"), F.array_join("path", "/").alias("path"), F.col("below").alias("pages_below"))


def p6_hung_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every page beneath a ring with every page beneath it, as p6_descendants has them for the other pages."""
    return _descendants(_hung(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_micro_nodes": p2_micro_nodes, "p2_messages": p2_messages, "p6_found": p6_found, "p6_labels": p6_labels, "p6_paths": p6_paths, "p6_descendants": p6_descendants, "p6_hung_paths": p6_hung_paths, "p6_hung_descendants": p6_hung_descendants}

_PAGES = r"""
pages AS (
  SELECT page_id, nullif(parent, '') AS parent FROM (
    SELECT lower(regexp_replace(id, '[\s\-]', '', 'g')) AS page_id, lower(regexp_replace(parent_id, '[\s\-]', '', 'g')) AS parent,
      row_number() OVER (PARTITION BY lower(regexp_replace(id, '[\s\-]', '', 'g')) ORDER BY loaded_at DESC) AS rn
    FROM page_tree WHERE id IS NOT NULL) WHERE rn = 1),
tree AS (
  SELECT page_id, page_id AS root_id, 0 AS depth, page_id AS path FROM pages WHERE parent IS NULL OR parent NOT IN (SELECT page_id FROM pages)
  UNION ALL
  SELECT p.page_id, t.root_id, t.depth + 1, t.path || '/' || p.page_id FROM pages p JOIN tree t ON p.parent = t.page_id)"""

_HUNG = r"""
loose AS (SELECT page_id, parent FROM pages WHERE page_id NOT IN (SELECT page_id FROM tree)),
climb AS (
  SELECT page_id, parent AS above FROM loose
  UNION
  SELECT c.page_id, l.parent FROM climb c JOIN loose l ON c.above = l.page_id),
ring AS (SELECT page_id FROM climb WHERE page_id = above),
hung AS (
  SELECT page_id, 0 AS depth, page_id AS path FROM loose WHERE page_id NOT IN (SELECT page_id FROM ring) AND parent IN (SELECT page_id FROM ring)
  UNION ALL
  SELECT l.page_id, h.depth + 1, h.path || '/' || l.page_id FROM loose l JOIN hung h ON l.parent = h.page_id)"""

#: Blocks (b), micro nodes (n) and micro edges (d) of block graphs.
BLOCK_TABLES = """g AS (
  SELECT graph_id AS rec_id, CASE json_type(block_graph::JSON, '$.block_graph') WHEN 'VARCHAR' THEN (block_graph->>'$.block_graph')::JSON WHEN 'OBJECT' THEN json_extract(block_graph::JSON, '$.block_graph') ELSE block_graph::JSON END AS j
  FROM block_graphs QUALIFY rank() OVER (PARTITION BY graph_id ORDER BY loaded_at DESC) = 1),
b AS (
  SELECT rec_id, v, CASE json_type(v, '$.micro_graph') WHEN 'VARCHAR' THEN (v->>'$.micro_graph')::JSON ELSE json_extract(v, '$.micro_graph') END AS mg FROM (
    SELECT rec_id, unnest(CASE json_type(j, '$.blocks') WHEN 'ARRAY' THEN json_extract(j, '$.blocks[*]') ELSE CASE WHEN json_extract(j, '$.blocks.block_id') IS NULL THEN json_extract(j, '$.blocks.*') ELSE [json_extract(j, '$.blocks')] END END) AS v FROM g)
  WHERE v->>'$.block_id' IS NOT NULL),
n AS (SELECT rec_id, trim(v->>'$.block_id') AS block_id, unnest(CASE json_type(mg, '$.nodes') WHEN 'OBJECT' THEN CASE WHEN json_extract(mg, '$.nodes.name') IS NULL THEN json_extract(mg, '$.nodes.*') ELSE [json_extract(mg, '$.nodes')] END ELSE json_extract(mg, '$.nodes[*]') END) AS x FROM b),
d AS (SELECT rec_id, trim(v->>'$.block_id') AS block_id, unnest(CASE json_type(mg, '$.edges') WHEN 'OBJECT' THEN CASE WHEN json_extract(mg, '$.edges.target') IS NULL THEN json_extract(mg, '$.edges.*') ELSE [json_extract(mg, '$.edges')] END ELSE json_extract(mg, '$.edges[*]') END) AS x FROM b)"""

SQL = {
    "p6_found": f"""WITH RECURSIVE {_PAGES},
loose AS (SELECT page_id, parent FROM pages WHERE page_id NOT IN (SELECT page_id FROM tree)),
climb AS (
  SELECT page_id, parent AS above FROM loose
  UNION
  SELECT c.page_id, l.parent FROM climb c JOIN loose l ON c.above = l.page_id)
SELECT page_id, root_id, depth FROM tree
UNION ALL
SELECT page_id, min(above), -1 FROM climb WHERE above IN (SELECT page_id FROM climb WHERE page_id = above) GROUP BY page_id""",
    "p6_labels": f"""WITH RECURSIVE {_PAGES}
SELECT page_id, root_id, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS pre,
  row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 + (SELECT count(*) FROM tree u WHERE starts_with(u.path, tree.path || '/')) AS last FROM tree""",
    "p6_paths": f"""WITH RECURSIVE {_PAGES}
SELECT t.page_id, t.path, (SELECT count(*) FROM tree u WHERE starts_with(u.path, t.path || '/')) AS pages_below FROM tree t
UNION ALL
SELECT page_id, NULL, NULL FROM pages WHERE page_id NOT IN (SELECT page_id FROM tree)""",
    "p6_descendants": f"""WITH RECURSIVE {_PAGES}
SELECT string_split(path, '/')[i + 1] AS page_id, page_id AS descendant_id, (depth - i)::INT AS distance
FROM tree, LATERAL (SELECT unnest(range(0, depth)) AS i) WHERE depth > 0""",
    "p6_hung_paths": f"""WITH RECURSIVE {_PAGES}, {_HUNG}
SELECT t.page_id, t.path, (SELECT count(*) FROM hung u WHERE starts_with(u.path, t.path || '/')) AS pages_below FROM hung t""",
    "p6_hung_descendants": f"""WITH RECURSIVE {_PAGES}, {_HUNG}
SELECT string_split(path, '/')[i + 1] AS page_id, page_id AS descendant_id, (depth - i)::INT AS distance
FROM hung, LATERAL (SELECT unnest(range(0, depth)) AS i) WHERE depth > 0""",
    "p2_found": f"""WITH m AS (
  SELECT export_id AS rec_id, CASE json_type(mapping) WHEN 'VARCHAR' THEN json_extract_string(mapping, '$')::JSON ELSE mapping::JSON END AS j
  FROM chat_exports WHERE json_valid(mapping)),
e AS (
  SELECT rec_id, k AS key, json_extract(j, '$."' || k || '"') AS v, pos FROM (SELECT rec_id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos FROM m WHERE json_type(j) = 'OBJECT')
  UNION ALL
  SELECT rec_id, v->>'$.id', v, pos FROM (SELECT rec_id, unnest(json_extract(j, '$[*]')) AS v, generate_subscripts(json_extract(j, '$[*]'), 1) AS pos FROM m WHERE json_type(j) = 'ARRAY') WHERE v->>'$.id' IS NOT NULL),
listed AS (SELECT rec_id, child, arg_min(key, pos) AS by_key FROM (SELECT rec_id, key, pos, unnest(json_extract_string(v, '$.children[*]')) AS child FROM e) GROUP BY ALL),
{BLOCK_TABLES}
SELECT DISTINCT * FROM (
  SELECT 'mapping' AS kind, e.rec_id, coalesce(nullif(v->>'$.parent', ''), by_key, '') AS parent_key, key AS child_key FROM e LEFT JOIN listed l ON l.rec_id = e.rec_id AND l.child = e.key
  UNION ALL SELECT 'block', rec_id, '', trim(v->>'$.block_id') FROM b
  UNION ALL SELECT 'micro_node', rec_id, block_id, trim(CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE x->>'$.name' END) FROM n WHERE json_type(x) <> 'NULL'
  UNION ALL SELECT 'micro_edge', rec_id, block_id, trim(coalesce(x->>'$.start', x->>'$.source')) || '|' || trim(CASE json_type(x, '$.type') WHEN 'ARRAY' THEN x->>'$.type[0]' ELSE x->>'$.type' END) || '|' || trim(x->>'$.target') FROM d)
WHERE child_key IS NOT NULL AND child_key <> ''""",
}
