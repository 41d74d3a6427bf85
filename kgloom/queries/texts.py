"""Queries over the texts of documents and the entities of micro graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import cleaned, contains_chinese, contains_latin, grams, jaccard, nfkc, STOP_WORDS, plain_name, preprocessed, seeded_vector, token_estimate, topic_tokens, without_citations, without_markdown
from kgloom.operators.assignment import by_words
from kgloom.operators.entities import dangling_edges_out, folded_entities, forbidden_edges_out, known_edge_types, names_by_type
from kgloom.operators.keywords import gram_counts
from kgloom.operators.parsing import heading_sections
from kgloom.operators.sequence import chunked
from kgloom.queries.insights import nodes
from kgloom.queries.nested import BLOCK_TABLES, block_nodes
from kgloom.session import cut
from kgloom.sources.tables import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def i1_cleaned(spark, folder):
    return documents(spark, folder).select("doc_id", cleaned("text", html=True, citations=True).alias("cleaned"))


def i2_citations(spark, folder):
    return documents(spark, folder).select("doc_id", without_citations(F.coalesce("text", F.lit(""))).alias("plain"))


def i3_preprocessed(spark, folder):
    """Everything but normalisation, punctuation too."""
    return documents(spark, folder).select("doc_id", F.length(preprocessed("text", punctuation=True, unicode=False)).alias("chars"))


def i4_normalised(spark, folder):
    return documents(spark, folder).select("doc_id", cleaned("text", unicode=False).alias("plain"))


def i6_scripts(spark, folder):
    rows = documents(spark, folder).where("text is not null").select(contains_chinese("text").alias("chinese"), contains_latin("text").alias("latin"))
    return rows.groupBy("chinese", "latin").agg(F.count(F.lit(1)).alias("n"))


def i11_tokens(spark, folder):
    return documents(spark, folder).select("doc_id", F.size(topic_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


def i21_gram_frequency(spark, folder):
    """Grams of up to three words of node titles, by nodes."""
    rows = nodes(spark, folder).select(F.filter(F.split(plain_name("title"), " "), lambda t: t != "").alias("tokens")).select(F.explode(F.array_distinct(grams(F.col("tokens"), 3))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def g5_top_grams(spark, folder):
    return gram_counts(documents(spark, folder), "doc_id", "text", 2, 5)


def i23_markdown(spark, folder):
    return documents(spark, folder).select("doc_id", F.length(without_markdown("text")).alias("chars"))


def a11_headings(spark, folder):
    got = heading_sections(documents(spark, folder), "doc_id", "text")
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.count("heading").alias("headed"))


def i24_overlap(spark, folder):
    """How far a node's keywords and top keywords are the same."""
    return nodes(spark, folder).select("id", F.round(jaccard(F.array_compact(F.coalesce("terms", F.array())), F.array_compact(F.coalesce("top_keywords", F.array()))), 6).alias("jaccard"))


def i27_seeded_norms(spark, folder):
    got = documents(spark, folder).select("doc_id", seeded_vector(64)("text").alias("v"))
    return got.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("squared"))


def i34_names(spark, folder):
    return nodes(spark, folder).select("id", plain_name("title").alias("name"))


def i41_tokens(spark, folder):
    return documents(spark, folder).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(token_estimate("text")).alias("tokens"))


def f11_sentence_chunks(spark, folder):
    return chunked(documents(spark, folder), "doc_id", "text", "sentences", 512).select("doc_id", "pos", F.length("chunk").alias("chars"))


def f12_recursive_chunks(spark, folder):
    return chunked(documents(spark, folder), "doc_id", "text", "recursive", 400).select("doc_id", "pos", F.length("chunk").alias("chars"))


def f13_wrapped_chunks(spark, folder):
    return chunked(documents(spark, folder), "doc_id", "text", "words", 1500).select("doc_id", "pos", F.length("chunk").alias("chars"))


def _micro(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Micro nodes and edges, each block being a batch."""
    found = cut(block_nodes(spark, folder).where("key is not null and parent_key is not null").withColumn("batch", F.concat_ws(":", F.col("rec_id").cast("string"), "parent_key")))
    n = found.where("kind = 'micro_node'").select("batch", "rec_id", F.col("pre").alias("pos"), F.col("key").alias("name"), F.get_json_object("body", "$.type").alias("raw")).distinct()
    types = F.when(F.col("raw").startswith("["), F.regexp_extract_all("raw", F.lit('"([^"]+)"'), F.lit(1))).when(F.col("raw").isNotNull(), F.array("raw"))
    e = found.where("kind = 'micro_edge'").select("batch", *[F.get_json_object("body", f"$.{c}").alias(c) for c in ("start", "type", "target")]).distinct()
    return n.select("batch", "rec_id", "pos", "name", types.alias("types")), e


def c9_connected_edges(spark, folder):
    n, e = _micro(spark, folder)
    return dangling_edges_out(e, n)


def c8_allowed_edges(spark, folder):
    """Edges without those that lead from a concept to a person, or from anything to an unknown end by ``requires``."""
    n, e = _micro(spark, folder)
    forbidden = spark.createDataFrame([("requires", "any", "unknown"), ("defines", "Concept", "Person")], "type string, start_type string, target_type string")
    return forbidden_edges_out(e, n, forbidden).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def c7_known_types(spark, folder):
    _, e = _micro(spark, folder)
    common = e.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return known_edge_types(e, common).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def e18_folded_entities(spark, folder):
    n, _ = _micro(spark, folder)
    rows = n.select("pos", "name", F.explode_outer("types").alias("type"), F.lit(None).cast("string").alias("description"), F.col("batch").alias("chunk_id"))
    return folded_entities(rows).select("name", F.array_sort("types").alias("types"), F.size("chunk_ids").alias("chunks"))


def e19_names_by_type(spark, folder):
    n, _ = _micro(spark, folder)
    return names_by_type(n.select(F.explode("types").alias("type"), "name", F.struct("rec_id", "pos", "batch").alias("pos")))


def k6_by_words(spark, folder):
    """Every node's cluster by its keywords, against clusters described by their name and most frequent terms."""
    n = cut(nodes(spark, folder).select("id", "cluster_id", "cluster_name", "terms"))
    terms = n.where("cluster_id is not null").select("cluster_id", F.explode("terms").alias("term")).where("term <> ''").groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("n"))
    themes = terms.groupBy("cluster_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "term"))), lambda s: s["term"]), 1, 10).alias("themes"))
    names = n.where("cluster_id is not null").groupBy("cluster_id").agg(F.min("cluster_name").alias("name"))
    clusters = cut(names.join(themes, "cluster_id").select("cluster_id", "name", F.lit("").alias("description"), "themes"))
    return by_words(n.select(F.col("id").alias("item"), F.col("terms").alias("keywords")), clusters).groupBy("cluster_id", "is_new").agg(F.count(F.lit(1)).alias("n"))


def i1_nfkc_changes(spark, folder):
    rows = documents(spark, folder).where("text is not null").select((nfkc("text") != F.col("text")).alias("changed"))
    return rows.groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


_NAMES = [
    "a11_headings", "c7_known_types", "c8_allowed_edges", "c9_connected_edges", "e18_folded_entities", "e19_names_by_type", "f11_sentence_chunks", "f12_recursive_chunks", "f13_wrapped_chunks", "g5_top_grams", "i1_cleaned", "i1_nfkc_changes", "i2_citations",
    "i3_preprocessed", "i4_normalised", "i6_scripts", "i11_tokens", "i21_gram_frequency", "i23_markdown", "i24_overlap", "i27_seeded_norms", "i34_names", "i41_tokens", "k6_by_words",
]
QUERIES = {n: globals()[n] for n in _NAMES}

_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _chain(start: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        start = f"regexp_replace({start}, '{pattern}', '{by}', 'g')"
    return start


_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'), ' ')"
_CITE = ((r"(?i)cite\s*turn[0-9]+search[0-9]+", " "), (r"(?i)turn[0-9]+search[0-9]+", " "), ("(?i)cite", " "), (r"\[[0-9]+†source\]", " "), ("【.*?】", " "), (r"\[.*?†.*?\]", " "), (r"(?i)\bcite\b", " "))
_CODE, _URL, _HTML = ("(?s)```.*?```", " "), (r"https?://[^\s]+|www\.[^\s]+", " "), ("<[^>]+>", " ")
_T = "coalesce(text, '''')".replace("''''", "''")
_PRE = _SQUEEZE("lower(" + _chain(_T, _HTML, _CODE, _URL, *_CITE) + ")")
_PRE = _chain(_PRE, ("(?s)~~~.*?~~~", " "), (r"`[^`\n]+`", " "), (r"(?m)^\s*(?:-{3,}|_{3,}|\*{3,})\s*$", " "), (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{1F1E6}-\x{1F1FF}]", ""))
_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~，。！？；：、《》「」『』（）【】…·]"""
_MD = _chain(_T, (r"(?m)^>\s*\[!.*?\].*$", ""), (r"!\[.*?\]\(.*?\)", ""), _CODE, ("`[^`]+`", " "), (r"\[\[[^\]|]*\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"(?m)^[\-\*_]{3,}\s*$", ""), (r"(?m)^>\s*", ""), (r"\*\*([^\*]+)\*\*", r"\1"), (r"\*([^\*]+)\*", r"\1"), ("__([^_]+)__", r"\1"), ("_([^_]+)_", r"\1"))
_NODES = "n AS (SELECT id, title, list_transform(keywords, lambda k: trim(k.term, E' \\t\\r\\n' || chr(160))) AS terms, top_keywords FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = (
    f"list_filter(list_transform(string_split(lower({_SQUEEZE(_T)}), ' '), lambda t: regexp_replace(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}_]+', ''), '[^\\p{{L}}\\p{{N}}_]+$', '')), "
    f"lambda t: length(t) BETWEEN 1 AND 48 AND (length(t) > 1 OR t IN ('x', 'y', 'z') OR regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AND t NOT IN ({_STOP}) "
    "AND NOT regexp_matches(t, '[\\\\{}|^=`]|/.*/|::') AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 0.3 * length(t))"
)
_MICRO = f"""WITH {BLOCK_TABLES},
mn AS (SELECT DISTINCT batch, rec_id, name, types, pos FROM (SELECT rec_id || ':' || block_id AS batch, rec_id, trim(CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE x->>'$.name' END) AS name,
  CASE json_type(x, '$.type') WHEN 'ARRAY' THEN list_transform(regexp_extract_all(x->>'$.type', '"([^"]+)"', 1), lambda y: y) WHEN 'VARCHAR' THEN [x->>'$.type'] END AS types, row_number() OVER () AS pos FROM n WHERE json_type(x) <> 'NULL') WHERE name <> ''),
me AS (SELECT DISTINCT rec_id || ':' || block_id AS batch, trim(coalesce(x->>'$.start', x->>'$.source')) AS start, trim(CASE json_type(x, '$.type') WHEN 'ARRAY' THEN x->>'$.type[0]' ELSE x->>'$.type' END) AS type, trim(x->>'$.target') AS target FROM d)
"""
SQL = {
    "i2_citations": f"SELECT doc_id, {_chain(_T, *_CITE)} AS plain FROM documents",
    "i3_preprocessed": f"SELECT doc_id, length({_SQUEEZE(_chain(_PRE, (_PUNCT, ' ')))})::INT AS chars FROM documents",
    "i4_normalised": f"SELECT doc_id, {_SQUEEZE('lower(' + _chain(_T, _CODE, _URL) + ')')} AS plain FROM documents",
    "i6_scripts": r"SELECT regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS chinese, regexp_matches(text, '[A-Za-z]') AS latin, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "i21_gram_frequency": f"""WITH {_NODES}, w AS (SELECT id, list_filter(string_split({_SQUEEZE('lower(title)')}, ' '), lambda t: t <> '') AS t FROM n)
SELECT term, count(*) AS n FROM (SELECT DISTINCT id, array_to_string(t[i:i + k - 1], ' ') AS term FROM w, range(1, 4) a(k), LATERAL (SELECT unnest(range(1, len(t) - k + 2)) AS i)) GROUP BY 1""",
    "i23_markdown": f"SELECT doc_id, length({_SQUEEZE(_MD)})::INT AS chars FROM documents",
    "i24_overlap": f"WITH {_NODES} SELECT id, round(CASE WHEN len(list_distinct(list_concat(coalesce(terms, []), coalesce(top_keywords, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(terms, []), coalesce(top_keywords, []))) / len(list_distinct(list_concat(coalesce(terms, []), coalesce(top_keywords, [])))) END, 6) AS jaccard FROM n",
    "i34_names": f"WITH {_NODES} SELECT id, lower({_SQUEEZE('title')}) AS name FROM n",
    "i41_tokens": "SELECT lower(trim(source, ' ')) AS source, sum(ceil(length(coalesce(text, '')) / 4)::BIGINT)::BIGINT AS tokens FROM documents GROUP BY 1",
    "i27_seeded_norms": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS squared FROM documents",
    "a11_headings": f"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(chr(10) || text, '\\n(#{{1,3}} )', chr(1) || '\\1', 'g'), chr(1))) AS part FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, regexp_matches(part, '^#{{1,3}} ') AS titled, CASE WHEN regexp_matches(part, '^#{{1,3}} ') THEN regexp_replace(part, '^[^\\n]*\\n?', '') ELSE part END AS text FROM p)
SELECT doc_id, count(*) AS sections, count(*) FILTER (titled) AS headed FROM (SELECT doc_id, titled, {_SQUEEZE(_MD)} AS c FROM q) WHERE length(c) >= 10 GROUP BY 1""",
    "i11_tokens": f"SELECT doc_id, len({_TOKENS})::INT AS tokens FROM documents",
    "g5_top_grams": f"""WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, array_to_string(t[i:i + k - 1], ' ') AS term FROM w, range(1, 3) a(k), LATERAL (SELECT unnest(range(1, len(t) - k + 2)) AS i)) GROUP BY ALL)
SELECT doc_id, term, n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM c) WHERE r <= 5""",
    "c9_connected_edges": _MICRO + "SELECT batch, start, target, type FROM me WHERE start <> target AND (batch, start) IN (SELECT (batch, name) FROM mn) AND (batch, target) IN (SELECT (batch, name) FROM mn)",
    "c8_allowed_edges": _MICRO + """, t AS (SELECT batch, name, list_distinct(flatten(list(types))) AS types FROM mn GROUP BY ALL),
x AS (SELECT me.*, CASE WHEN a.name IS NULL THEN ['unknown'] ELSE a.types END AS st, CASE WHEN b.name IS NULL THEN ['unknown'] ELSE b.types END AS tt FROM me LEFT JOIN t a ON a.batch = me.batch AND a.name = me.start LEFT JOIN t b ON b.batch = me.batch AND b.name = me.target)
SELECT type, count(*) AS n FROM x WHERE NOT (type = 'requires' AND len(st) > 0 AND list_contains(tt, 'unknown')) AND NOT (type = 'defines' AND list_contains(st, 'Concept') AND list_contains(tt, 'Person')) GROUP BY 1""",
    "c7_known_types": _MICRO + "SELECT type, count(*) AS n FROM me GROUP BY 1 HAVING count(*) >= 20",
    "e18_folded_entities": _MICRO + "SELECT name, list_sort(list_distinct(flatten(list(types)))) AS types, count(DISTINCT batch)::INT AS chunks FROM mn GROUP BY 1",
}
