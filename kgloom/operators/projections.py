"""Reshaping sources, nodes, clusters and blocks: the small operators between the large ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CHAT_ROLES = ("user", "assistant", "system", "human", "ai", "model", "tool")

# Sources


def merged_sources(parts: Sequence[DataFrame], key: str = "source_id") -> DataFrame:
    """Several sources as one, ids prefixed by ``src{i}_`` so that they don't meet."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn(key, F.concat(F.lit(f"src{i}_"), F.col(key)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def chat_sources(sections: DataFrame) -> DataFrame:
    """source_id of the sources in which some section has the role of a chat."""
    return sections.where(F.lower(F.trim("role")).isin(*CHAT_ROLES)).select("source_id").distinct()


def safe_id(value: Column | str, most: int = 80) -> Column:
    """Only word characters, others as ``_``, at most ``most``."""
    column = F.col(value) if isinstance(value, str) else value
    return F.left(F.regexp_replace(column, "[^\\p{L}\\p{N}_]", "_"), F.lit(most))


def insertion_batch(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, notes) of sources to be inserted: chats by message, others by section under a first-level heading."""
    chats = chat_sources(sections)
    messages = sections.join(chats, "source_id", "left_semi").select(safe_id("source_id").alias("conversation_id"), "title", "pos", F.lower(F.trim("role")).alias("role"), "content")
    rest = sections.join(chats, "source_id", "left_anti")
    notes = rest.select(safe_id("source_id").alias("note_id"), "title", "pos", F.concat(F.lit("# "), F.coalesce("heading", "title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("content"))
    return messages, notes


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose ``key`` it lacks; of equal keys in ``new`` one."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def fits_one_run(chunks: DataFrame, key: str, per_batch: int = 25, most_batches: int = 30) -> DataFrame:
    """``key``, chunks, batches and fits: whether a document's chunks make fewer than ``most_batches`` batches."""
    got = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))
    return got.select("*", F.expr(f"chunks div {per_batch}").alias("batches"), F.expr(f"chunks div {per_batch} < {most_batches}").alias("fits"))


def filled_ids(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with uuid: orig_id ``conv_{i}`` is the i-th of ``conversations`` (pos, uuid)."""
    pos = F.regexp_extract("orig_id", "^conv_([0-9]+)$", 1).try_cast("bigint")
    return nodes.withColumn("_pos", pos).join(conversations.select(F.col("pos").cast("bigint").alias("_pos"), "uuid"), "_pos", "left").drop("_pos")


# Lookups


def looked_up(df: DataFrame, nodes: DataFrame, orig_id: str, number: str, take: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``take`` of the node with its orig_id, else of that with its number. Two equi joins, no OR."""
    a = nodes.select(F.col("orig_id").alias("_o"), F.struct(*take).alias("_a")).dropDuplicates(["_o"])
    b = nodes.select(F.col("id").alias("_n"), F.struct(*take).alias("_b")).dropDuplicates(["_n"])
    rows = df.join(a, F.col(orig_id) == F.col("_o"), "left").join(b, F.col(number) == F.col("_n"), "left").withColumn("_t", F.coalesce("_a", "_b"))
    return rows.select(*df.columns, *[F.col(f"_t.{c}").alias(c) for c in take])


def read_assignments(direct: DataFrame | None, clusters: DataFrame) -> DataFrame:
    """node and cluster from assignment rows (node, cluster), else from the members listed by clusters (cluster, members)."""
    listed = clusters.select(F.explode("members").alias("node"), "cluster")
    return listed if direct is None else direct.unionByName(listed.join(direct.select("node"), "node", "left_anti"))


def first_by_id(groups: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """All rows of the tables, of each ``key`` that of the first table that has it."""
    every = None
    for i, group in enumerate(groups):
        one = group.withColumn("_at", F.lit(i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_at")


def names_containing(entities: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Entities whose name contains ``text`` in any case, by name."""
    found = entities.where(F.contains(F.lower("name"), F.lower(F.lit(text))))
    return found.orderBy("name").limit(most) if most else found


def matched_keywords(keywords: Column, query: Column, most: int = 10) -> Column:
    """Of the first ``most`` keywords those that contain the query or are contained in it, in any case."""
    return F.filter(F.slice(F.filter(keywords, lambda k: k.isNotNull()), 1, most), lambda k: F.contains(F.lower(k), F.lower(query)) | F.contains(F.lower(query), F.lower(k)))


def localised(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with each type of the array ``column`` under its local name of ``names`` (name, local), else as it is."""
    held = names.agg(F.map_from_entries(F.collect_list(F.struct("name", "local"))).alias("_names"))  # types of an ontology
    return df.crossJoin(F.broadcast(held)).withColumn(column, F.transform(column, lambda t: F.coalesce(F.try_element_at("_names", t), t))).drop("_names")


IMAGE = "<image page=\"?([0-9]+)\"? index=\"?([0-9]+)\"?[^>]*>"


def image_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, pos, page and index of each image tag in a text."""
    every = F.zip_with(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)), lambda p, i: F.struct(p.cast("int").alias("page"), i.cast("int").alias("index")))
    return df.select(key, F.posexplode(every).alias("pos", "i")).select(key, "pos", "i.page", "i.index")


def with_captions(df: DataFrame, key: str, text: str, captions: DataFrame) -> DataFrame:
    """Texts with each image tag replaced by its caption of ``captions`` (page, index, caption); tags without one go."""
    held = captions.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "page", "index"), "caption"))).alias("_c"))  # of one document
    parts = F.split(F.regexp_replace(text, IMAGE, "\u0001$1:$2\u0002"), "\u0001")
    said = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0002")), F.concat(F.coalesce(F.try_element_at("_c", F.split_part(p, F.lit("\u0002"), F.lit(1))), F.lit("")), F.split_part(p, F.lit("\u0002"), F.lit(2)))).otherwise(p))
    return df.crossJoin(F.broadcast(held)).withColumn(text, F.array_join(said, "")).drop("_c")


# Clusters and insights


def profile_text(name: Column, description: Column, themes: Column, most: int = 10) -> Column:
    return F.concat_ws(" ", F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(description), F.lit("")), F.array_join(F.slice(F.coalesce(themes, F.array().cast("array<string>")), 1, most), " "))


def stored_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, nodes, edges and density by the edges' own is_intra flag and their source's cluster."""
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"))
    inside = edges.where("is_intra").join(nodes.select(F.col("node").alias("source"), "cluster"), "source").groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))
    most = F.expr("nodes * (nodes - 1) div 2")
    return sizes.join(inside, "cluster", "left").select("cluster", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(most > 0, F.coalesce("edges", F.lit(0)) / most).otherwise(0.0).alias("density"))


def close_pairs_with_words(edges: DataFrame, nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges of at least ``least`` with the terms that both ends share (nodes: node, terms)."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("terms").alias(f"{c}_terms")) for c in ("source", "target"))
    rows = edges.where(F.col("weight") >= least).join(a, "source").join(b, "target")
    return rows.select("source", "target", "weight", F.array_sort(F.array_intersect(F.coalesce("source_terms", F.array()), F.coalesce("target_terms", F.array()))).alias("shared"))


def spread_selection(keywords: DataFrame, item: str, group: str, term: str, score: str, most: int = 6) -> DataFrame:
    """``item``, ``term`` and rank: the best terms of each of an item's groups, max(2, most / groups) each, filled up to ``most`` by the best of the rest."""
    best = keywords.groupBy(item, group, term).agg(F.max(score).alias("_s"))
    groups = best.groupBy(item).agg(F.count_distinct(group).alias("_g"))
    inner = best.withColumn("_r", F.row_number().over(Window.partitionBy(item, group).orderBy(F.desc("_s"), term)))
    first = inner.join(groups, item).withColumn("_late", (F.col("_r") > F.greatest(F.lit(2), F.ceil(F.lit(most) / F.col("_g")))).cast("int"))
    once = first.groupBy(item, term).agg(F.min(F.struct("_late", (-F.col("_s")).alias("_s"))).alias("_k"))
    order = Window.partitionBy(item).orderBy("_k", term)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(item, term, "rank")


def unique_terms(df: DataFrame, item: str, terms: str, most: int = 50) -> DataFrame:
    """``item``, term and pos of the first ``most`` different terms of an array, in any case, in order."""
    rows = df.select(item, F.posexplode(terms).alias("pos", "term")).where("trim(term) <> ''")
    first = rows.groupBy(item, F.lower(F.trim("term")).alias("plain")).agg(F.min(F.struct("pos", "term")).alias("f"))
    order = Window.partitionBy(item).orderBy("f.pos")
    return first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(item, F.trim("f.term").alias("term"), (F.col("r") - 1).alias("pos"))


def most_significant(df: DataFrame, level: str, k: int = 3, levels: Sequence[str] = ("high", "medium", "low"), tie: str = "title") -> DataFrame:
    """The first ``k`` rows by level, unknown ones last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(level)), F.lit(0)), F.lit(len(levels) + 1))
    return df.orderBy(place, tie).limit(k)


def labelled_groups(groups: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Groups with a label (of ``labels``, else their first top keyword) that leads their top_keywords."""
    rows = groups.join(labels.select(key, F.col("label").alias("_l")), key, "left").withColumn("label", F.coalesce("_l", F.get("top_keywords", 0)))
    return rows.withColumn("top_keywords", F.when(F.col("label").isNull(), F.col("top_keywords")).otherwise(F.array_distinct(F.concat(F.array("label"), F.coalesce("top_keywords", F.array().cast("array<string>")))))).drop("_l")


# Blocks


def ordered_blocks(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks (graph_id, block_id) with order_index, their place on the first path of their graph (graph_id, paths); null if they are not on it."""
    rows = blocks.join(paths.select("graph_id", F.get("paths", 0).alias("_p")), "graph_id", "left")
    return rows.withColumn("order_index", F.nullif(F.array_position("_p", F.col("block_id")), F.lit(0)) - 1).drop("_p")


class VectorTable:
    """Vectors by id as a table of files: upsert, delete, fetch, count and search; each change writes the table anew."""

    def __init__(self, spark, path: str, schema: str = "id string, cluster_id string, vector array<double>, version bigint"):
        self.spark, self.path, self.schema = spark, path, schema

    def _place(self) -> tuple[int, str] | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return (max(done), f"{self.path}/v{max(done)}") if done else None

    def read(self) -> DataFrame:
        place = self._place()
        return self.spark.read.schema(self.schema).parquet(place[1]) if place else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        place = self._place()
        df.write.parquet(f"{self.path}/v{place[0] + 1 if place else 0}")

    def upsert(self, rows: DataFrame) -> None:
        from kgloom.operators.entities import upserted

        self._write(upserted(self.read(), rows, ["id"], "version").select(self.read().columns))

    def delete(self, ids: DataFrame) -> None:
        self._write(self.read().join(ids.select("id"), "id", "left_anti").select(self.read().columns))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema))

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("id"), "id", "left_semi")

    def count(self) -> int:
        return self.read().count()

    def search(self, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
        from kgloom.operators.retrieval import vector_search

        return vector_search(queries, self.read().withColumnRenamed("id", "item"), k, where)


def section_vectors(sections: DataFrame, key: str, text: str, embed, most: int = 1500) -> DataFrame:
    """``key`` and vector of each text: the mean of its word-wrapped chunks, weighted by their length, at unit length."""
    from kgloom.operators.sequence import chunked
    from kgloom.operators.similarity import pooled

    chunks = chunked(sections, key, text, "words", most).withColumns({"vector": embed("chunk"), "w": F.length("chunk")})
    return pooled(chunks, [key], "vector", "w", unit_length=True)


