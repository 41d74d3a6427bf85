"""Questions answered from chunks: by similarity, by what their entities are linked to, and by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.graph import neighbours
from kgloom.operators.sequence import within_budget
from kgloom.operators.similarity import dot, norm


def vector_search(queries: DataFrame, items: DataFrame, k: int = 5, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """query, item, score and rank: for each query its ``k`` nearest items by cosine, held to [0, 1]; equal ones by item.

    ``queries`` has query and vector, ``items`` item and vector. ``where`` filters items before anything is compared.
    Queries are few and are sent to where the items are; each task keeps its best before ranking.
    """
    chosen = items.where(where) if where is not None else items
    rows = chosen.select("item", F.col("vector").alias("iv")).join(F.broadcast(bounded(queries.select("query", F.col("vector").alias("qv")))))
    size = norm("iv") * norm("qv")
    scored = rows.select("query", "item", F.when(size > 0, dot("iv", "qv") / size).otherwise(0.0).alias("cosine"))
    scored = scored.where(F.col("cosine") >= threshold) if threshold is not None else scored
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "item")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "item", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine")).alias("score"), "rank")


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` if it has at most ``most`` rows, so that it may be broadcast; an error otherwise."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; ask in parts, or use an index")
    return df


def entities_of_chunks(hits: DataFrame, entity_chunk: DataFrame) -> DataFrame:
    """query and name of the entities linked to each query's chunks (chunk_id)."""
    return hits.join(entity_chunk, "chunk_id").select("query", "name").distinct()


def chunks_of_entities(found: DataFrame, entity_chunk: DataFrame) -> DataFrame:
    """query, chunk_id and names, the entities through which each chunk was reached, in order."""
    return found.join(entity_chunk, "name").groupBy("query", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def joined_chunks(by_vector: DataFrame, by_graph: DataFrame) -> DataFrame:
    """Both lists as one for each query: those by vector first, each chunk once, at its earlier place."""
    both = by_vector.select("query", "chunk_id", F.lit(0).alias("way"), F.col("rank").alias("at")).unionByName(by_graph.select("query", "chunk_id", F.lit(1).alias("way"), F.lit(0).alias("at")))
    first = both.groupBy("query", "chunk_id").agg(F.min(F.struct("way", "at")).alias("first"))
    return first.select("query", "chunk_id", F.when(F.col("first.way") == 0, "vector").otherwise("graph").alias("way"), F.row_number().over(Window.partitionBy("query").orderBy("first", "chunk_id")).alias("position"))


def hybrid(queries: DataFrame, chunks: DataFrame, entity_chunk: DataFrame, relations: DataFrame, k: int = 5, hops: int = 1, neighbour_limit: int = 20) -> DataFrame:
    """query, chunk_id, way and position: the nearest chunks, then those of entities within ``hops`` of the entities in them.

    ``chunks`` has chunk_id, text and vector, ``entity_chunk`` name and chunk_id, ``relations`` start and target. Without
    entities only the nearest chunks come out.
    """
    hits = vector_search(queries, chunks.select(F.col("chunk_id").alias("item"), "vector"), k).select("query", F.col("item").alias("chunk_id"), "rank")
    seeds = entities_of_chunks(hits, entity_chunk)
    around = neighbours(relations.select(F.col("start").alias("source"), "target"), seeds.select(F.col("name").alias("seed")).distinct(), hops, neighbour_limit)
    reached = seeds.join(around.select(F.col("seed").alias("name"), F.col("node").alias("other")), "name").select("query", F.col("other").alias("name")).distinct()
    return joined_chunks(hits, chunks_of_entities(reached, entity_chunk))


def contexts(found: DataFrame, chunks: DataFrame, most: int = 4000) -> DataFrame:
    """query and context: the texts of its chunks in order, as many as fit into ``most`` characters."""
    rows = found.join(chunks.select("chunk_id", "text"), "chunk_id")
    kept = within_budget(rows, ["query"], ["position"], F.when(F.trim("text") != "", F.length("text")).otherwise(0), most)
    return kept.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"]), "\n\n").alias("context"))  # bounded by most


def prompts(context: DataFrame, questions: DataFrame, profile: str | None = None) -> DataFrame:
    """query and prompt; a question without context says so."""
    head = F.lit(f"About the reader: {profile}\n\n" if profile else "")
    text = F.when(F.col("context").isNull(), F.concat(head, F.lit("No passage was found.\n\nQuestion: "), "question")).otherwise(F.concat(head, F.lit("Answer from these passages only.\n\n"), "context", F.lit("\n\nQuestion: "), "question"))
    return questions.join(context, "query", "left").select("query", text.alias("prompt"))
