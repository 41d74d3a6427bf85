"""Entities and relations extracted from texts: validation, standard names, folding, and the tables of a property graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import plain_name


def known_edge_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges whose type is in ``types`` (name)."""
    return edges.join(types.select(F.col("name").alias("type")).distinct(), "type", "left_semi")


def forbidden_edges_out(edges: DataFrame, nodes: DataFrame, forbidden: DataFrame, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """Edges without those whose end types are a forbidden pair of their type.

    ``nodes`` has batch, name and types (array), ``forbidden`` type, start_type and target_type, where ``any`` stands for
    every type. An end that is no node of the batch has the type ``unknown``; a node without types never violates.
    """
    typed = nodes.groupBy(*batch, "name").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("types", F.array())))).alias("types"))  # a batch's nodes of one name
    end = lambda side: typed.select(*batch, F.col("name").alias(side), F.col("types").alias(f"{side}_types"), F.lit(True).alias(f"{side}_known"))
    rows = edges.join(end("start"), [*batch, "start"], "left").join(end("target"), [*batch, "target"], "left")
    for side in ("start", "target"):
        rows = rows.withColumn(f"{side}_types", F.when(F.col(f"{side}_known").isNull(), F.array(F.lit("unknown"))).otherwise(F.col(f"{side}_types")))
    bad = forbidden.select(F.col("type").alias("_type"), F.col("start_type").alias("_s"), F.col("target_type").alias("_t"))
    fits = lambda pattern, types: (F.size(types) > 0) & ((F.col(pattern) == "any") | F.array_contains(F.col(types), F.col(pattern)))
    hit = (F.col("type") == F.col("_type")) & fits("_s", "start_types") & fits("_t", "target_types")
    return rows.join(bad, hit, "left_anti").select(*edges.columns)


def dangling_edges_out(edges: DataFrame, nodes: DataFrame, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """Edges whose two ends are different nodes of their batch."""
    ends = nodes.select(*batch, "name").distinct()
    rows = edges.where(F.col("start") != F.col("target"))
    for side in ("start", "target"):
        rows = rows.join(ends.withColumnRenamed("name", side), [*batch, side], "left_semi")
    return rows.select(*edges.columns)


def standard_names(frame: DataFrame, columns: Sequence[str], variants: DataFrame) -> DataFrame:
    """``frame`` with the names in ``columns`` replaced by their standard ones.

    ``variants`` has type, variant and standard; names are compared as :func:`plain_name` gives them, and of a variant
    under several types the last one by type counts.
    """
    chosen = variants.groupBy(plain_name("variant").alias("_variant")).agg(F.max_by("standard", F.struct("type", "standard")).alias("_standard"))
    for column in columns:
        frame = frame.join(chosen, plain_name(column) == F.col("_variant"), "left").withColumn(column, F.coalesce("_standard", column)).drop("_variant", "_standard")
    return frame


def in_order(value: str, position: Column | str) -> Column:
    """The distinct values of an aggregation in the order of ``position``, nulls left out."""
    at = F.col(position) if isinstance(position, str) else position
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(at.alias("p"), F.col(value).alias("x")))))
    return F.array_distinct(F.transform(rows, lambda r: r["x"]))


def folded_entities(nodes: DataFrame, key: Sequence[str] = ("name",)) -> DataFrame:
    """One row for each name with its types, descriptions and chunk ids, each once, in the order of ``pos``, and description, these joined.

    ``nodes`` has pos, name, type, description and chunk_id. A name's values are first made distinct, so that a hot name travels as its few different values.
    """
    long = nodes.select(*key, "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("x")) for c in ("type", "description", "chunk_id")])).alias("v")).where("v.x is not null")
    distinct = long.groupBy(*key, F.col("v.kind").alias("kind"), F.col("v.x").alias("x")).agg(F.min("pos").alias("pos"))
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "x")))), lambda r: r["x"])
    got = distinct.groupBy(*key).agg(pick("type").alias("types"), pick("description").alias("descriptions"), pick("chunk_id").alias("chunk_ids"))
    return got.withColumn("description", F.array_join("descriptions", " | "))


def names_by_type(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """type and name, each name once by its plain form, in the spelling that comes first; ``existing`` (type, name) comes after."""
    rows = nodes.select("type", "name", F.lit(0).alias("late"), "pos")
    if existing is not None:
        rows = rows.unionByName(existing.select("type", "name", F.lit(1).alias("late"), F.lit(0).cast(nodes.schema["pos"].dataType).alias("pos")))
    return rows.groupBy("type", plain_name("name").alias("plain")).agg(F.min_by("name", F.struct("late", "pos", "name")).alias("name")).select("type", "name")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The rows of both tables, of each ``key`` the one with the larger ``version``; at equal ones that of ``new``."""
    order = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "_new")


def merged_entities(old: DataFrame, new: DataFrame, key: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """A full join on ``key``: arrays of both, old values first, each once; other columns of ``old`` where it has the row."""
    rest = [c for c in old.columns if c not in (*key, *arrays)]
    a, b = old.alias("a"), new.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = lambda c: F.array_distinct(F.concat(F.coalesce(F.col(f"a.{c}"), F.array()), F.coalesce(F.col(f"b.{c}"), F.array())))
    return a.join(b, match, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[both(c).alias(c) for c in arrays], *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in rest])


def merged_relations(old: DataFrame, new: DataFrame, key: Sequence[str] = ("start", "type", "target")) -> DataFrame:
    """Relations by ``key`` with the source ids of both; the weight is that of the first table that has the relation."""
    return merged_entities(old, new, key, ["source_ids"])


def missing_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Names that relations mention and ``entities`` lacks."""
    ends = relations.select(F.explode(F.array("start", "target")).alias("name")).distinct()
    return ends.join(entities.select("name").distinct(), "name", "left_anti")


def ingested(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, most_text: int = 500) -> dict[str, DataFrame]:
    """The tables entities, relations, chunks and entity_chunk of a batch: names folded, ends added, chunk texts shortened for the graph."""
    entities = folded_entities(nodes)
    relations = edges.groupBy("start", "type", "target").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("source_ids"), F.lit(1.0).alias("weight"))
    extra = missing_ends(relations, entities).select("name", *[F.lit(None).cast(entities.schema[c].dataType).alias(c) for c in entities.columns if c != "name"])
    links = nodes.select("name", F.col("chunk_id").cast("string").alias("chunk_id")).where("chunk_id is not null").distinct()
    return {"entities": entities.unionByName(extra), "relations": relations, "chunks": chunks.withColumn("text", F.left("text", F.lit(most_text))), "entity_chunk": links}
