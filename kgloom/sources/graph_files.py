"""Knowledge graphs as JSON: reading them as tables, and writing tables as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id bigint, orig_id string, title string, cluster_id string, cluster_name string, cluster_confidence double, subcluster_id string, keywords array<struct<term string, score double>>, top_keywords array<string>, create_time bigint, update_time bigint, num_sections int, source_type string"
EDGE = "source bigint, target bigint, weight double, type string, is_intra_cluster boolean, confidence string"


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables nodes, edges and clusters of graph files; clusters may be a list, a map by id, or lie under metadata."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null")
    pick = lambda p, t: F.try_variant_get("v", p, t)
    nodes = raw.select(F.explode(pick("$.nodes", "array<variant>")).alias("n"))
    field = lambda c, name, kind: F.try_variant_get(c, f"$.{name}", kind).alias(name)
    split = lambda schema: [tuple(f.strip().split(" ", 1)) for f in _fields(schema)]
    node_rows = nodes.select(*[field("n", n, t) for n, t in split(NODE)])
    edge_rows = raw.select(F.explode(pick("$.edges", "array<variant>")).alias("e")).select(*[field("e", n, t) for n, t in split(EDGE)])
    as_list = raw.select(F.explode(F.coalesce(pick("$.clusters", "array<variant>"), pick("$.metadata.clusters", "array<variant>"), F.array().cast("array<variant>"))).alias("c"), F.lit(None).cast("string").alias("key"))
    as_map = raw.select(F.explode(F.coalesce(pick("$.clusters", "map<string,variant>"), pick("$.metadata.clusters", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))).alias("key", "c")).select("c", "key")
    both = as_list.unionByName(as_map)
    clusters = both.select(
        F.coalesce(F.try_variant_get("c", "$.id", "string"), F.try_variant_get("c", "$.clusterId", "string"), "key").alias("cluster_id"), F.try_variant_get("c", "$.name", "string").alias("name"), F.try_variant_get("c", "$.description", "string").alias("description"),
        F.coalesce(F.try_variant_get("c", "$.key_themes", "array<string>"), F.try_variant_get("c", "$.themes", "array<string>")).alias("themes"),
    )
    return {"nodes": node_rows, "edges": edge_rows, "clusters": clusters}


def _fields(schema: str) -> list[str]:
    """The fields of a schema string, commas inside types apart."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def shown_nodes(nodes: DataFrame, terms: int = 5) -> DataFrame:
    """Nodes as a front end takes them."""
    return nodes.select("id", "orig_id", "title", F.coalesce("cluster_id", F.lit("unknown")).alias("cluster_id"), F.coalesce("cluster_name", F.lit("Unknown")).alias("cluster_name"), F.slice(F.transform("keywords", lambda k: k["term"]), 1, terms).alias("keywords"), "num_sections", "source_type")


def shown_edges(edges: DataFrame) -> DataFrame:
    """Edges as a front end takes them: hard ones are those of high confidence, others are insights."""
    return edges.select("source", "target", "weight", F.when(F.col("confidence") == "high", "hard").otherwise("insight").alias("type"), F.coalesce("is_intra_cluster", F.lit(False)).alias("is_intra_cluster"))


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under ``folder``, written anew."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def stored_metadata(df: DataFrame) -> DataFrame:
    """Columns as a vector store takes them: no nulls, arrays of strings joined by commas, other nested values as JSON."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(F.coalesce(F.col(f.name), F.array().cast("array<string>")), ",").alias(f.name))
        elif kind.startswith(("array", "map", "struct")):
            out.append(F.coalesce(F.to_json(f.name), F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if kind == "string" else F.col(f.name))
    return df.select(*out)
