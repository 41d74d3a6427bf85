"""The library's functions by name, for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession, prefix: str = "kg_") -> list[str]:
    """Registers {prefix}extract_json, {prefix}sentence_chunks and {prefix}seeded_vector; returns their names. They run in Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    from kgloom.functions.text import seeded_vector
    from kgloom.operators.parsing import extract_json
    from kgloom.operators.sequence import sentence_chunks

    @arrow_udf("string")
    def found(values):
        import pyarrow as pa

        return pa.array([extract_json(v) for v in values.to_pylist()], pa.string())

    @arrow_udf("array<string>")
    def chunks(values):
        import pyarrow as pa

        return pa.array([sentence_chunks(v) for v in values.to_pylist()], pa.list_(pa.string()))

    made = {"extract_json": found, "sentence_chunks": chunks, "seeded_vector": seeded_vector()}
    for name, function in made.items():
        spark.udf.register(prefix + name, function)
    return [prefix + n for n in made]
