"""Mixing sources to target weights.

The mix is a row of slots of about equal size in tokens. Slot i takes the point i times the golden ratio, modulo 1, and
goes to the source in whose stretch of the cumulative weights it falls; such points are spread so evenly that every
source has its share in every stretch of the mix, and not only on the whole. Each source's records are shuffled and laid
end to end, from the start again once they are used up, but not more often than the source may be repeated. This row is
cut at the source's target in tokens and divided into as many equal blocks as the source has slots; its r-th slot takes
the r-th block. Records stay whole and belong to the block in which their middle lies, so a source misses its target by
less than a record, however small it is.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.current import trimmed
from kgloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits text before merging (a fixed value of that public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 2048
#: Stretches that a source's row is cut into for running sums; slots of one chunk.
BUCKETS, CHUNK = 4096, 1 << 16
#: Sources that targets may name; they are held by the driver.
MOST_SOURCES = 10_000
GOLDEN = 0x9E3779B97F4A7C15


@lru_cache(2)
def _encoding(path: str):
    import base64

    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(os.path.basename(path)), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with n_tokens: the tokens of the whole text by the byte-level tokenizer at ``tokenizer``; 0 for null.

    ``tokenizer`` is a file of the driver, or an address that Spark can read; executors get it from the driver.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    keep = [f for f in df.schema if f.name not in (text, "n_tokens")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_tokens bigint"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*[f.name for f in keep], "n_tokens"])

    return df.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def plain_source(column: str):
    return F.lower(trimmed(column))


def laid_out(records: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, n_tokens and middle (in tokens) of each record, the records of a source being shuffled and laid end to end.

    Running sums are taken within stretches of the shuffled order, and over the sums of stretches before, so that a
    source that holds most rows is still spread over many tasks.
    """
    shuffled = records.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)))
    sums = shuffled.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).select("source", "bucket", "offset")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, ["source", "bucket"])
    return placed.select("source", "doc_id", "n_tokens", (F.col("offset") + F.col("inner") + F.col("n_tokens") / 2).alias("middle"))


def slots_of(weights: list[float], start: int, count: int):
    """The source of each of ``count`` slots from ``start``, by golden-ratio points in 64-bit fractions."""
    import numpy as np

    with np.errstate(over="ignore"):
        points = (np.arange(start, start + count, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN >> 1)).astype(np.float64) / 2.0**64
    edges = np.cumsum(weights)
    return np.minimum(np.searchsorted(edges / edges[-1], points, side="right"), len(weights) - 1)


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[list[tuple[str, float, int]], int]:
    """(source, weight, most tokens) of the sources that are there, weights summing to 1, and the mix's size in tokens.

    Without ``total`` the size is the largest at which no source must be repeated more often than it may.
    """
    there = [(s, share, available[s] * repeats) for s, (share, repeats) in sorted(targets.items()) if share > 0 and repeats > 0 and available.get(s)]
    whole = sum(share for _, share, _ in there)
    there = [(s, share / whole, most) for s, share, most in there]
    largest = min((most / weight for _, weight, most in there), default=0)
    return there, int(largest if total is None else total)


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 1, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (slot, source, epoch, doc_id, n_tokens) and its report, one row for each source of either table.

    ``documents`` has doc_id (unique), text and source, ``targets`` source, target_share and max_repeats; sources are
    compared trimmed and in lower case. Targets without documents can't be served: the others share the mix in
    proportion. Documents of a null source or one without a target stay out. The report has source, target_share,
    max_repeats, available_tokens, mix_tokens, actual_share and repeats (how often the source is used up, at most
    max_repeats). Repeated targets of a source count as the one with the largest share. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    records = cut(token_counts(documents.select("doc_id", plain_source("source").alias("source"), "text"), tokenizer=tokenizer))
    wanted = targets.select(plain_source("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    held = wanted.limit(MOST_SOURCES + 1).collect()
    if len(held) > MOST_SOURCES:
        raise ValueError(f"targets name more than {MOST_SOURCES} sources")
    sizes = records.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    names = spark.createDataFrame([(r.source,) for r in held], "source string")
    available = {r.source: r.available_tokens for r in sizes.join(F.broadcast(names), "source").collect()}  # one row for each target
    there, size = plan(available, {r.source: (r.target_share, r.max_repeats) for r in held}, total)
    slots = math.ceil(size / block)
    order = [s for s, *_ in there]
    weights = [w for _, w, _ in there]
    wish = [min(most, w * size) for _, w, most in there]

    def chunks(ranked: bool):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for chunk in batch.column(0).to_pylist():
                    start = chunk * CHUNK
                    source = slots_of(weights, start, min(CHUNK, slots - start))
                    if not ranked:
                        count = np.bincount(source, minlength=len(order))
                        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(order), pa.int64()), pa.array(np.arange(len(order)), pa.int32()), pa.array(count, pa.int64())], names=["chunk", "no", "n"])
                        continue
                    rank = np.zeros(len(source), np.int64)
                    for no in range(len(order)):
                        at = np.flatnonzero(source == no)
                        rank[at] = np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), chunk), pa.int64()), pa.array(source.astype(np.int32)), pa.array(start + np.arange(len(source)), pa.int64()), pa.array(rank)], names=["chunk", "no", "slot", "inner"])

        return run

    every = spark.range(math.ceil(slots / CHUNK) if order else 0)
    before = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.mapInArrow(chunks(False), "chunk bigint, no int, n bigint").withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("chunk", "no", "offset")
    dim = spark.createDataFrame([(i, s, float(available[s]), float(wish[i])) for i, s in enumerate(order)], "no int, source string, available double, wish double")
    counted = every.mapInArrow(chunks(False), "chunk bigint, no int, n bigint").groupBy("no").agg(F.sum("n").alias("count"))
    blocks = F.broadcast(dim.join(counted, "no").where("count > 0").withColumn("size", F.col("wish") / F.col("count")))  # one row for each source of the targets
    ranks = every.mapInArrow(chunks(True), "chunk bigint, no int, slot bigint, inner bigint").join(offsets, ["chunk", "no"]).join(blocks.select("no", "source"), "no")
    taken = ranks.select("slot", "source", (F.col("offset") + F.col("inner")).alias("rank"))
    row = laid_out(records.join(blocks.select("source"), "source"), seed).join(blocks, "source")
    row = row.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("wish") / F.col("available")).cast("int") - 1)))
    row = row.withColumn("at", F.col("epoch") * F.col("available") + F.col("middle")).where("at < wish")
    row = row.select("source", "doc_id", "n_tokens", "epoch", F.least(F.floor(F.col("at") / F.col("size")), F.col("count") - 1).cast("bigint").alias("rank"))
    mixed = cut(taken.join(row, ["source", "rank"]).select("slot", "source", "epoch", "doc_id", "n_tokens"))
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"))
    whole = mixed.agg(F.sum("n_tokens").alias("whole"))
    report = wanted.join(sizes.where("source is not null"), "source", "full").join(reached, "source", "left").crossJoin(F.broadcast(whole))  # one row
    counted = {"available_tokens": F.coalesce("available_tokens", F.lit(0)), "mix_tokens": F.coalesce("mix_tokens", F.lit(0))}
    report = report.withColumns(counted).select(
        "source", "target_share", "max_repeats", "available_tokens", "mix_tokens", F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.try_divide("mix_tokens", "available_tokens").alias("repeats")
    )
    return mixed, report
