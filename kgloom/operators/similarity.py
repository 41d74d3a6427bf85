"""Exact similarities between vectors, by blocks of rows.

All pairs of two sets are compared as products of blocks: a row goes to one task for each block of the other side, and
nothing but pairs that pass the threshold leaves a task. This costs rows squared, as an exact answer does; for large
tables use an index instead. Distribution figures over all pairs are exact too: one pass bins all similarities, a second
one fetches the few values around the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut

BLOCK = 2048
BINS = 20_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of doubles, without Python."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column | str) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    x = F.col(a) if isinstance(a, str) else a
    length = norm(x)
    return F.when(length > 0, F.transform(x, lambda v: v.cast("double") / length)).otherwise(x.cast("array<double>"))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def _blocked(df: DataFrame, key: str, vector: str, side: str, blocks: int, others: int, self_join: bool) -> DataFrame:
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    if self_join:
        parts = F.expr(f"transform(sequence(0, {others} - 1), p -> struct(least(p, own) as i, greatest(p, own) as j))")
    else:
        parts = F.expr(f"transform(sequence(0, {others} - 1), p -> struct({'own as i, p as j' if side == 'a' else 'p as i, own as j'}))")
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), own.alias("own")).select("key", "v", "own", F.explode(parts).alias("part"))
    return rows.select("part.i", "part.j", F.lit(side).alias("side"), "own", "key", "v")


def _compared(left: DataFrame, right: DataFrame | None, key: str, vector: str, schema: str, emit, cosine: bool, blocks: int | None = None) -> DataFrame:
    """Runs ``emit(keys_a, keys_b, similarities, upper)`` on each block pair; upper marks one block against itself."""
    self_join = right is None
    n = blocks or max(1, math.ceil(left.count() / BLOCK))
    m = n if self_join else blocks or max(1, math.ceil(right.count() / BLOCK))
    rows = _blocked(left, key, vector, "a", n, m, self_join)
    if not self_join:
        rows = rows.unionByName(_blocked(right, key, vector, "b", m, n, False))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held: dict[str, list] = {}
        name = None

        def unit(rows):
            values = np.array([r[1] for r in rows], float)
            if cosine:
                length = np.sqrt((values * values).sum(axis=1, keepdims=True))
                values = np.divide(values, length, out=np.zeros_like(values), where=length > 0)
            return np.array([r[0] for r in rows]), values

        def flush():
            if self_join:
                sides = sorted(held)
                a = held[sides[0]] if sides else []
                b = held[sides[1]] if len(sides) > 1 else None
                if a and (b or name[0] == name[1]):
                    ka, va = unit(a)
                    kb, vb = unit(b) if b else (ka, va)
                    yield emit(ka, kb, va @ vb.T, b is None)
            elif held.get("a") and held.get("b"):
                (ka, va), (kb, vb) = unit(held["a"]), unit(held["b"])
                yield emit(ka, kb, va @ vb.T, False)
            held.clear()

        for batch in batches:
            for i, j, side, own, k, v in zip(*[c.to_pylist() for c in batch.columns]):
                if (i, j) != name:
                    yield from flush()
                    name = (i, j)
                held.setdefault(own if self_join else side, []).append((k, v))
        yield from flush()

    return rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, schema)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, other: DataFrame | None = None, cosine: bool = True) -> DataFrame:
    """source, target and similarity of all pairs of at least ``threshold`` (inclusive): within ``df`` source < target, else from it to ``other``.

    Keys are bigint. Vectors must be of one size and not null; zero vectors have cosine 0.
    """

    within = other is None

    def emit(ka, kb, s, upper):
        import numpy as np
        import pyarrow as pa

        i, j = np.nonzero(s >= threshold)
        a, b, value = ka[i], kb[j], s[i, j]
        if within:
            keep = a < b if upper else np.ones(len(a), bool)
            a, b, value = np.minimum(a, b)[keep], np.maximum(a, b)[keep], value[keep]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(value)], names=["source", "target", "similarity"])

    return _compared(df, other, key, vector, "source bigint, target bigint, similarity double", emit, cosine)


def similarity_stats(df: DataFrame, key: str, vector: str, quantiles: Sequence[float] = (0.9, 0.75)) -> DataFrame:
    """One row: count, max, min, mean and the exact quantiles (p90, p75, ...) of the cosines of all pairs; nulls where there is no pair.

    Quantiles lie between neighbouring values, as linear interpolation has it.
    """
    df = cut(df.select(key, vector))

    def upper_values(s, upper):
        import numpy as np

        return s[np.triu_indices(len(s), 1)] if upper else s.ravel()

    def tell(ka, kb, s, upper):
        import numpy as np
        import pyarrow as pa

        values = upper_values(s, upper)
        at = np.clip(((values + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        bins, counts = np.unique(at, return_counts=True)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(values[order], np.searchsorted(at[order], bins)) if len(values) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts.astype(np.int64)), pa.array(sums), pa.array([values.min()] * len(bins) if len(values) else []).cast(pa.float64()), pa.array([values.max()] * len(bins) if len(values) else []).cast(pa.float64())], names=["bin", "n", "s", "low", "high"])

    told = _compared(df, None, key, vector, "bin bigint, n bigint, s double, low double, high double", tell, True)
    bins = told.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bin").collect()  # at most BINS rows
    count = sum(r.n for r in bins)
    names = [f"p{round(q * 100)}" for q in quantiles]
    schema = "count bigint, max double, min double, mean double, " + ", ".join(f"{n} double" for n in names)
    if not count:
        return df.sparkSession.createDataFrame([(0, *[None] * (3 + len(names)))], schema)
    ranks = sorted({r for q in quantiles for r in (math.floor(q * (count - 1)), math.ceil(q * (count - 1)))})
    before, needed = 0, {}
    for r in bins:
        for rank in ranks:
            if before <= rank < before + r.n:
                needed.setdefault(r.bin, []).append((rank, rank - before))
        before += r.n
    wanted = sorted(needed)

    def fetch(ka, kb, s, upper):
        import numpy as np
        import pyarrow as pa

        values = upper_values(s, upper)
        at = np.clip(((values + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        keep = np.isin(at, wanted)
        return pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(values[keep])], names=["bin", "value"])

    near = _compared(df, None, key, vector, "bin bigint, value double", fetch, True)
    placed = near.withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy("value")) - 1)
    keys = df.sparkSession.createDataFrame([(b, inner, rank) for b, rs in needed.items() for rank, inner in rs], "bin bigint, at int, rank bigint")
    value = {r.rank: r.value for r in placed.join(F.broadcast(keys), ["bin", "at"]).collect()}  # two rows for each quantile
    found = []
    for q in quantiles:
        exact = q * (count - 1)
        low, high = value[math.floor(exact)], value[math.ceil(exact)]
        found.append(low + (high - low) * (exact - math.floor(exact)))
    row = (count, max(r.high for r in bins), min(r.low for r in bins), sum(r.s for r in bins) / count, *found)
    return df.sparkSession.createDataFrame([tuple(None if x is None else x if isinstance(x, int) else float(x) for x in row)], schema)


def adaptive_thresholds(stats: DataFrame, high: float = 0.8, medium: float = 0.6) -> DataFrame:
    """high, medium and adjusted: the wanted thresholds, lowered where no similarity reaches them.

    The lowered ones stay below the maximum, not below the 90th percentile, and a little apart. Unchanged without a positive maximum.
    """
    top, p90 = F.col("max"), F.col("p90")
    low_medium = F.greatest(F.least(F.greatest(F.least(F.lit(medium), top * 0.85), F.coalesce(p90, F.lit(-1.0))), top - 1e-4), F.lit(0.0))
    low_high = F.greatest(F.least(F.greatest(F.least(F.lit(high), top * 0.95), F.coalesce(p90, F.lit(-1.0))), top - 5e-4), low_medium + 5e-3)
    known = top.isNotNull() & ~F.isnan(top) & (top > 0)
    first = stats.select(
        "max", low_high.alias("lh"), F.when(known & (top < medium), low_medium).otherwise(F.lit(medium)).alias("m"), F.when(known & (top < high), low_high).otherwise(F.lit(high)).alias("h"), (known & ((top < medium) | (top < high))).alias("adjusted"), known.alias("known")
    )
    close = F.col("known") & (F.col("h") <= F.col("m"))
    fixed = first.withColumn("h2", F.when(close, F.least(top - 1e-4, F.greatest(F.col("m") + 0.01, F.col("lh")))).otherwise(F.col("h")))
    return fixed.select(F.col("h2").alias("high"), F.when(close, F.greatest(F.least(F.col("m"), F.col("h2") - 0.01), F.lit(0.0))).otherwise(F.col("m")).alias("medium"), "adjusted")


def candidate_edges(pairs: DataFrame, clusters: DataFrame, high: float, medium: float) -> DataFrame:
    """``pairs`` of at least ``medium`` with weight, tier (high or medium) and is_intra: both ends in the same known cluster.

    ``clusters`` has node (bigint) and cluster.
    """
    a = clusters.select(F.col("node").alias("source"), F.col("cluster").alias("source_cluster"))
    b = clusters.select(F.col("node").alias("target"), F.col("cluster").alias("target_cluster"))
    rows = pairs.where(F.col("similarity") >= medium).join(a, "source", "left").join(b, "target", "left")
    return rows.select("source", "target", F.col("similarity").alias("weight"), F.when(F.col("similarity") >= high, "high").otherwise("medium").alias("tier"), F.coalesce(F.col("source_cluster") == F.col("target_cluster"), F.lit(False)).alias("is_intra"), "source_cluster", "target_cluster")


def top_matches(pairs: DataFrame, k: int, by: str = "source", other: str = "target") -> DataFrame:
    """The ``k`` most similar partners of each ``by``, ranked from 1; equal ones by ``other``. Pairs of a node with itself are left out first."""
    order = Window.partitionBy(by).orderBy(F.desc("similarity"), other)
    return pairs.where(F.col(by) != F.col(other)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stratified_approval(verdicts: DataFrame, step: float = 0.05, least: float = 0.1) -> DataFrame:
    """Approved candidates (similarity, approved) down to and with the highest stratum whose approval rate is below ``least``."""
    rows = verdicts.withColumn("stratum", F.floor(F.col("similarity") / step + 1e-9))
    rates = rows.groupBy("stratum").agg(F.avg(F.col("approved").cast("double")).alias("rate"))
    stop = rates.agg(F.max(F.when(F.col("rate") < least, F.col("stratum"))).alias("stop"))
    return rows.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("stratum") >= F.col("stop"))).where("approved").drop("stop")  # one row


def pooled(df: DataFrame, group: Sequence[str], vector: str, weight: str | None = None, unit_length: bool = False) -> DataFrame:
    """The weighted mean vector of each group; weights of zero in total count all rows alike; at unit length on demand.

    Each dimension is a row of an aggregation, so no group is ever collected.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*group, w.alias("w"), F.posexplode(F.col(vector)).alias("d", "x"))
    sums = rows.groupBy(*group, "d").agg(F.sum(F.col("w") * F.col("x")).alias("a"), F.sum("w").alias("b"), F.avg(F.col("x").cast("double")).alias("plain"))
    mean = F.when(F.col("b") != 0, F.col("a") / F.col("b")).otherwise(F.col("plain"))
    out = sums.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", mean.alias("m")))), lambda s: s["m"]).alias("vector"))  # one entry for each dimension
    return out.withColumn("vector", normalised("vector")) if unit_length else out
