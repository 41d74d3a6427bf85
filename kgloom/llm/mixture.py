"""Grouping vectors by Gaussian mixtures.

Vectors are scaled to unit length, standardised and reduced to their leading principal directions. Expectation
maximisation runs on all rows: a task adds up what each component claims of its rows, and only these sums travel. The
number of components is the one with the least Bayesian information criterion; covariances are regularised.

For groups of vectors that are alike to a given cosine, mixtures serve as the index: every row goes to the two components
most likely to have made it, so that rows on either side of a border still meet; components too large for one task are
divided by mixtures of their own, all of a level in one pass, and rows of one component are compared exactly. A second
mixture over other features makes up for pairs that the first one separates. However small the table, it is divided.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import distinct_vectors, unpacked
from kgloom.operators.components import connected_components
from kgloom.session import cut

#: Rows on which a mixture starts, and on which those of the index are fitted.
SAMPLE = 8_000
#: Numbers of components that are compared; where the last is best, :func:`grown` goes on from there.
CHOICES = (4, 8, 16, 32)
#: Leading directions that are kept, and those that the index looks at.
REDUCED, WIDE = 12, 24
#: Rows that components of the index are meant to have, and that one task may hold to compare them.
LEAF, HELD = 8192, 32_768
#: Mixtures over different features in the index, and components each of them takes a row to.
VIEWS, SPILL = 2, 2
#: Rows of a component on which the mixture is fitted that divides it further, and most components of one.
INNER, MOST = 4000, 64


def unit(values):
    exact = values.astype(np.float64)
    return exact / np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]


class Mixture:
    """Weights, means and lower Cholesky factors of the precisions' inverses of a Gaussian mixture."""

    def __init__(self, weights, means, covariances, floor: float):
        d = means.shape[1]
        self.weights, self.means = weights, means
        factors = np.linalg.cholesky(covariances + floor * np.eye(d))
        self.inverse = np.stack([np.linalg.inv(f) for f in factors])
        self.constant = np.log(np.maximum(weights, 1e-300)) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1) - 0.5 * d * math.log(2 * math.pi)
        self.floor = floor

    def log_parts(self, z):
        """Log of each component's weighted density at each row."""
        out = np.empty((len(z), len(self.means)))
        for k, (mean, inverse) in enumerate(zip(self.means, self.inverse)):
            y = (z - mean) @ inverse.T
            out[:, k] = self.constant[k] - 0.5 * np.einsum("ij,ij->i", y, y)
        return out

    def sums(self, z):
        """What expectation adds up: per component its share, its first and second moments, and the log-likelihood."""
        parts = self.log_parts(z)
        top = parts.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(parts - top).sum(axis=1))
        share = np.exp(parts - total[:, None])
        second = np.stack([(z * share[:, k : k + 1]).T @ z for k in range(share.shape[1])])
        return np.concatenate([share.sum(axis=0), (share.T @ z).ravel(), second.ravel(), [total.sum()]])

    def maximised(self, sums):
        k, d = self.means.shape
        n, first, second = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : -1].reshape(k, d, d)
        safe = np.maximum(n, 1e-9)[:, None]
        means = np.where(n[:, None] > 1e-6, first / safe, self.means)
        covariances = second / safe[:, :, None] - means[:, :, None] * means[:, None, :]
        covariances[n < 2 * d] = np.eye(d) * max(self.floor, float(np.mean(np.diagonal(covariances, axis1=1, axis2=2))))
        covariances = 0.5 * (covariances + covariances.transpose(0, 2, 1))
        low = np.linalg.eigvalsh(covariances)[:, 0]
        covariances += np.maximum(0, self.floor - low)[:, None, None] * np.eye(d)
        return Mixture(np.maximum(n, 1e-9) / max(n.sum(), 1e-9), means, covariances, self.floor)


def started(z, k: int, seed: int, steps: int = 12) -> Mixture:
    """A mixture of ``k`` components fitted to the rows of ``z``, from centres spread by squared distance."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(z)))
    centres = [z[rng.integers(len(z))]]
    distance = ((z - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = distance.sum()
        centres.append(z[rng.choice(len(z), p=distance / total)] if total > 0 else z[rng.integers(len(z))])
        distance = np.minimum(distance, ((z - centres[-1]) ** 2).sum(axis=1))
    spread = float(z.var(axis=0).mean()) or 1e-12
    mixture = Mixture(np.full(k, 1 / k), np.array(centres), np.repeat(np.diag(np.maximum(z.var(axis=0), 1e-3 * spread))[None] / max(1, k) ** (2 / z.shape[1]), k, axis=0), 1e-3 * spread)
    for _ in range(steps):
        mixture = mixture.maximised(mixture.sums(z))
    return mixture


def criterion(log_likelihood: float, rows: float, k: int, d: int) -> float:
    """Bayesian information criterion of a mixture with full covariances."""
    return -2 * log_likelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(max(2, rows))


def summed(df: DataFrame, of: Callable, length: int, dim: int):
    """The sum over all rows of ``of(matrix)``, an array of ``length``: added up in each task, then in few, then here."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(length)
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                total += of(unpacked(batch.column(0).slice(part, 4096), dim))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def again(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(length)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    rows = df.select("vec").mapInArrow(add, "s binary").repartition(8).mapInArrow(again, "s binary").collect()
    return sum((np.frombuffer(r.s) for r in rows), np.zeros(length))


def sample_of(df: DataFrame, dim: int, rows: int = SAMPLE):
    """A fixed sample of at most ``rows`` vectors, those with the smallest hashes."""
    got = df.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(rows).collect()
    return np.stack([np.frombuffer(r.vec, "<f4") for r in got]) if got else np.zeros((0, dim), np.float32)


class Reduction:
    """Standardised unit vectors and their principal directions, from the moments of all rows."""

    def __init__(self, vectors: DataFrame, dim: int):
        def moments(values):
            x = unit(values)
            return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

        got = summed(vectors, moments, 1 + dim + dim * dim, dim)
        self.rows = int(got[0])
        n = max(1.0, got[0])
        self.mean = got[1 : 1 + dim] / n
        covariance = got[1 + dim :].reshape(dim, dim) / n - np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diagonal(covariance), 1e-12))
        _, directions = np.linalg.eigh(covariance / np.outer(self.scale, self.scale))
        self.directions = directions[:, ::-1]

    def view(self, number: int, reduced: int = REDUCED):
        """A projection (matrix, offset): the leading directions for 0, random mixtures of more of them for others."""
        dim = len(self.mean)
        kept = self.directions[:, : min(dim, reduced)]
        if number:
            among = min(dim, 4 * reduced)
            turn, _ = np.linalg.qr(np.random.default_rng(1000 + number).standard_normal((among, among)))
            kept = self.directions[:, :among] @ turn[:, : min(among, reduced)]
        matrix = kept / self.scale[:, None]
        return matrix, self.mean @ matrix


def fit(vectors: DataFrame, reduction: Reduction, sample, choices=CHOICES, passes: int = 8, dim: int = 64, seed: int = 5, settled: float = 1e-3) -> tuple[Mixture, dict[int, float]]:
    """The mixture of the least criterion over all rows of ``vectors``, and the criterion of each number of components.

    Mixtures start on ``sample``; then each pass of expectation and maximisation over all rows serves all of them, until
    no criterion gets better by a share of ``settled``, at most ``passes`` times.
    """
    matrix, offset = reduction.view(0)
    d = matrix.shape[1]
    z = unit(sample) @ matrix - offset
    mixtures = [started(z, k, seed) for k in choices if k <= max(1, len(z))] or [started(np.zeros((1, d)), 1, seed)]
    score: dict[int, float] = {}
    for at in range(passes + 1):
        sizes = [len(m.means) * (1 + d + d * d) + 1 for m in mixtures]
        now = list(mixtures)
        got = summed(vectors, lambda x, now=now: np.concatenate([m.sums(unit(x) @ matrix - offset) for m in now]), sum(sizes), dim)
        parts = np.split(got, np.cumsum(sizes)[:-1])
        last, score = score, {len(m.means): criterion(p[-1], reduction.rows, len(m.means), d) for m, p in zip(mixtures, parts)}
        if last and all(last[k] - v < settled * abs(v) for k, v in score.items()):
            break
        if at < passes:
            mixtures = [m.maximised(p) for m, p in zip(mixtures, parts)]
    return min(mixtures, key=lambda m: score[len(m.means)]), score


def grown(vectors: DataFrame, reduction: Reduction, choices=CHOICES, dim: int = 64) -> tuple[Mixture, dict[int, float]]:
    """Like :func:`fit`, doubling the number of components beyond ``choices`` until the criterion rises again.

    Larger mixtures start on larger samples, of 250 rows for each component where there are as many.
    """
    mixture, score = fit(vectors, reduction, sample_of(vectors, dim), choices, dim=dim)
    while len(mixture.means) == max(score) and 2 * max(score) <= reduction.rows:
        k = 2 * max(score)
        more, further = fit(vectors, reduction, sample_of(vectors, dim, max(SAMPLE, 250 * k)), (k,), dim=dim)
        score |= further
        if score[k] < score[k // 2]:
            mixture = more
    return mixture, score


def clusters(vectors: DataFrame, choices=CHOICES, dim: int = 64) -> DataFrame:
    """id, cluster (from 0), confidence (posterior) and density (log density within the cluster) of every vector.

    ``vectors`` has id and vec. An empty table gives an empty table; fewer rows than components give as many as rows.
    """
    vectors = cut(vectors.select("id", "vec"))
    reduction = Reduction(vectors, dim)
    mixture, _ = grown(vectors, reduction, choices, dim)
    matrix, offset = reduction.view(0)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parts = mixture.log_parts(unit(unpacked(batch.column(1), dim)) @ matrix - offset) if batch.num_rows else np.zeros((0, 1))
            best = parts.argmax(axis=1)
            top = parts[np.arange(len(parts)), best]
            share = 1 / np.exp(parts - top[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(share), pa.array(top)], names=["id", "cluster", "confidence", "density"])

    return vectors.mapInArrow(assign, "id string, cluster int, confidence double, density double")


def chosen(z, rows: int, leaf: int, seed: int, steps: int = 12) -> Mixture:
    """The mixture of the least criterion of those whose components would have about ``leaf`` of ``rows`` rows, or half as many, fitted to ``z``; at least 8 components where there are 20 rows for each."""
    least = max(8, math.ceil(SPILL * rows / leaf))
    choices = sorted({min(MOST, max(1, len(z) // 20), f * least) for f in (1, 2)})
    made = [started(z, k, seed, steps) for k in choices]
    return min(made, key=lambda m: criterion(m.sums(z)[-1], len(z), len(m.means), z.shape[1]))


def likely(mixture: Mixture, z, spill: int = SPILL):
    """The ``spill`` most likely components of each row of ``z``, most likely first."""
    parts = mixture.log_parts(z)
    return np.argsort(-parts, axis=1, kind="stable")[:, :spill]


def index(entries: DataFrame, views: int = VIEWS, leaf: int = LEAF, held: int = HELD, dim: int = 64, sample: int = SAMPLE, levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """(view, leaf, no, vec): every entry (no, vec) in its likely components in each view; and (view, leaf, count) of these.

    Mixtures are fitted on at most ``sample`` rows, those that divide a component further on at most INNER of its rows;
    every row is indexed. Components have at most ``held`` rows where mixtures can tell rows apart; the leaf of others
    ends in '!'.
    """
    reduction = Reduction(entries, dim)
    some = sample_of(entries, dim, sample)
    projections = [reduction.view(v, WIDE) for v in range(views)]
    tops = [chosen(unit(some) @ m - o, reduction.rows, leaf, 5 + v) if len(some) else None for v, (m, o) in enumerate(projections)]
    models = entries.sparkSession.sparkContext.broadcast((projections, tops))  # at most MOST components each

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        projections, tops = models.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(unpacked(batch.column(1), dim))
            for v, ((matrix, offset), mixture) in enumerate(zip(projections, tops)):
                for component in likely(mixture, x @ matrix - offset).T:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), v, np.int32)), pa.array([str(c) for c in component.tolist()]), *batch.columns], names=["view", "leaf", "no", "vec"])

    rows = entries.select("no", "vec").mapInArrow(first, "view int, leaf string, no bigint, vec binary")
    for level in range(levels):
        sizes = cut(rows.groupBy("view", "leaf").count())
        large = sizes.where((F.col("count") > held) & ~F.col("leaf").endswith("!"))
        if large.isEmpty():
            break
        apart = _divided(rows.join(large, ["view", "leaf"]), large, reduction, leaf, held, dim, 100 * level)
        rows = cut(rows.join(large, ["view", "leaf"], "left_anti").unionByName(apart))
    return rows, sizes


def _divided(rows: DataFrame, large: DataFrame, reduction: Reduction, leaf: int, held: int, dim: int, seed: int) -> DataFrame:
    """The ``rows`` (view, leaf, no, vec, count) of ``large`` components in those of a mixture of each, in one pass over all of them.

    Each task gets a part of a component's rows, and before them the component's mixture.
    """
    by_hash = Window.partitionBy("view", "leaf").orderBy(F.xxhash64("no"), "no")
    fitted = rows.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= INNER).select("view", "leaf", "count", "vec")

    def fit_one(key, table):
        import pickle

        import pandas as pd

        view, name = table["view"].iloc[0], table["leaf"].iloc[0]
        x = unit(np.stack([np.frombuffer(v, "<f4") for v in table["vec"]]))
        mean, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-12))  # features of the component itself
        model = b""
        if float(x.var(axis=0).sum()) > 1e-9:
            _, directions = np.linalg.eigh(np.cov((x - mean).T / scale[:, None]))
            among = directions[:, ::-1][:, : min(dim, 2 * WIDE)]
            turn, _ = np.linalg.qr(np.random.default_rng([int(view), seed]).standard_normal((among.shape[1], among.shape[1])))
            matrix = among @ (turn if view else np.eye(len(turn)))[:, : min(WIDE, among.shape[1])] / scale[:, None]
            z = (x - mean) @ matrix
            mixture = chosen(z, int(table["count"].iloc[0]), leaf, seed + int(view), 8)
            if np.bincount(likely(mixture, z, 1)[:, 0]).max() < 0.95 * len(z):
                model = pickle.dumps((mixture, matrix, mean @ matrix))
        return pd.DataFrame({"view": [view], "leaf": [name], "vec": [model]})

    models = fitted.groupBy("view", "leaf").applyInPandas(fit_one, "view int, leaf string, vec binary")
    parts = F.ceil(F.col("count") / F.lit(held)).cast("int")
    copies = models.join(large, ["view", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("view", "leaf", "part", F.lit(-1).cast("bigint").alias("no"), "vec")  # nos are not negative
    spread = rows.select("view", "leaf", F.pmod(F.xxhash64("no"), parts).cast("int").alias("part"), "no", "vec")
    ordered = copies.unionByName(spread).repartition("view", "leaf", "part").sortWithinPartitions("view", "leaf", "part", "no")

    def divide(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        model = None
        for batch in batches:
            starts = np.flatnonzero(batch.column(3).to_numpy() < 0).tolist()
            for low, high in zip([0, *starts], [*starts, batch.num_rows]):
                if low in starts:
                    made = batch.column(4)[low].as_py()
                    model = pickle.loads(made) if made else None
                    low += 1
                piece = batch.take(pa.array(np.arange(low, high)))
                if not piece.num_rows:
                    continue
                names = piece.column(1).to_pylist()
                if model is None:
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([f"{n}!" for n in names]), piece.column(3), piece.column(4)], names=["view", "leaf", "no", "vec"])
                    continue
                mixture, matrix, offset = model
                for component in likely(mixture, unit(unpacked(piece.column(4), dim)) @ matrix - offset).T:
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([f"{n}.{c}" for n, c in zip(names, component.tolist())]), piece.column(3), piece.column(4)], names=["view", "leaf", "no", "vec"])

    return ordered.mapInArrow(divide, "view int, leaf string, no bigint, vec binary")


def close_between(exact, quick, rows, columns, similarity: float, strip: int = 512):
    """(row, column) of the pairs of a cosine of at least ``similarity``, once each where ``rows`` are ``columns``; float32 products choose, float64 ones decide."""
    for start in range(0, len(rows), strip):
        some, others = rows[start : start + strip], columns[start:] if rows is columns else columns
        i, j = np.divmod(np.flatnonzero(quick[some] @ quick[others].T >= np.float32(similarity - 1e-5)), max(1, len(others)))
        for part in range(0, len(i), 1 << 18):
            a, b = some[i[part : part + (1 << 18)]], others[j[part : part + (1 << 18)]]
            sure = np.round(np.einsum("ij,ij->i", exact[a], exact[b]), 12) >= similarity
            yield a[sure], b[sure]


def linked(values, similarity: float, asked=None, pivots: int = 4):
    """(a, b) places of rows, links that join exactly the rows joined by cosines of at least ``similarity``, at most one for each row.

    With ``asked``, a mask, only pairs of an asked row and another one count. Else rows alike to a pivot are joined
    through it and need not be compared with each other, so a dense group costs no square of its size.
    """
    exact = unit(values)
    quick = exact.astype(np.float32)
    root = np.arange(len(values))

    def join(i, j):
        nonlocal root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]

    if asked is not None:
        for i, j in close_between(exact, quick, np.flatnonzero(asked), np.flatnonzero(~asked), similarity):
            join(i, j)
    else:
        free, sets = np.arange(len(values)), []
        for _ in range(pivots):
            if len(free) < 512:
                break
            pivot = free[np.argmax(exact[free] @ exact[free].mean(axis=0))]
            near = np.round(exact[free] @ exact[pivot], 12) >= similarity
            if near.mean() < 0.1:
                break
            sets.append(free[near])
            join(np.full(near.sum(), pivot), free[near])
            free = free[~near]
        for at, rows in enumerate(sets):
            for others in (*sets[at + 1 :], free):
                for i, j in close_between(exact, quick, rows, others, similarity):
                    join(i, j)
        for i, j in close_between(exact, quick, free, free, similarity):
            join(i, j)
    at = np.flatnonzero(root != np.arange(len(root)))
    return root[at], at


def close_links(rows: DataFrame, similarity: float, held: int = HELD, dim: int = 64, sizes: DataFrame | None = None) -> DataFrame:
    """a and b: links that join, within each component (view, leaf), exactly the entries joined by cosines of at least ``similarity``.

    A component has at most one link per entry. Of components of more than ``held`` rows, which no mixture divides, all
    rows alike to one of them are linked to it; only rows that are not are compared with all others, in parts.
    """
    sizes = cut(rows.groupBy("view", "leaf").count()) if sizes is None else sizes
    large = sizes.where(F.col("count") > held)
    fits = sizes.where(F.col("count") <= held).count()
    tasks = min(20_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), fits))
    anyhow = large.isEmpty()
    few = rows if anyhow else rows.join(large, ["view", "leaf"], "left_anti")
    blocks = few.select(F.concat_ws("/", "view", "leaf").alias("block"), F.lit(True).alias("asked"), "no", "vec")
    links = _compared(blocks, similarity, tasks, dim)
    return (links if anyhow else links.unionByName(_large_links(rows.join(large, ["view", "leaf"]), large, similarity, held, dim))).distinct()


def _compared(blocks: DataFrame, similarity: float, tasks: int, dim: int) -> DataFrame:
    """Links within each block (block, asked, no, vec): of all pairs, or where some rows are not asked of the asked ones with these."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: list[tuple] = []
        name = None

        def flush():
            if kept:
                asked, nos, values = (np.concatenate(x) for x in zip(*kept))
                kept.clear()
                a, b = linked(values, similarity, None if asked.all() else asked)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(nos[a]), pa.array(nos[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            asked, nos, values = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), unpacked(batch.column(3), dim)
            for low, high in zip(starts, starts[1:]):
                if keys[low] != name:
                    yield from flush()
                    name = keys[low]
                kept.append((asked[low:high].astype(bool), nos[low:high], values[low:high]))
        yield from flush()

    return blocks.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def _large_links(rows: DataFrame, large: DataFrame, similarity: float, held: int, dim: int) -> DataFrame:
    """Links of ``rows`` (view, leaf, count, no, vec) in components too large for a task."""
    by_hash = Window.partitionBy("view", "leaf").orderBy(F.xxhash64("no"), "no")
    some = rows.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= 256)

    def middle(table):
        x = unit(np.stack([np.frombuffer(v, "<f4") for v in table["vec"]]))
        return table.iloc[[int(np.argmax(x @ x.mean(axis=0)))]][["view", "leaf", "count", "no", "vec"]]

    parts = F.ceil(F.col("count") / F.lit(max(1, held // 2))).cast("int")
    pivots = some.groupBy("view", "leaf").applyInPandas(middle, "view int, leaf string, count bigint, no bigint, vec binary")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("view", "leaf", "part", F.col("no").alias("pivot"), F.col("vec").alias("pivot_vec"))
    spread = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))

    def covered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = np.round(np.einsum("ij,ij->i", unit(unpacked(batch.column(5), dim)), unit(unpacked(batch.column(7), dim))), 12) >= similarity
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(near)], names=["view", "leaf", "part", "parts", "no", "vec", "pivot", "near"])

    joined = spread.join(pivots, ["view", "leaf", "part"]).select("view", "leaf", "part", "parts", "no", "vec", "pivot", "pivot_vec")
    marked = cut(joined.mapInArrow(covered, "view int, leaf string, part int, parts int, no bigint, vec binary, pivot bigint, near boolean"))
    through = marked.where("near and no <> pivot").select(F.col("pivot").alias("a"), F.col("no").alias("b"))
    rest = marked.where("not near")
    left = rest.groupBy("view", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, held // 2))).cast("int").alias("rests"))
    name = F.concat_ws("/", "view", "leaf", "part", "q")
    asking = rest.join(left, ["view", "leaf"]).withColumn("q", F.pmod(F.xxhash64("no", F.lit(1)), F.col("rests"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(name.alias("block"), F.lit(True).alias("asked"), "no", "vec")
    others = marked.join(left, ["view", "leaf"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select(name.alias("block"), F.lit(False).alias("asked"), "no", "vec")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return through.unionByName(_compared(asking.unionByName(others), similarity, tasks, dim))


def groups(vectors: DataFrame, similarity: float = 0.85, least: int = 3, views: int = VIEWS, leaf: int = LEAF, held: int = HELD, dim: int = 64) -> DataFrame:
    """group_id (the smallest id) and id of each member of the groups of at least ``least`` vectors that cosines of at least ``similarity`` join.

    ``vectors`` has id (unique) and vec. Equal vectors are one entry of the index, however often they come.
    """
    named = cut(distinct_vectors(vectors, dim))
    entries = cut(named.groupBy("same").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("no", F.monotonically_increasing_id()))
    rows, sizes = index(entries.select("no", "vec"), views, leaf, held, dim)
    links = cut(close_links(rows, similarity, held, dim, sizes))
    joined = connected_components(links).select(F.col("node").alias("no"), "component")
    labelled = entries.join(joined, "no", "left").select("same", "least", "n", F.coalesce("component", "no").alias("component"))
    large = labelled.groupBy("component").agg(F.min("least").alias("group_id"), F.sum("n").alias("n")).where(F.col("n") >= least).select("component", "group_id")
    kept = labelled.join(large, "component").select("same", "group_id")
    return named.join(kept, "same").select("group_id", "id")



def typical(members: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """group_id, id and density (cosine with the mean direction of its group) of ``members`` (group_id, id); ``vectors`` has id and vec."""

    def units(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = unit(unpacked(batch.column(2), dim)) if batch.num_rows else np.zeros((0, dim))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["group_id", "id", "u"])

    rows = cut(members.join(vectors, "id").select("group_id", "id", "vec").mapInArrow(units, "group_id string, id string, u array<double>"))
    middle = rows.groupBy("group_id").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(dim)]).alias("m"))
    dot = "aggregate(zip_with(u, m, (x, y) -> x * y), 0D, (x, y) -> x + y) / sqrt(aggregate(m, 0D, (x, y) -> x + y * y))"
    return rows.join(middle, "group_id").select("group_id", "id", F.round(F.expr(dot), 9).alias("density"))
