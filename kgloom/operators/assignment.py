"""Which cluster a new item belongs to, by words and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import topic_tokens
from kgloom.operators.retrieval import bounded

#: Where new clusters go.
MISC = "cluster_misc"
#: Scores, of items with clusters, that a task holds at once, and numbers in the rows of each kind that it keeps for other items.
AT_ONCE, KEPT = 250_000, 4_000_000


def _lists(pairs: set[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``n`` lists begins, and the values of all, from pairs of list and value."""
    rows = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(rows[:, 0], np.arange(n + 1)), rows[:, 1].copy()


def _spread(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists ``at``, each after the position in ``at`` that brought it."""
    starts, values = lists
    n = starts[at + 1] - starts[at]
    origin = np.repeat(np.arange(len(at)), n)
    return origin, values[np.arange(len(origin)) + np.repeat(starts[at] - np.cumsum(n) + n, n)]


def _turns(rows: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows that have a first value, a second and so on, and where in the sorted ``rows`` it is."""
    count = np.bincount(rows, minlength=n)
    start = np.cumsum(count) - count
    for k in range(count.max(initial=0)):
        who = np.flatnonzero(count > k)
        yield who, start[who] + k


class _Kept:
    """Rows with a number for each cluster, made when first wanted and kept while there is room."""

    def __init__(self, make: Callable[[list], np.ndarray], width: int):
        self.make, self.at, self.rows = make, {}, np.empty((max(1, KEPT // width), width))

    def __call__(self, keys: list, which: np.ndarray) -> np.ndarray:
        """The rows of the keys ``which``, of which no more may differ than are held at once."""
        used, back = np.unique(which, return_inverse=True)
        wanted = [keys[i] for i in used]
        new = list(dict.fromkeys(k for k in wanted if k not in self.at))
        if len(self.at) + len(new) > len(self.rows):
            self.at, new = {}, list(dict.fromkeys(wanted))
        if new:
            end = len(self.at) + len(new)
            self.rows[len(self.at):end] = self.make(new)
            self.at.update(zip(new, range(len(self.at), end)))
        return self.rows[np.array([self.at[k] for k in wanted])[back]]


class _Known:
    """Clusters by their words, in the order in which they were given; phrases are tokens joined by blanks."""

    def __init__(self, clusters: list[list[str]]):
        sets = [sorted({tuple(sorted(set(p.split(" ")))) for p in own}) for own in clusters]
        self.tokens = {t: i for i, t in enumerate(sorted({t for own in sets for p in own for t in p}))}
        phrases = [p for own in sets for p in own]
        self.owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
        self.length = np.array([len(p) for p in phrases])
        self.size = np.array([len({t for p in own for t in p}) for own in sets])
        self.by_phrase = _lists({(self.tokens[t], i) for i, p in enumerate(phrases) for t in p}, len(self.tokens))
        self.by_cluster = _lists({(self.tokens[t], c) for c, own in enumerate(sets) for p in own for t in p}, len(self.tokens))

    def having(self, tokens: list[int]) -> np.ndarray:
        """1 where a cluster has the token."""
        rows = np.zeros((len(tokens), len(self.size)))
        rows[_spread(self.by_cluster, np.array(tokens))] = 1
        return rows

    def closest(self, phrases: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
        """The largest Jaccard share of phrases, given by their number of tokens and those that are known, with one of a cluster's."""
        rows, n = np.zeros((len(phrases), len(self.size))), len(self.length)
        size, held = np.array([s for s, _ in phrases]), [t for _, t in phrases]
        mine = np.repeat(np.arange(len(held)), [len(t) for t in held])
        origin, other = _spread(self.by_phrase, np.array([i for t in held for i in t], np.int64))
        pairs, shared = np.unique(mine[origin] * n + other, return_counts=True)
        mine, other = np.divmod(pairs, n)
        np.maximum.at(rows, (mine, self.owner[other]), shared / (size[mine] + self.length[other] - shared))
        return rows

    def best(self, n: int, row: np.ndarray, which: np.ndarray, phrases: list[str], having: _Kept, closest: _Kept) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and score of ``n`` items, of equal scores the last cluster; -1 for an item without phrases. Phrase ``which`` is of the item ``row``."""
        sets, more = [sorted(set(p.split(" "))) for p in phrases], {}
        ids = [[self.tokens[t] if t in self.tokens else more.setdefault(t, len(self.tokens) + len(more)) for t in s] for s in sets]
        keys = [(len(i), tuple(x for x in i if x < len(self.tokens))) for i in ids]
        every, names = len(self.tokens) + len(more), range(len(self.tokens))
        origin, token = _spread(_lists({(p, t) for p, i in enumerate(ids) for t in i}, len(ids)), which)
        item, token = np.divmod(np.unique(row[origin] * every + token), max(every, 1))
        size = np.bincount(item, minlength=n)
        item, token = item[token < len(names)], token[token < len(names)]
        at, score = np.full(n, -1), np.zeros(n)
        step = max(1, AT_ONCE // len(self.size))
        for low in range(0, n, step):
            m = min(step, n - low)
            shared, first, second, third = np.zeros((4, m, len(self.size)))
            a, b = np.searchsorted(item, (low, low + m))
            for who, k in _turns(item[a:b] - low, m):
                shared[who] += having(names, token[a:b][k])
            a, b = np.searchsorted(row, (low, low + m))
            for who, k in _turns(row[a:b] - low, m):
                x = closest(keys, which[a:b][k])
                for top in (first, second, third):
                    held = top[who]
                    top[who], x = np.maximum(held, x), np.minimum(held, x)
            tokens = np.maximum(size[low : low + m, None], 1)
            soft = (first + second + third) / np.clip(np.bincount(row[a:b] - low, minlength=m), 1, 3)[:, None]
            got = 0.5 * shared / tokens + 0.3 * (shared / (tokens + self.size - shared)) + 0.2 * soft
            last = len(self.size) - 1 - got[:, ::-1].argmax(axis=1)
            has = size[low : low + m] > 0
            at[low : low + m], score[low : low + m] = np.where(has, last, -1), np.where(has, got[np.arange(m), last], 0.0)
        return at, score


def by_words(items: DataFrame, clusters: DataFrame, least: float = 0.08) -> DataFrame:
    """item, cluster_id, score, confidence and is_new: the cluster whose name, description and themes share most with an item's keywords.

    The score is half the share of the item's tokens found, three tenths the Jaccard share of tokens, and two tenths the
    mean of the three best matches of its phrases. Below ``least``, or without tokens, the item is new. ``items`` has item
    and keywords, ``clusters``, which are few, cluster_id, name, description and themes. Items aren't joined with clusters:
    a task looks up each token and phrase once for all clusters, and adds up what it found for its items.
    """
    phrases = lambda array: F.filter(F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda p: F.array_join(topic_tokens(p), " ")), lambda t: t != "")
    described = clusters.select("cluster_id", phrases(F.concat(F.array("name", "description"), F.coalesce("themes", F.array().cast("array<string>")))).alias("phrases"))
    listed = bounded(described.where(F.size("phrases") > 0)).orderBy("cluster_id").toArrow().combine_chunks()
    ids = listed.column("cluster_id").combine_chunks()
    held = items.sparkSession.sparkContext.broadcast(_Known(listed.column("phrases").to_pylist()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = held.value
        if not len(known.size):
            return
        having, closest = _Kept(known.having, len(known.size)), _Kept(known.closest, len(known.size))
        for batch in batches:
            told = pc.list_flatten(batch.column(1)).dictionary_encode()
            row, which = pc.list_parent_indices(batch.column(1)).to_numpy(), told.indices.to_numpy().astype(np.int64)
            at, score = known.best(batch.num_rows, row, which, told.dictionary.to_pylist(), having, closest)
            with_words = pa.array(np.flatnonzero(at >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(with_words), ids.take(pa.array(at[at >= 0])), pa.array(score[at >= 0])], names=["item", "cluster_id", "score"])

    said = items.select("item", phrases(F.col("keywords")).alias("phrases"))
    pairs = said.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, cluster_id {clusters.schema['cluster_id'].dataType.simpleString()}, score double")
    got = pairs.groupBy("item").agg(F.max_by(F.struct("cluster_id", "score"), F.struct("score", "cluster_id")).alias("m"))
    rows = items.select("item").join(got, "item", "left").select("item", "m.cluster_id", F.coalesce("m.score", F.lit(0.0)).alias("score"))
    fits = F.col("score") >= least
    return rows.select("item", F.when(fits, F.col("cluster_id")).alias("cluster_id"), "score", F.round(F.when(fits, F.greatest(F.lit(0.3), F.least(F.lit(0.95), "score"))).otherwise(1 - F.col("score")), 3).alias("confidence"), (~fits).alias("is_new"))


def guarded(scores: DataFrame, threshold: float = 0.3, vector_weight: float = 0.6, word_weight: float = 0.4) -> DataFrame:
    """item, cluster_id, score and is_new for items that would be new: the best cluster by words and vectors, if it reaches ``threshold``.

    ``scores`` has item, cluster_id, word_score and vector_score. Vectors don't count for an item without any positive one.
    What stays new goes to :data:`MISC`.
    """
    positive = scores.groupBy("item").agg((F.max("vector_score") > 0).alias("has"))
    weight = F.when(F.coalesce("has", F.lit(False)), vector_weight).otherwise(0.0)
    rows = scores.join(positive, "item").withColumn("score", (weight * F.coalesce("vector_score", F.lit(0.0)) + word_weight * F.col("word_score")) / (weight + word_weight))
    best = rows.groupBy("item").agg(F.max_by(F.struct("cluster_id", "score"), F.struct("score", "cluster_id")).alias("m"))
    fits = F.col("m.score") >= threshold
    return best.select("item", F.when(fits, F.col("m.cluster_id")).otherwise(MISC).alias("cluster_id"), F.col("m.score").alias("score"), (~fits).alias("is_new"))
