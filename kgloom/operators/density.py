"""Clusters of different density within small groups of vectors, by the hierarchy of mutual reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a group; its distances are held by one task.
MOST = 5_000


def density_labels(x, least_size: int = 2, neighbours: int = 1):
    """The cluster of each row of a matrix, from 0 in the order of rows; -1 for rows that belong to none.

    The spanning tree of mutual reachability (the larger of a distance and both ends' distance to their neighbour of rank
    ``neighbours``) is cut from its longest link on. A side of at least ``least_size`` rows is a cluster as long as it
    lasts, and of nested clusters those that hold most rows over the widest range of 1 / distance are taken; the whole is none.
    """
    import numpy as np

    n = len(x)
    if n < 2:
        return np.full(n, -1)
    square = (x * x).sum(axis=1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(distance, np.inf)
    core = np.partition(distance, min(neighbours, n - 1) - 1, axis=1)[:, min(neighbours, n - 1) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), distance)
    # spanning tree, from row 0 on
    best, origin, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    links = []
    for _ in range(n - 1):
        at = int(np.argmin(np.where(inside, np.inf, best)))
        links.append((float(best[at]), int(origin[at]), at))
        inside[at] = True
        closer = reach[at] < best
        best, origin = np.where(closer, reach[at], best), np.where(closer, at, origin)
    # the dendrogram: node n + i joins two sides at the i-th shortest link
    up, top, size, sides = list(range(n)), list(range(n)), [1] * n, []

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    for length, a, b in sorted(links):
        a, b = find(a), find(b)
        sides.append((top[a], top[b], 1 / max(length, 1e-12)))
        size.append(size[top[a]] + size[top[b]])
        up[b], top[a] = a, n + len(sides) - 1
    # clusters from the top down: born where a side parts, losing rows until they part again
    parent, birth, stability, home = [-1], [0.0], [0.0], np.zeros(n, int)
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            home[node] = cluster
            continue
        a, b, level = sides[node - n]
        large = [s for s in (a, b) if size[s] >= least_size]
        for side in (a, b):
            if len(large) == 2:
                stability[cluster] += size[side] * (level - birth[cluster])
                parent.append(cluster), birth.append(level), stability.append(0.0)
                todo.append((side, len(parent) - 1))
            elif side in large:
                todo.append((side, cluster))
            else:
                stability[cluster] += size[side] * (level - birth[cluster])
                rows = [side]
                while rows:
                    row = rows.pop()
                    if row < n:
                        home[row] = cluster
                    else:
                        rows += sides[row - n][:2]
    taken, worth, below = [False] * len(parent), list(stability), [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        taken[c] = stability[c] >= below[c]
        worth[c] = max(stability[c], below[c])
        below[parent[c]] += worth[c]
    owner = [-1] * len(parent)  # the outermost cluster that is taken
    for c in range(1, len(parent)):
        owner[c] = owner[parent[c]] if owner[parent[c]] >= 0 else c if taken[c] else -1
    found = np.array(owner)[home]
    order: dict[int, int] = {}
    return np.array([-1 if c < 0 else order.setdefault(int(c), len(order)) for c in found])


def density_clusters(df: DataFrame, group: str, item: str, vector: str, least_size: int = 2, neighbours: int = 1, most: int = MOST) -> DataFrame:
    """``group``, ``item`` and cluster of every vector that is not null; where a group has no cluster, all of it is cluster 0.

    ``vector`` is an array of numbers. -1 are vectors that belong to no cluster. A group is one task's, so more than
    ``most`` vectors in one raise an error. Repeated items count each by itself; an empty table gives an empty table.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (group, item)]
    rows = df.select(F.col(group).alias("_group"), F.col(item).alias("_item"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    held = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(held, rows["_group"].eqNullSafe(held["_group"])).drop(held["_group"]).withColumn("_n", F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.raise_error(F.lit(f"a group has more than {most} vectors")).cast("bigint")))

    def run(table):
        import numpy as np

        table = table.sort_values("_item", kind="stable")
        labels = density_labels(np.stack(table["_v"].to_numpy()), least_size, neighbours)
        out = table[["_group", "_item"]].copy()
        out["cluster"] = labels if (labels >= 0).any() else 0
        return out

    return rows.groupBy("_group").applyInPandas(run, f"_group {kinds[0]}, _item {kinds[1]}, cluster int").select(F.col("_group").alias(group), F.col("_item").alias(item), "cluster")
