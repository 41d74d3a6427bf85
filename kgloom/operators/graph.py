"""Graph algorithms on node and edge tables: communities, cliques, neighbourhoods, paths and what describes a group.

Algorithms that need a whole group at once run per group in one task and say so; groups there are clusters of a knowledge
graph, for which ``most`` bounds the edges of a task. Everything else is joins and aggregations.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.components import connected_components
from kgloom.session import cut

#: Edges of a group that one task may hold.
MOST_EDGES = 2_000_000


def both_ways(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, peer and the edges' other columns, once in each direction."""
    rest = [c for c in edges.columns if c not in (source, target)]
    return edges.select(F.col(source).alias("node"), F.col(target).alias("peer"), *rest).unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("peer"), *rest))


def inner_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the same group of ``members`` (group, node), with that group; a node may be in several."""
    a = members.select("group", F.col("node").alias("source"))
    b = members.select("group", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["group", "target"])


def group_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """group, size, internal_edges, density and cohesion (mean weight), 0 for groups of one."""
    inside = inner_edges(edges, members).groupBy("group").agg(F.count(F.lit(1)).alias("internal_edges"), F.avg("weight").alias("cohesion"))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inside, "group", "left").select(
        "group", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.when(F.col("size") > 1, F.coalesce("internal_edges", F.lit(0)) / pairs).otherwise(0.0).alias("density"), F.coalesce("cohesion", F.lit(0.0)).alias("cohesion")
    )


def representatives(edges: DataFrame, members: DataFrame) -> DataFrame:
    """group and the node with the largest weighted degree inside it; the smallest of equal ones, and where there is no edge."""
    degree = both_ways(inner_edges(edges, members)).groupBy("group", "node").agg(F.sum("weight").alias("degree"))
    ranked = members.join(degree, ["group", "node"], "left").select("group", "node", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    return ranked.groupBy("group").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("representative"))


def communities_by_components(edges: DataFrame, members: DataFrame, least_weight: float = 0.0, least_size: int = 2) -> DataFrame:
    """group, node and community (its smallest node) of the connected parts of each group, along edges of at least ``least_weight``."""
    inside = inner_edges(edges.where(F.col("weight") >= least_weight), members)
    links = inside.select(F.struct("group", F.col("source").alias("node")).alias("a"), F.struct("group", F.col("target").alias("node")).alias("b"))
    text = lambda c: F.concat_ws("\u0001", F.col(f"{c}.group").cast("string"), F.lpad(F.col(f"{c}.node").cast("string"), 20, "0"))
    found = connected_components(links.select(text("a").alias("a"), text("b").alias("b")))
    rows = found.select(F.split_part("node", F.lit("\u0001"), F.lit(1)).alias("group"), F.split_part("node", F.lit("\u0001"), F.lit(2)).cast("bigint").alias("node"), F.split_part("component", F.lit("\u0001"), F.lit(2)).cast("bigint").alias("community"))
    sizes = rows.groupBy("group", "community").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes.where(F.col("size") >= least_size), ["group", "community"]).select("group", "node", "community")


def _adjacency(rows) -> dict:
    near: dict = {}
    for a, b, w in rows:
        if a != b:
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
    return near


def louvain(rows, resolution: float = 1.0) -> dict:
    """community (its smallest node) of each node of weighted links (a, b, weight): local moves by modularity, then the same on the merged graph."""
    near = _adjacency(rows)
    of = {n: n for n in near}
    graph = {n: dict(p) for n, p in near.items()}
    loops = dict.fromkeys(graph, 0.0)
    total = sum(sum(p.values()) for p in graph.values())
    while total > 0:
        degree = {n: sum(p.values()) + loops[n] for n, p in graph.items()}
        place = {n: n for n in graph}
        weight = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for n in sorted(graph):
                here = place[n]
                links: dict = {}
                for m, w in graph[n].items():
                    links[place[m]] = links.get(place[m], 0.0) + w
                weight[here] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - resolution * weight[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({here, *links}), key=lambda c: (round(gain(c), 12), c == here))  # noqa: B023
                weight[best] += degree[n]
                if best != here:
                    place[n], moved, moved_any = best, True, True
        if not moved_any:
            break
        of = {n: place[c] for n, c in of.items()}
        merged: dict = {c: {} for c in set(place.values())}
        fresh = dict.fromkeys(merged, 0.0)
        for n, p in graph.items():
            fresh[place[n]] += loops[n]
            for m, w in p.items():
                if place[n] == place[m]:
                    fresh[place[n]] += w
                else:
                    merged[place[n]][place[m]] = merged[place[n]].get(place[m], 0.0) + w
        graph, loops = merged, fresh
    least: dict = {}
    for n, c in of.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in of.items()}


def maximal_cliques(rows, least_size: int = 2) -> list[list]:
    """All maximal cliques of at least ``least_size`` nodes, each sorted, in order."""
    near = {n: set(p) for n, p in _adjacency(rows).items()}
    out: list[list] = []
    stack = [(set(), set(near), set())]
    while stack:
        clique, open_, shut = stack.pop()
        if not open_:
            if not shut and len(clique) >= least_size:
                out.append(sorted(clique))
            continue
        pivot = max(open_ | shut, key=lambda n: len(near[n] & open_))
        for n in sorted(open_ - near[pivot]):
            stack.append((clique | {n}, open_ & near[n], shut & near[n]))
            open_ = open_ - {n}
            shut = shut | {n}
    return sorted(out)


def merged_overlaps(groups: list[list], least: float = 0.5) -> list[list]:
    """Groups from the largest, each joined to the first merged one it shares ``least`` with (common over all), else kept apart."""
    merged: list[set] = []
    for group in sorted((set(g) for g in groups), key=lambda g: (-len(g), sorted(g))):
        into = next((m for m in merged if len(m & group) >= least * len(m | group)), None)
        if into is None:
            merged.append(set(group))
        else:
            into |= group
    return [sorted(m) for m in merged]


def communities(edges: DataFrame, members: DataFrame, method: str = "louvain", resolution: float = 1.0, least_size: int = 2, least_weight: float = 0.6, most: int | None = None) -> DataFrame:
    """group, community and node: each group's communities, by ``louvain``, ``cliques`` (merged where they overlap by half) or ``components``.

    The first two hold a group's edges in one task, for cliques those of ``least_weight``, however many there are. Only
    where ``most`` is given, groups of more edges go by components instead.
    """
    if method == "components":
        return communities_by_components(edges, members, least_weight, least_size).select("group", "community", "node")
    inside = cut(inner_edges(edges, members).select(F.col("group").cast("string").alias("group"), "source", "target", F.col("weight").cast("double").alias("weight")))
    if method == "cliques":
        inside = inside.where(F.col("weight") >= least_weight)

    def run(frame):
        import pandas as pd

        rows = list(zip(frame["source"].tolist(), frame["target"].tolist(), frame["weight"].tolist()))
        if method == "louvain":
            found: dict = {}
            for n, c in louvain(rows, resolution).items():
                found.setdefault(c, []).append(n)
            groups = list(found.values())
        else:
            groups = merged_overlaps(maximal_cliques([r for r in rows if r[2] >= least_weight], least_size))
        out = [(frame["group"].iloc[0], min(g), n) for g in groups if len(g) >= least_size for n in g]
        return pd.DataFrame(out, columns=["group", "community", "node"])

    made = "group string, community bigint, node bigint"
    if most is None:
        return inside.groupBy("group").applyInPandas(run, made)
    large = inside.groupBy("group").count().where(F.col("count") > most).select("group")
    found = inside.join(large, "group", "left_anti").groupBy("group").applyInPandas(run, made)
    rest = members.withColumn("group", F.col("group").cast("string")).join(large, "group", "left_semi")
    return found if large.isEmpty() else found.unionByName(communities_by_components(edges, rest, least_weight if method == "cliques" else 0.0, least_size).select("group", "community", "node"))


def refined_clusters(nodes: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """node, cluster_before and cluster after nodes moved, one after the other, to the cluster most of their edges lead to.

    ``nodes`` has pos (their order), node and cluster. A node moves if strictly more edges lead there than to its own cluster; of equal ones the
    first in the order of edges counts; passes go on until none moves. Every move adds an edge within clusters, so it
    ends. Moves depend on those before; components don't meet, so each is a task of its own, of at most ``most`` edges.
    """
    linked = connected_components(edges, "source", "target")
    sized = edges.join(linked.select(F.col("node").alias("source"), "component"), "source")
    if not sized.groupBy("component").count().where(F.col("count") > most).isEmpty():
        raise ValueError(f"a connected part has more than {most} edges")
    held = nodes.join(linked, "node", "left").select(F.coalesce("component", "node").alias("component"), F.lit(0).alias("kind"), "pos", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("cluster").cast("string").alias("cluster"))
    links = sized.select("component", F.lit(1).alias("kind"), F.col("pos").cast("bigint").alias("pos"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("string").alias("cluster"))

    def run(frame):
        import pandas as pd

        frame = frame.sort_values(["kind", "pos", "a"])
        members, pairs = frame[frame["kind"] == 0], frame[frame["kind"] == 1]
        start = dict(zip(members["a"].tolist(), members["cluster"].tolist()))
        now = dict(start)
        near: dict = {}
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            near.setdefault(int(a), []).append(int(b))
            if a != b:
                near.setdefault(int(b), []).append(int(a))
        moved = True
        while moved:
            moved = False
            for node in now:
                counts: dict = {}
                for peer in near.get(node, ()):
                    if peer in now:
                        counts[now[peer]] = counts.get(now[peer], 0) + 1
                if counts:
                    best = max(counts, key=counts.get)
                    if best != now[node] and counts[best] > counts.get(now[node], 0):
                        now[node], moved = best, True
        return pd.DataFrame({"node": list(start), "cluster_before": list(start.values()), "cluster": [now[n] for n in start]})

    return held.unionByName(links).groupBy("component").applyInPandas(run, "node bigint, cluster_before string, cluster string")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int | None = None) -> DataFrame:
    """seed, node and distance of all nodes within ``hops`` undirected steps, without the seed; the first ``limit`` by distance and node.

    ``seeds`` has seed. Each hop joins the new frontier with the edges; a node counts at its shortest distance.
    """
    links = cut(both_ways(edges.select("source", "target")).select("node", "peer").distinct())
    reached = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct())
    front = reached
    for hop in range(1, hops + 1):
        step = front.join(links, "node").select("seed", F.col("peer").alias("node")).distinct()
        front = cut(step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(hop)))
        reached = reached.unionByName(front)
    out = reached.where("distance > 0")
    if limit is not None:
        out = out.withColumn("_at", F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))).where(F.col("_at") <= limit).drop("_at")
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame, most_hops: int = 5) -> DataFrame:
    """start, goal, length and path of a shortest undirected path of at most ``most_hops``; the first by node order of equal ones.

    ``pairs`` has start and goal. Every node reached keeps one path, so a frontier never exceeds the nodes for each start.
    """
    links = cut(both_ways(edges.select("source", "target")).select("node", "peer").distinct())
    starts = pairs.select("start").distinct()
    reached = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    front = reached
    for _ in range(most_hops):
        step = front.join(links, "node").groupBy("start", F.col("peer").alias("node")).agg(F.min("path").alias("before"))
        front = cut(step.join(reached.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.concat("before", F.array("node")).alias("path")))
        reached = reached.unionByName(front)
    return pairs.join(reached.withColumnRenamed("node", "goal"), ["start", "goal"]).select("start", "goal", (F.size("path") - 1).alias("length"), "path")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes one step around ``seeds`` (seed) with the seeds themselves, and all edges between them."""
    kept = neighbours(edges, seeds).select("node").unionByName(seeds.select(F.col("seed").alias("node"))).distinct()
    inside = edges.join(kept.select(F.col("node").alias("source")), "source", "left_semi").join(kept.select(F.col("node").alias("target")), "target", "left_semi")
    return nodes.join(kept, "node", "left_semi"), inside


def merged_centroids(centroids: DataFrame, key: str, vector: str, most_distance: float = 0.15) -> DataFrame:
    """key and merged (the smallest key of its group) for vectors that cosine distances below ``most_distance`` join. Keys are bigint."""
    from kgloom.operators.similarity import similar_pairs

    close = similar_pairs(centroids, key, vector, 1 - most_distance).where(F.col("similarity") > 1 - most_distance)
    found = connected_components(close, "source", "target")
    return centroids.select(F.col(key).alias("key")).join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", F.coalesce("component", "key").alias("merged"))


