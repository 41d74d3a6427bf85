"""Connected components of graphs of any size and diameter.

Each round points every node at the neighbour (or itself) that comes first in that round's random order, merges it into
that neighbour, and keeps the links between what is left; a constant share of the nodes goes each time, also on long
chains. What is left is solved in one task once it has at most ``core_links`` links, and the recorded merges are undone
in reverse order, each by one join. A hot node only ever meets partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut

#: Links below which the rest is solved in one task.
CORE_LINKS = 50_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", core_links: int = CORE_LINKS) -> DataFrame:
    """node and component (the smallest node of its component) of every node that has a link.

    Links have no direction and may repeat; a link of a node to itself only names the node; rows with a null end are
    left out. An empty table gives an empty table.
    """
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node"))
    live = cut(clean.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    merges: list[DataFrame] = []
    while live.count() > core_links:
        step = len(merges)
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("to"))
        first = ends.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["to"].alias("to"))
        moved = cut(first)
        merges.append(moved)
        left = live.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        live = cut(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    done = _solve(live)
    for moved in reversed(merges):
        known = done.select(F.col("node").alias("to"), F.col("component"))
        done = cut(moved.join(known, "to", "left").select("node", F.coalesce("component", "to").alias("component")))
    lone = nodes.distinct().join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    least = lone.groupBy("component").agg(F.min("node").alias("least"))
    return lone.join(least, "component").select("node", F.col("least").alias("component"))


def _solve(live: DataFrame) -> DataFrame:
    kind = live.schema["a"].dataType.simpleString()

    def solve(batches):
        import pandas as pd

        up: dict = {}

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for x, y in zip(batch["a"], batch["b"]):
                up.setdefault(x, x), up.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            yield pd.DataFrame({"node": list(up), "component": [find(x) for x in up]})

    return live.coalesce(1).mapInPandas(solve, f"node {kind}, component {kind}")
