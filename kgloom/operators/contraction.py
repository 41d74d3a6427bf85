"""Forests of unknown depth: tree contraction by raking leaves and compressing unary chains.

Each round takes out all leaves (rake) and an independent set of nodes with one remaining child (compress: those whose
hash is below that of their parent and of that child), and records what it took out with its parent at that time. The
live table shrinks by a constant factor a round, so all rounds together cost about as much as the first. What never
becomes a leaf is a ring; compression shortens it to a node that is its own parent, and the edge carries the smallest
id on the way. A live core of at most ``core_rows`` rows is solved in one task, after which the recorded rounds are
undone in reverse order, each by one join.

No chain, subtree or ring is ever collected into one task beyond ``core_rows``. Joins are merge joins, so that no side
that grows with the input is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.ranking import running_sum
from kgloom.session import cut

#: Live rows below which the rest is solved in one task.
CORE_ROWS = 20_000


def contract_forest(
    df: DataFrame, node: str = "node", parent: str = "parent", mark: str | None = None, with_path: bool = False, core_rows: int = CORE_ROWS, weight: str | None = None
) -> DataFrame:
    """Root, depth and what lies beneath, for every node of a table of parent links.

    ``node`` must be unique and not null, of the type of ``parent``. Rows whose parent is null or not in the table are roots of depth 0. A node on
    a ring or beneath one has depth -1, as root the smallest node of that ring, and no path; on the ring itself below
    and marked are null. Returns node, root, depth, below (number of descendants), marked (descendants for which the boolean
    ``mark`` holds; 0 without it), and with ``with_path`` path, the nodes from the root to the node itself.
    With ``weight``, a column of numbers, depth is the sum of the weights on the way up instead of their count; a root's
    own does not count. Other columns of ``df`` are ignored; an empty table gives an empty table.
    """
    own = F.coalesce(F.col(mark).cast("boolean"), F.lit(False)).cast("long") if mark else F.lit(0).cast("long")
    far = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    given = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"), own.alias("own"), far.alias("w"))
    known = given.select(F.col("node").alias("known"))
    live = cut(
        given.join(known.hint("merge"), F.col("parent") == F.col("known"), "left").select(
            "node", F.col("known").alias("parent"), F.lit(None).cast(given.schema["node"].dataType).alias("ring"), "w",
            F.col("node").alias("lo"), "own", *[F.lit(0).cast("long").alias(c) for c in ("s", "f", "cs", "cf")],
            *([F.expr("slice(array(node), 1, 0)").alias("via")] if with_path else []),
        ).transform(_rings)
    )
    rounds: list[DataFrame] = []
    while live.count() > core_rows:
        gone, live = _round(live, len(rounds), with_path)
        rounds.append(gone)
    done = _solve_core(live, with_path)
    for gone in reversed(rounds):
        done = _undo(gone, cut(done), with_path)
    return done


def interval_labels(df: DataFrame, node: str = "node", parent: str = "parent", core_rows: int = CORE_ROWS) -> DataFrame:
    """node, root, depth, pre and last: the place of each node in a walk of its tree, children by id, and that of the last node beneath it.

    A node lies beneath another exactly if both have one root and its ``pre`` is above the other's and at most its
    ``last``, so all descendants take two numbers a node, however deep the trees are. On rings and beneath them, where
    depth is -1, both are null. ``node`` must be unique and not null; an empty table gives an empty table.

    A node's ``pre`` is its parent's plus one plus the nodes beneath and including its smaller siblings: sums over
    siblings by range, then over the way up by the contraction that also gives depths.
    """
    done = cut(contract_forest(df, node, parent, core_rows=core_rows))
    given = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    whole = cut(done.join(given.hint("merge"), "node"))
    beside = running_sum(whole.where("depth > 0").select("node", "parent", "below"), ["parent"], ["node"], F.col("below") + 1, "before")
    weighted = whole.select("node", "parent").join(beside.select("node", (F.col("before") + 1).alias("step")).hint("merge"), "node", "left")
    placed = contract_forest(cut(weighted), "node", "parent", core_rows=core_rows, weight="step").select("node", F.when(F.col("depth") >= 0, F.col("depth")).alias("pre"))
    return whole.join(placed.hint("merge"), "node").select("node", "root", "depth", "pre", (F.col("pre") + F.col("below")).alias("last"))


def _rings(df: DataFrame) -> DataFrame:
    """A node that is its own parent ends a ring and stands as its root from then on."""
    own = F.col("parent") == F.col("node")
    return df.withColumns({"ring": F.when(own, F.col("lo")).otherwise(F.col("ring")), "parent": F.when(own, F.lit(None)).otherwise(F.col("parent"))})


def _rank(column: str, step: int) -> Column:
    """A total order over nodes that differs from round to round."""
    return F.struct(F.xxhash64(F.col(column), F.lit(step)), F.col(column))


def _round(live: DataFrame, step: int, with_path: bool) -> tuple[DataFrame, DataFrame]:
    extra = ["via"] if with_path else []
    counts = live.where("parent is not null").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("k"))
    leaf = live.join(counts.hint("merge"), F.col("node") == F.col("p"), "left").withColumn("leaf", F.col("k").isNull()).drop("p", "k")
    gained = (
        leaf.where("parent is not null").groupBy(F.col("parent").alias("p"))
        .agg(
            F.sum(F.expr("if(leaf, s + 1 + cs, 0)")).alias("ds"), F.sum(F.expr("if(leaf, f + own + cf, 0)")).alias("df"), F.sum(F.expr("if(leaf, 0L, 1L)")).alias("rest"),
            F.max(F.expr("if(leaf, null, struct(node, own, cs, cf))")).alias("child"),
        )
    )
    lone = (F.col("rest") == 1) & F.col("parent").isNotNull()
    low = (_rank("node", step) < _rank("parent", step)) & (_rank("node", step) < _rank("child.node", step))
    marked = cut(
        leaf.join(gained.hint("merge"), F.col("node") == F.col("p"), "left").drop("p")
        .withColumns({"s": F.col("s") + F.coalesce("ds", F.lit(0)), "f": F.col("f") + F.coalesce("df", F.lit(0))})
        .withColumn("state", F.expr("case when leaf and parent is null then 'root' when leaf then 'raked' end"))
        .withColumn("state", F.when(F.col("state").isNull() & lone & low, F.lit("spliced")).otherwise(F.coalesce("state", F.lit("live"))))
        .drop("ds", "df", "rest", "leaf")
    )
    spliced = marked.where("state = 'spliced'").select(*[F.col(c).alias(f"v_{c}") for c in ("node", "parent", "w", "lo", "own", "s", "f", "cs", "cf", *extra)])
    met = F.col("v_node").isNotNull()
    moved = marked.where("state = 'live'").join(spliced.hint("merge"), F.col("parent") == F.col("v_node"), "left").withColumns(
        {
            "parent": F.when(met, F.col("v_parent")).otherwise(F.col("parent")), "w": F.col("w") + F.coalesce("v_w", F.lit(0)), "lo": F.least("lo", "v_lo"),
            "cs": F.col("cs") + F.coalesce(F.expr("v_cs + 1 + v_s"), F.lit(0)), "cf": F.col("cf") + F.coalesce(F.expr("v_cf + v_own + v_f"), F.lit(0)),
        }
        | ({"via": F.when(met, F.expr("concat(v_via, array(v_node), via)")).otherwise(F.col("via"))} if with_path else {})
    )
    return marked.where("state <> 'live'"), cut(_rings(moved.select(*live.columns)))


def _undo(gone: DataFrame, done: DataFrame, with_path: bool) -> DataFrame:
    """Adds the nodes that one round took out. Chains go first: leaves of the same round may hang below them."""
    path = ["path"] if with_path else []

    def hang(df: DataFrame, onto: DataFrame, below: str, marked: str) -> DataFrame:
        above = onto.select(*[F.col(c).alias(f"a_{c}") for c in ("node", "root", "depth", *path)])
        return df.join(above.hint("merge"), F.col("parent") == F.col("a_node")).select(
            "node", F.col("a_root").alias("root"), F.expr("if(a_depth < 0, -1L, a_depth + w)").alias("depth"), F.expr(below).alias("below"), F.expr(marked).alias("marked"),
            *([F.expr("concat(a_path, via, array(node))").alias("path")] if path else []),
        )

    roots = gone.where("state = 'root'").select(
        "node", F.coalesce("ring", "node").alias("root"), F.expr("if(ring is null, 0L, -1L)").alias("depth"), F.expr("if(ring is null, s, null)").alias("below"), F.expr("if(ring is null, f, null)").alias("marked"),
        *([F.expr("if(ring is null, array(node), null)").alias("path")] if path else []),
    )
    beneath = done.select(*[F.col(c).alias(f"b_{c}") for c in ("node", "below", "marked")])
    spliced = gone.where("state = 'spliced'").join(beneath.hint("merge"), F.col("child.node") == F.col("b_node"))
    done = cut(done.unionByName(roots).unionByName(hang(spliced, done, "s + child.cs + 1 + b_below", "f + child.cf + child.own + b_marked")))
    return done.unionByName(hang(gone.where("state = 'raked'"), done, "s", "f"))


def _solve_core(live: DataFrame, with_path: bool) -> DataFrame:
    """The live core, of at most ``core_rows`` rows, in one task."""
    kind = live.schema["node"].dataType.simpleString()
    schema = f"node {kind}, root {kind}, depth bigint, below bigint, marked bigint" + (f", path array<{kind}>" if with_path else "")
    fields = ["node", "parent", "ring", "w", "lo", "own", "s", "f", "cs", "cf", *(["via"] if with_path else [])]

    def solve(batches):
        import pandas as pd

        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = {r[0]: r for r in pd.concat(frames)[fields].itertuples(index=False, name=None)}
        out: dict = {}  # node: root, depth, path
        order: list = []  # parents before children
        on_ring: dict = {}  # node: smallest node of its ring
        for start in rows:
            walk, here = [], start
            while here not in out:
                _, parent, ring, *_ = rows[here]
                if parent is None or pd.isna(parent):
                    top = here if ring is None or pd.isna(ring) else ring
                    free = top is here and (ring is None or pd.isna(ring))
                    out[here] = (top, 0 if free else -1, [here] if with_path and free else None)
                    if not free:
                        on_ring[here] = top
                    order.append(here)
                    break
                if here in on_ring:
                    break
                on_ring[here] = None  # being walked
                walk.append(here)
                here = parent
            if here not in out:  # the walk met itself
                ring = walk[walk.index(here):]
                low = min(rows[x][4] for x in ring)
                for x in ring:
                    out[x] = (low, -1, None)
                    on_ring[x] = low
                    order.append(x)
                walk = walk[: -len(ring)]
            for x in walk:
                on_ring.pop(x, None)
            for x in reversed(walk):
                root, depth, path = out[rows[x][1]]
                via = list(rows[x][10]) if with_path and depth >= 0 else []
                out[x] = (root, -1 if depth < 0 else depth + rows[x][3], path + via + [x] if with_path and depth >= 0 else None)
                order.append(x)
        below = {x: [r[6], r[7]] for x, r in rows.items()}
        for x in reversed(order):
            r = rows[x]
            if x not in on_ring and r[1] is not None and not pd.isna(r[1]):
                below[r[1]][0] += below[x][0] + 1 + r[8]
                below[r[1]][1] += below[x][1] + r[5] + r[9]
        made = [(x, out[x][0], out[x][1], *((None, None) if x in on_ring else below[x]), *((out[x][2],) if with_path else ())) for x in order]
        frame = pd.DataFrame(made, columns=["node", "root", "depth", "below", "marked", *(["path"] if with_path else [])])
        yield frame.astype({"below": "Int64", "marked": "Int64"})

    return live.coalesce(1).mapInPandas(solve, schema)
