import random

import pytest

from kgloom.operators.contraction import contract_forest, interval_labels


def brute(links, marks=()):
    parents = {n: p if p in dict(links) else None for n, p in links}
    up = {}
    for n in parents:
        path, x = [n], n
        while (p := parents[x]) is not None and p not in path:
            path.append(p)
            x = p
        if p is None:
            up[n] = (x, len(path) - 1, path[::-1], False)
        else:
            ring = path[path.index(p):]
            up[n] = (min(ring), -1, None, n in ring)
    out = {}
    for n, (root, depth, path, on_ring) in up.items():
        below = [m for m in parents if m != n and n in climb(parents, m)]
        out[n] = (root, depth, None if on_ring else len(below), None if on_ring else sum(m in marks for m in below), path)
    return out


def climb(parents, n):
    seen, x = [], parents[n]
    while x is not None and x not in seen:
        seen.append(x)
        x = parents[x]
    return seen


def run(spark, links, marks=(), core=4):
    df = spark.createDataFrame([(n, p, n in marks, "x") for n, p in links], "id string, parent_id string, hit boolean, root string")
    rows = contract_forest(df, "id", "parent_id", "hit", with_path=True, core_rows=core).collect()
    return {r.node: (r.root, r.depth, r.below, r.marked, r.path) for r in rows}


@pytest.mark.parametrize("core", [0, 5, 1000])
def test_random_forest_with_rings_matches_brute_force(spark, core):
    rng = random.Random(7)
    links = [(f"t{i:02}", None if i == 0 else f"t{rng.randrange(max(0, i - 3), i):02}") for i in range(25)]
    links += [(f"c{i:02}", f"c{i - 1:02}" if i else "missing") for i in range(20)]
    links += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "s"), ("h1", "r2"), ("h2", "h1"), ("h3", "h2"), ("h4", "s")]
    links += [(f"q{i}", f"q{(i + 1) % 9}") for i in range(9)] + [(f"f{i}", "t05") for i in range(12)]
    rng.shuffle(links)
    marks = {n for n, _ in links if rng.random() < 0.4}
    assert run(spark, links, marks, core) == brute(links, marks)


def test_leaves_of_a_chain_that_is_compressed_in_the_same_round(spark):
    links = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(60)] + [(f"x{i:03}", f"n{i:03}") for i in range(60)]
    assert run(spark, links, {f"x{i:03}" for i in range(0, 60, 3)}, core=2) == brute(links, {f"x{i:03}" for i in range(0, 60, 3)})


def test_empty(spark):
    assert run(spark, []) == {}


def test_pages_beneath_a_ring_have_paths_and_descendants(spark, tmp_path):
    from kgloom.queries.nested import QUERIES

    links = [("r1", "r2"), ("r2", "r1"), ("s", "s"), ("a", "r1"), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "s"), ("top", None), ("low", "top")]
    spark.createDataFrame([(n, p, 1) for n, p in links], "id string, parent_id string, loaded_at int").write.parquet(str(tmp_path / "page_tree.parquet"))
    paths = {tuple(r) for r in QUERIES["p6_hung_paths"](spark, str(tmp_path)).select("page_id", "path", "pages_below").collect()}
    assert paths == {("a", "a", 3), ("b", "a/b", 1), ("c", "a/b/c", 0), ("d", "a/d", 0), ("e", "e", 0)}
    below = {tuple(r) for n in ("p6_descendants", "p6_hung_descendants") for r in QUERIES[n](spark, str(tmp_path)).select("page_id", "descendant_id", "distance").collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1), ("top", "low", 1)}


@pytest.mark.parametrize("core", [12, 1000])
def test_interval_labels_hold_exactly_the_descendants(spark, core):
    rng = random.Random(9)
    links = [(f"t{i:02}", None if i < 2 else f"t{rng.randrange(max(0, i - 6), i):02}") for i in range(40)] + [(f"f{i}", "t05") for i in range(9)]
    links += [("r1", "r2"), ("r2", "r1"), ("h1", "r2"), ("gone", "nowhere")]
    df = spark.createDataFrame([(n, p, 1) for n, p in links], "id string, parent_id string, pre int")
    rows = {r.node: r for r in interval_labels(df, "id", "parent_id", core).collect()}
    assert set(rows) == {n for n, _ in links} and all(rows[n].pre is None and rows[n].last is None for n in ("r1", "r2", "h1"))
    free = [r for r in rows.values() if r.depth >= 0]
    for a in free:
        inside = {b.node for b in free if b.root == a.root and a.pre < b.pre <= a.last}
        assert inside == {n for n, _ in links if n != a.node and a.node in climb(dict(links) | {n: None for n, p in links if p not in dict(links)}, n)}
    assert interval_labels(df.limit(0), "id", "parent_id").collect() == []


def test_pages_with_a_small_core_match_those_of_one_task(spark):
    import os

    from kgloom.queries.nested import pages

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = pages(spark, folder)
    few, one = ({tuple(r) for r in contract_forest(rows, "page_id", "parent", core_rows=c).collect()} for c in (60, 20_000))
    assert few == one and len(one) > 50
