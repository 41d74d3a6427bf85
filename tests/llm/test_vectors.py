import numpy as np
import pytest

from kgloom.llm.mixture import Mixture, close_links, clusters, groups, started, typical
from kgloom.llm.neighbours import forest_pairs, leaves, nearest, trees_for


def frame(spark, values, ids=None):
    rows = [(ids[i] if ids else f"v{i:04}", np.asarray(v, "<f4").tobytes(), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, vec binary, rank int")


def cloud(rng, centres=40, each=12, noise=400, dim=8, spread=0.12):
    middle = rng.standard_normal((centres, dim))
    near = np.repeat(middle, each, axis=0) + spread * rng.standard_normal((centres * each, dim)) * np.linalg.norm(middle, axis=1).mean() / np.sqrt(dim)
    return np.concatenate([near, rng.standard_normal((noise, dim)), near[:5], near[:3] * 2, near[3:4] * 4]).astype("<f4")


def cosines(values):
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1)[:, None]
    return np.round(unit @ unit.T, 12)


def test_nearest_finds_nearly_all(spark):
    values = cloud(np.random.default_rng(3))
    cos = cosines(values)
    want = set()
    for i in range(len(values)):
        order = sorted((j for j in range(len(values)) if j != i and cos[i, j] >= 0.85), key=lambda j: (-cos[i, j], j))
        want |= {(f"v{i:04}", f"v{j:04}") for j in order[:5]}
    got = {(r.id, r.near_id) for r in nearest(frame(spark, values), 5, dim=8, leaf=64).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_many_equal_vectors(spark):
    values = [[1.0, 0.5]] * 60 + [[2.0, 1.0]] * 20 + [[0.0, 1.0]]
    got = nearest(frame(spark, values), 3, dim=2, leaf=8).collect()
    assert {(r.id, r.near_id) for r in got} == {(f"v{i:04}", f"v{j:04}") for i in range(80) for j in [x for x in range(4) if x != i][:3]}
    members = groups(frame(spark, values), views=2, leaf=8, dim=2).collect()
    assert len(members) == 80 and {r.group_id for r in members} == {"v0000"}


def test_a_dense_cloud_of_different_vectors(spark):
    rng = np.random.default_rng(4)
    values = (np.ones((600, 8)) + 0.05 * rng.standard_normal((600, 8))).astype("<f4")
    cos = cosines(values)
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(600) for j in np.argsort(-cos[i], kind="stable")[:5]}
    got = {(int(r.id[1:]), int(r.near_id[1:])) for r in nearest(frame(spark, values), 5, dim=8).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)
    assert len(groups(frame(spark, values), dim=8, leaf=128, held=300, views=2).collect()) == 600


@pytest.mark.parametrize("held", [1000, 64])
def test_vectors_that_agree_in_all_bits_are_all_compared(spark, held):
    rng = np.random.default_rng(5)
    entries = frame(spark, rng.uniform(1, 1.9, 120)[:, None] * rng.standard_normal(8)).selectExpr("cast(rank as bigint) as no", "vec")
    pairs = {(r.a, r.b) for r in forest_pairs(entries, 0.85, 3, 2, 8, leaf=16, held=held).collect()}
    assert pairs >= {(min(i, j), max(i, j)) for i in range(120) for j in [x for x in range(4) if x != i][:3]}


@pytest.mark.parametrize("inside", [0.9, 0.97, 0.999])
def test_nearest_finds_nearly_all_in_a_dense_third(spark, inside):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal(64)
    values = np.concatenate([middle + np.sqrt(1 / inside - 1) * rng.standard_normal((1000, 64)), rng.standard_normal((2000, 64))]).astype("<f4")
    cos = cosines(values)
    np.fill_diagonal(cos, -2)
    want = {(i, j) for i in range(1000) for j in np.lexsort((np.arange(3000), -cos[i]))[:10].tolist() if cos[i, j] >= 0.85}
    got = {(int(r.id[1:]), int(r.near_id[1:])) for r in nearest(frame(spark, values), leaf=64).collect()}
    assert len(got & want) >= 0.997 * len(want)


def test_partitions_cut_no_string_of_bits(spark):
    values = np.random.default_rng(7).standard_normal((400, 8))
    entries = frame(spark, values).selectExpr("cast(rank as bigint) as no", "vec")
    sides = values.astype("<f4") @ np.random.default_rng(17).standard_normal((8, 3)).astype("f4") > 0
    same, close = (sides[:, None] == sides[None]).all(axis=2), cosines(values.astype("<f4")) >= 0.85
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if same[i, j] and close[i, j]}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {(r.a, r.b) for r in forest_pairs(entries, 0.85, 400, 1, 8, leaf=16, bits=3).collect()} >= want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    df = frame(spark, [[1.0, 2.0]])
    assert nearest(df.limit(0), dim=2).collect() == [] and groups(df.limit(0), dim=2).collect() == [] and clusters(df.limit(0), dim=2).collect() == []
    assert nearest(df, dim=2).collect() == [] and groups(df, dim=2).collect() == [] and len(clusters(df, dim=2).collect()) == 1


def test_prefix_tree_leaves():
    codes = np.sort(np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    found = sorted(leaves(codes, 0, 500, 40))
    assert found[0][0] == 0 and found[-1][1] == 500 and all(a[1] == b[0] for a, b in zip(found, found[1:])) and max(b - a for a, b in found) <= 40
    same = sorted(leaves(np.zeros(100, np.uint64), 0, 100, 40))
    assert same[0][0] == 0 and same[-1][1] == 100 and all(b[0] < a[1] for a, b in zip(same, same[1:]))
    assert trees_for(100, 0.85, 0.99) == 1 and trees_for(10**7, 0.85, 0.99) > trees_for(10**6, 0.85, 0.99)


@pytest.mark.parametrize("leaf", [32, 4096])
def test_groups_match_brute_force(spark, leaf):
    values = cloud(np.random.default_rng(8), spread=0.05)
    close, n = cosines(values) >= 0.85, len(values)
    label = np.arange(n)
    for _ in range(n):
        fresh = np.array([label[close[i]].min() for i in range(n)])
        if (fresh == label).all():
            break
        label = fresh
    size = np.bincount(label, minlength=n)
    want = {(f"v{label[i]:04}", f"v{i:04}") for i in range(n) if size[label[i]] >= 3}
    got = {(r.group_id, r.id) for r in groups(frame(spark, values), leaf=leaf, held=4 * leaf, dim=8).collect()}
    assert got == want if leaf == 4096 else len(got & want) >= 0.9 * len(want)


def test_leaves_that_are_too_large_lose_no_link(spark):
    values = cloud(np.random.default_rng(9), centres=10, each=20, noise=50, spread=0.05)
    rows = spark.createDataFrame([(0, ".1", i, v.tobytes()) for i, v in enumerate(values)], "view int, leaf string, no long, vec binary")
    close, n = cosines(values) >= 0.85, len(values)

    def parts(pairs):
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(x) for x in range(n)]

    got = [(r.a, r.b) for r in close_links(rows, 0.85, held=32, dim=8).collect()]
    assert parts(got) == parts([(i, j) for i in range(n) for j in range(i) if close[i, j]])


def test_mixture_recovers_separate_clouds(spark):
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.standard_normal((300, 3)) + c for c in ([0, 0, 9], [9, 0, 0], [0, 9, 0], [-9, 0, 0])])
    best = started(z, 4, 2).log_parts(z).argmax(axis=1)
    assert all(len(set(best[i : i + 300])) == 1 for i in range(0, 1200, 300)) and len(set(best)) == 4
    far = np.eye(4)[rng.integers(0, 4, 600)] * 5 + 0.3 * rng.standard_normal((600, 4))
    rows = clusters(frame(spark, far), choices=(1, 4, 8), dim=4).collect()
    assert len(rows) == 600 and len({r.cluster for r in rows}) >= 4
    assert isinstance(started(np.zeros((5, 2)), 3, 1), Mixture)


def test_clusters_are_as_many_as_the_rows_ask_for(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((100, 6))
    values = np.repeat(middle / np.linalg.norm(middle, axis=1)[:, None], 40, axis=0) + 0.01 * rng.standard_normal((4000, 6))
    rows = clusters(frame(spark, values), dim=6).collect()
    assert len(rows) == 4000 and len({r.cluster for r in rows}) > 60


def test_typical_members_are_nearest_to_the_mean(spark):
    df = frame(spark, [[1, 0], [1, 1], [2, 1], [0, 3], [1, 4]])
    members = spark.createDataFrame([("a", "v0000"), ("a", "v0001"), ("a", "v0002"), ("b", "v0003"), ("b", "v0004")], "group_id string, id string")
    got = {r.id: r.density for r in typical(members, df, 2).collect()}
    assert len(got) == 5 and max("v0000 v0001 v0002".split(), key=got.get) == "v0002" and got["v0003"] == got["v0004"]


def test_ascent_in_step_finds_nearly_all_without_comparing_all():
    from kgloom.llm import neighbours as N

    rng = np.random.default_rng(11)
    middle = rng.standard_normal((150, 64))
    values = np.concatenate([np.repeat(middle, 20, axis=0) + 0.35 * rng.standard_normal((3000, 64)), rng.standard_normal((3000, 64))]).astype("<f4")
    cos = cosines(values)
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(values)) for j in np.argsort(-cos[i], kind="stable")[:5] if cos[i, j] >= 0.85}
    i, j, c = N.ascended(values, np.arange(len(values)), 5, 0.85)
    assert len(want) > 5000 and len(set(zip(i.tolist(), j.tolist())) & want) >= 0.98 * len(want) and np.allclose(cos[i, j], c)
    some = np.arange(0, len(values), 7)
    assert set(N.ascended(values, some, 5, 0.85)[0].tolist()) <= set(some.tolist())
    i, j, _ = N.ascended(values, np.arange(len(values)), 5, -1.0, budget=20_000)  # the whole stem
    assert set(zip(i.tolist(), j.tolist())) == {(a, int(b)) for a in range(len(values)) for b in np.argsort(-cos[a], kind="stable")[:5]}


def test_every_vector_has_its_nearest_beyond_the_threshold(spark):
    values = np.random.default_rng(12).standard_normal((300, 16)).astype("<f4")
    cos = cosines(values)
    np.fill_diagonal(cos, -2)
    got = sorted((int(r.id[1:]), r.rank, int(r.near_id[1:])) for r in nearest(frame(spark, values), 4, dim=16, beyond=True).collect())
    assert got == [(i, n + 1, int(j)) for i in range(300) for n, j in enumerate(np.lexsort((np.arange(300), -cos[i]))[:4])]


def test_small_tables_are_divided_and_every_row_is_indexed(spark):
    from kgloom.llm.mixture import SPILL, index

    values = cloud(np.random.default_rng(13), spread=0.05)
    entries = frame(spark, values).selectExpr("cast(rank as bigint) as no", "vec")
    rows, sizes = index(entries, dim=8)
    got = rows.select("view", "leaf", "no").collect()
    assert len(got) == 2 * SPILL * len(values) == len({tuple(r) for r in got}) and max(r["count"] for r in sizes.collect()) < 0.8 * len(values)
    rows, sizes = index(entries, leaf=64, held=128, dim=8)
    assert max(r["count"] for r in sizes.collect()) <= 128 and {r.no for r in rows.where("view = 1").select("no").collect()} == set(range(len(values)))


def test_a_dense_group_is_linked_through_a_pivot():
    from kgloom.llm.mixture import linked

    rng = np.random.default_rng(14)
    values = np.concatenate([np.ones((1500, 8)) + 0.1 * rng.standard_normal((1500, 8)), cloud(rng, centres=5, noise=60)]).astype("<f4")
    close = cosines(values) >= 0.85
    want = np.arange(len(values))
    for _ in range(len(values)):
        fresh = np.array([want[row].min() for row in close])
        if (fresh == want).all():
            break
        want = fresh
    a, b = linked(values, 0.85)
    got = np.arange(len(values))
    got[b] = a
    assert (got == want).all()
