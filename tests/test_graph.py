import numpy as np
import pytest

from kgloom.operators import graph as G
from kgloom.operators import similarity as S


def edge_frame(spark, rows):
    return spark.createDataFrame([(a, b, float(w), i) for i, (a, b, w) in enumerate(rows)], "source long, target long, weight double, pos long")


def test_refinement_moves_one_after_the_other(spark):
    nodes = spark.createDataFrame([(0, 0, "A"), (1, 1, "A"), (2, 2, "B"), (3, 3, "B"), (4, 4, "C")], "pos long, node long, cluster string")
    got = G.refined_clusters(nodes, edge_frame(spark, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1)])).collect()
    assert {r.node: r.cluster for r in got} == {0: "A", 1: "A", 2: "A", 3: "A", 4: "C"}
    with pytest.raises(ValueError):
        G.refined_clusters(nodes, edge_frame(spark, [(0, 1, 1), (1, 2, 1)]), most=1)


def test_group_figures(spark):
    edges = edge_frame(spark, [(1, 2, 0.9), (2, 3, 0.7), (5, 6, 1.0)])
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 4)], "group string, node long")
    rows = {r.group: r for r in G.group_metrics(edges, members).collect()}
    assert (rows["g"].internal_edges, round(rows["g"].density, 4), round(rows["g"].cohesion, 4)) == (2, 0.6667, 0.8) and rows["h"].density == 0
    assert {r.group: r.representative for r in G.representatives(edges, members).collect()} == {"g": 2, "h": 4}


def test_communities(spark):
    ring = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 0.1)]
    members = spark.createDataFrame([(1, n) for n in range(1, 8)], "group int, node long")
    for method in ("louvain", "cliques"):
        got = {r.node: r.community for r in G.communities(edge_frame(spark, ring), members, method).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert {r.community for r in G.communities(edge_frame(spark, ring), members, "components", least_weight=0.0).collect()} == {1}
    few = {r.node: r.community for r in G.communities(edge_frame(spark, ring), members, "louvain", most=2).collect()}
    assert set(few.values()) == {1}  # too large for a task: by components
    assert G.maximal_cliques([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)], 2) == [[1, 2, 3], [3, 4]] and G.merged_overlaps([[1, 2, 3], [2, 3], [4, 5]]) == [[1, 2, 3], [4, 5]] and G.louvain([]) == {}


def test_large_groups_keep_their_method(spark):
    import inspect

    assert inspect.signature(G.communities).parameters["most"].default is None
    links = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (3, 4, 0.9), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.9), (6, 7, 0.1)]
    members = spark.createDataFrame([(n, 0) for n in range(1, 8)], "node bigint, group int")
    got = {(r.community, r.node) for r in G.communities(edge_frame(spark, links), members, "cliques", least_size=3).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (4, 6)}
    assert 7 not in {r.node for r in G.communities(edge_frame(spark, links), members, "cliques", most=2).collect()}


def test_neighbourhoods_and_paths(spark):
    edges = edge_frame(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 5, 1), (5, 4, 1), (8, 9, 1)])
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert {(r.node, r.distance) for r in G.neighbours(edges, seeds, 2).collect()} == {(2, 1), (5, 1), (3, 2), (4, 2)}
    assert [r.node for r in G.neighbours(edges, seeds, 2, limit=1).collect()] == [2]
    pairs = spark.createDataFrame([(1, 4), (1, 9), (1, 1)], "start long, goal long")
    assert {(r.goal, r.length, tuple(r.path)) for r in G.shortest_paths(edges, pairs).collect()} == {(4, 2, (1, 5, 4)), (1, 0, (1,))}


def test_similarity_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(2)
    values = rng.standard_normal((70, 5))
    values[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, v array<double>")
    size = np.linalg.norm(values, axis=1, keepdims=True)
    unit = np.divide(values, size, out=np.zeros_like(values), where=size > 0)
    cos = unit @ unit.T
    upper = cos[np.triu_indices(70, 1)]
    got = S.similarity_stats(df, "id", "v").first()
    want = (len(upper), upper.max(), upper.min(), upper.mean(), np.quantile(upper, 0.9), np.quantile(upper, 0.75))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert {(r.source, r.target) for r in S.similar_pairs(df, "id", "v", 0.5).collect()} == {(i, j) for i in range(70) for j in range(i + 1, 70) if cos[i, j] >= 0.5}
    assert {(r.source, r.target) for r in S.similar_pairs(df, "id", "v", 0.5, other=df.limit(20)).collect()} == {(i, r.id) for r in df.limit(20).collect() for i in range(70) if cos[i, r.id] >= 0.5}
    assert S.similarity_stats(df.limit(1), "id", "v").first()["count"] == 0


@pytest.mark.parametrize("top, p90, high, medium, adjusted", [(0.95, 0.5, 0.8, 0.6, False), (0.7, 0.3, 0.665, 0.6, True), (0.5, 0.2, 0.475, 0.425, True), (0.5, 0.49, 0.495, 0.49, True), (0.0, 0.0, 0.8, 0.6, False), (None, None, 0.8, 0.6, False)])
def test_thresholds(spark, top, p90, high, medium, adjusted):
    got = S.adaptive_thresholds(spark.createDataFrame([(top, p90)], "max double, p90 double")).first()
    assert (round(got.high, 6), round(got.medium, 6), got.adjusted) == (high, medium, adjusted)


def test_approval_stops_after_the_first_poor_stratum(spark):
    rows = [(0.76, i < 5) for i in range(10)] + [(0.71, False)] * 10 + [(0.66, True)] * 9
    got = S.stratified_approval(spark.createDataFrame(rows, "similarity double, approved boolean")).collect()
    assert len(got) == 5


def test_pooling_and_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 3), ("b", [3.0, 4.0], 0)], "g string, v array<double>, w int")
    assert {r.g: [round(x, 6) for x in r.vector] for r in S.pooled(df, ["g"], "v", "w").collect()} == {"a": [0.25, 0.75], "b": [3.0, 4.0]}
    assert {r.g: [round(x, 6) for x in r.vector] for r in S.pooled(df, ["g"], "v", unit_length=True).collect()}["b"] == [0.6, 0.8]
    centres = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])], "k long, v array<double>")
    assert {r.key: r.merged for r in G.merged_centroids(centres, "k", "v").collect()} == {1: 1, 2: 1, 3: 3}
