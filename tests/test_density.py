import numpy as np
import pytest

from kgloom.operators.density import density_clusters, density_labels


def test_clusters_of_different_density_and_strays():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.05, (40, 2)), rng.normal(0, 0.6, (40, 2)) + [12, 0], rng.normal(0, 0.2, (30, 2)) + [0, 12], [[40, 40], [-40, 35]]])
    labels = density_labels(x, least_size=8, neighbours=4)
    for part in (slice(0, 40), slice(40, 80), slice(80, 110)):
        values, count = np.unique(labels[part][labels[part] >= 0], return_counts=True)
        assert len(values) == 1 and count[0] >= 25
    assert len({int(labels[i]) for i in (0, 40, 80)} - {-1}) >= 2 and labels[110] == labels[111] == -1


def test_pairs_and_equal_vectors():
    x = np.array([[0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0], [9, 0]])
    assert density_labels(x).tolist() == [0, 0, 1, 1, 2, 2]
    assert density_labels(np.zeros((0, 2))).tolist() == [] and density_labels(np.zeros((1, 2))).tolist() == [-1]
    assert set(density_labels(np.zeros((6, 2))).tolist()) <= {-1, 0, 1, 2}


def test_groups(spark):
    rows = [("a", i, [float(i // 2 * 10), float(i % 2)], 0) for i in range(6)] + [("b", 1, [1.0, 1.0], 0), ("b", 2, None, 0), (None, 3, [2.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>, cluster int")
    got = {(r.g, r.i): r.cluster for r in density_clusters(df, "g", "i", "v").collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("a", 5): 2, ("b", 1): 0, (None, 3): 0}
    assert density_clusters(df.limit(0), "g", "i", "v").collect() == []
    with pytest.raises(Exception, match="more than 3"):
        density_clusters(df, "g", "i", "v", most=3).collect()
