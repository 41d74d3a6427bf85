import numpy as np
import pytest

from kgloom.functions.vectors import close_pairs, close_rows, distinct_vectors, unpacked, usable_vectors


def test_usable(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(" a ", good, 1), ("a", [9.0] * 3, 0), ("b", None, 1), ("c", [1.0], 1), ("d", [0.0] * 3, 1), ("e", [1.0, float("nan"), 2.0], 1), ("f", [1.0, None, 2.0], 1), (None, good, 1), ("g", [2.0, 4.0, 6.0], 1), ("h", good, 1), ("h", None, 2), ("i", [float("inf"), 1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "id string, embedding array<float>, updated_at int, vec binary")
    got = usable_vectors(df, 3)
    assert {r.id: np.frombuffer(r.vec, "<f4").tolist() for r in got.collect()} == {"a": good, "g": [2.0, 4.0, 6.0]}
    assert len({r.same for r in distinct_vectors(got, 3).collect()}) == 1
    assert usable_vectors(df.limit(0), 3).collect() == []


def test_close_pairs():
    values = np.random.default_rng(1).standard_normal((300, 4)).astype(np.float32)
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.85)) if i < j}
    assert {(int(i), int(j)) for a, b, _ in close_pairs(values, 0.85, 64) for i, j in zip(a, b)} == want
    assert unpacked(__import__("pyarrow").array([values[0].tobytes()]), 4).tolist() == [values[0].tolist()]


@pytest.mark.parametrize("noise", [0, 1e-4, 0.05, 0.5])
def test_close_rows_keeps_the_first_of_equal_ones(noise):
    rng = np.random.default_rng(2)
    values = (rng.uniform(1, 1.9, 500)[:, None] * (rng.standard_normal(8) + noise * rng.standard_normal((500, 8)))).astype("<f4")
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 12)
    np.fill_diagonal(cosine, -2)
    want = {(min(i, j), max(i, j)) for i in range(500) for j in np.lexsort((np.arange(500), -cosine[i]))[:10].tolist() if cosine[i, j] >= 0.85}
    got = {(int(i), int(j)) for a, b, _ in close_rows(values, 0.85, 10, 64, 96) for i, j in zip(a, b)}
    assert len(got ^ want) <= 2  # of cosines that differ by rounding
