"""Nearest rows by angle against all pairs."""

import numpy as np
import pytest

from aerolattice.operators import neighbours


@pytest.mark.parametrize("size", [None, 0.01])
def test_nearest_by_angle_against_all_pairs(spark, size):
    """Scattered vectors, a dense bundle, copies of one vector, one without length."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(300, 4)), [1, 2, 3, 4] + rng.normal(size=(100, 4)) * 1e-3, np.tile([0.5, -1.0, 0.25, 2.0], (60, 1)), np.zeros((1, 4))])
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "n long, v array<double>")
    got = sorted(map(tuple, neighbours.nearest_by_angle(points, points.where("n % 10 = 0").withColumnRenamed("n", "q"), 5, size).collect()))
    c = v @ v.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1), 1e-300)
    wanted = []
    for q in range(0, 460, 10):
        order = [n for n in sorted(range(460), key=lambda n: (-round(c[q, n], 13), n)) if n != q]
        wanted += [(q, n, k + 1) for k, n in enumerate(order[:5])]
    assert got == sorted(wanted)


def test_few_rows_are_all_found(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "n long, v array<double>")
    assert sorted(map(tuple, neighbours.nearest_by_angle(points, points.withColumnRenamed("n", "q").where("q = 0")).collect())) == [(0, 1, 2), (0, 2, 1)]
