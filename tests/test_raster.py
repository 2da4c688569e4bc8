"""Neighbourhoods of raster cells against plain loops."""

import numpy as np

from aerolattice.operators import raster


def test_dilated_eroded_and_closed(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((30, 40)) < 0.4
    mask[10:20, 10:25] = True
    mask[14, 17] = mask[0, 0] = False

    def steps(a, reach, whole):
        for _ in range(reach):
            p = np.pad(a, 1)
            parts = [p[1:-1, 1:-1], p[2:, 1:-1], p[:-2, 1:-1], p[1:-1, 2:], p[1:-1, :-2]]
            a = np.all(parts, axis=0) if whole else np.any(parts, axis=0)
        return a

    def table(a):
        return spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(a)], "row long, col long")

    def found(df):
        got = np.zeros(mask.shape, bool)
        for r in df.collect():
            assert not got[r.row, r.col]
            got[r.row, r.col] = True
        return got

    cells, grid = table(mask), table(np.ones_like(mask))
    for reach in (1, 2):
        assert np.array_equal(found(raster.dilated(cells, grid, reach)), steps(mask, reach, False))
        assert np.array_equal(found(raster.eroded(cells, reach)), steps(mask, reach, True))
        assert np.array_equal(found(raster.closed(cells, grid, reach)), steps(steps(mask, reach, False), reach, True))
    assert raster.closed(cells.where("false"), grid, 2).count() == 0
