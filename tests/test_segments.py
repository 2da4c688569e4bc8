"""Planes by blocks against a plain flood fill."""

import numpy as np
import pandas as pd
import pytest

from aerolattice.operators import segments


def raster(seed, shape):
    rng = np.random.default_rng(seed)
    height, width = shape
    rows, cols = np.mgrid[:height, :width]
    patch = rng.integers(0, 4, (height // 9 + 1, width // 9 + 1))[rows // 9, cols // 9]
    depth = 100 + 3.0 * patch + rng.normal(size=shape) * 0.3
    depth[rng.random(shape) < 0.08] = 0
    normal = np.stack([0.3 * (patch % 2), np.zeros(shape), np.ones(shape)], axis=2) + rng.normal(size=(*shape, 3)) * 0.02
    normal[rng.random(shape) < 0.02] = 0.1
    return depth, normal


def plain(depth, normal, least):
    height, width = depth.shape
    size = np.linalg.norm(normal, axis=2)
    ok = (depth > 0) & (size**2 > 0.25)
    unit = normal / size[:, :, None]
    out, seen = {}, np.zeros(depth.shape, bool)
    for r in range(height):
        for c in range(width):
            if not ok[r, c] or seen[r, c]:
                continue
            part, todo, seen[r, c] = [], [(r, c)], True
            while todo:
                i, j = todo.pop()
                part.append((i, j))
                for x, y in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if 0 <= x < height and 0 <= y < width and ok[x, y] and not seen[x, y] and unit[i, j] @ unit[x, y] >= 0.995 and abs(depth[i, j] - depth[x, y]) < 0.02 * max(depth[i, j], depth[x, y]):
                        seen[x, y] = True
                        todo.append((x, y))
            if len(part) >= least:
                name = min(part)
                out |= dict.fromkeys(part, name[0] * segments.WIDE + name[1])
    return out


@pytest.mark.parametrize("block", [7, 32, 256])
def test_segments_against_flood_fill(spark, block):
    rows, wanted = [], {}
    for frame, shape in ((1, (60, 71)), (2, (30, 33)), (None, (20, 9))):
        depth, normal = raster(frame or 5, shape)
        rows.append(pd.DataFrame({"frame": frame, "row": np.repeat(np.arange(shape[0]), shape[1]), "col": np.tile(np.arange(shape[1]), shape[0]), "depth": depth.ravel(), **{n: normal[:, :, k].ravel() for k, n in enumerate(("nx", "ny", "nz"))}}))
        wanted |= {(frame, *at): name for at, name in plain(depth, normal, 20).items()}
    table = pd.concat(rows).astype({"frame": "Int64"})
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "frame long, row long, col long, depth double, nx double, ny double, nz double").repartition(5)
    got = segments.plane_segments(df, block=block, least=20).collect()
    assert len(got) == len(wanted) and {(r.frame, r.row, r.col): r.segment for r in got} == wanted
    assert len(set(wanted.values())) > 5
    if block == 7:
        assert segments.plane_segments(df.where("false")).count() == 0


def test_labels():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    got = segments.labels(500, a, b)
    assert (got[a] == got[b]).all() and (got <= np.arange(500)).all() and (got[got] == got).all()
    chain = np.arange(9999)
    assert not segments.labels(10000, chain, chain + 1).any()


def test_fitted_planes_against_svd(spark):
    rng = np.random.default_rng(7)
    rows, wanted = [], {}
    for k, sides in enumerate([(4.0, 2.0, 0.01), (1.0, 1.0, 1.0), (50.0, 1.5, 0.0), (50.0, 0.5, 0.0), (3.0, 0.05, 0.0), (0.4, 0.4, 0.0), (9.0, 9.0, 0.0), (2.0, 2.0, 2.0)]):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        n = 2 if k == 7 else 200
        points = rng.normal(size=(n, 3)) * sides @ turn.T + [4e5, 5.8e6, 40]
        normal = turn[:, 2] + rng.normal(size=(n, 3)) * 0.01
        normal /= np.linalg.norm(normal, axis=1, keepdims=True)
        rows += [(k, *map(float, p), *map(float, m)) for p, m in zip(points, normal, strict=True)]
        spread = 2 * np.linalg.svd(points - points.mean(0), full_matrices=False)[1] / np.sqrt(n)
        if n >= 3 and spread[0] * spread[1] >= 1 and spread[1] >= 0.3 and spread[0] / spread[1] <= 25:
            mean = normal.mean(0) / np.linalg.norm(normal.mean(0))
            wanted[k] = (*mean, *points.mean(0), mean @ points.mean(0), *spread[:2], spread[0] * spread[1])
    df = spark.createDataFrame(rows + [(0, None, 1.0, 1.0, 0.0, 0.0, 1.0)], "s long, x double, y double, z double, nx double, ny double, nz double")
    got = {r.s: tuple(r)[2:] for r in segments.fitted_planes(df, ["s"]).collect()}
    assert set(got) == set(wanted) == {0, 1, 6}
    for k, w in wanted.items():
        assert np.allclose(got[k], w, rtol=1e-6)
    assert segments.fitted_planes(df.where("false"), ["s"]).count() == 0


def test_segments_over_many_blocks_of_named_frames(spark):
    """One plane of two frames with names, over 16 blocks each: labels of one frame are also those of the other, and stay apart; a gap parts the second's."""
    cells = spark.range(2 * 40 * 40).selectExpr("IF(id < 1600, 'one', 'two') AS frame", "id % 1600 DIV 40 AS row", "id % 40 AS col", "IF(id >= 1600 AND id % 40 = 20, 0D, 50D) AS depth", "0D AS nx", "0D AS ny", "1D AS nz")
    got = segments.plane_segments(cells, block=10, least=20).groupBy("frame", "segment").count().collect()
    assert sorted(map(tuple, got)) == [("one", 0, 1600), ("two", 0, 800), ("two", 21, 760)]
