"""Quantiles, the box of a scene and the height of its map, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolattice.operators import camera_fit, quantiles, scene



def camera():
    return [F.lit(v) for v in (500.0, 500.0, 320.0, 240.0)]


@pytest.mark.parametrize("few", [10_000, 5])
def test_quantiles_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(2)
    cases = [rng.normal(size=3001) * 10.0 ** rng.integers(-6, 6, 3001), np.repeat([1.0, 2.0, 2.5], [1000, 1001, 3]), np.append(np.zeros(2000), 1e300), np.array([3.0]), np.array([1.0, 2.0]), np.arange(4001.0), np.full(50, -7.5)]
    for values in cases:
        df = spark.createDataFrame(pd.DataFrame({"v": values})).union(spark.sql("select cast(null as double) union all select double('nan')")).cache()
        for share in (0.0, 0.005, 0.25, 0.5, 0.77, 0.995, 1.0):
            assert np.isclose(quantiles.quantile(df, "v", share), np.quantile(values, share), rtol=1e-12), (len(values), share)
    assert quantiles.quantile(df.where("false"), "v", 0.5) is None and quantiles.quantile(df.where("v is null"), "v", 0.5) is None


def cameras(spark, n, spread=100.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        turn = (camera_fit.turn_by(rng.uniform(-0.3, 0.3, 3)) @ np.diag([1.0, -1, -1])).T
        rows.append((k, *turn.ravel().tolist(), *rng.uniform(-spread, spread, 2).tolist(), 150.0))
    return rows, spark.createDataFrame(rows, "cam long, " + ", ".join(f"m{i} double" for i in range(9)) + ", x double, y double, z double")


@pytest.mark.parametrize(("spread", "longest"), [(100.0, 5000.0), (4000.0, 5000.0), (4000.0, None)])
def test_scene_box(spark, spread, longest):
    rows, df = cameras(spark, 20, spread)
    rng = np.random.default_rng(3)
    depths = [(int(c), float(u), float(v), float(d)) for c, u, v, d in zip(rng.integers(0, 19, 2000), rng.uniform(0, 640, 2000), rng.uniform(0, 480, 2000), rng.uniform(100, 200, 2000), strict=True)]
    depths += [(0, 1.0, 1.0, 0.0), (0, 1.0, 1.0, 1e5), (1, 1.0, 1.0, None), (99, 1.0, 1.0, 5.0)]
    got = scene.scene_box(df, spark.createDataFrame(depths, "cam long, u double, v double, depth double"), 640.0, 480.0, camera(), longest=longest).first()
    turns, centres = np.array([r[1:10] for r in rows]).reshape(-1, 3, 3), np.array([r[10:] for r in rows])
    ok = [d for d in depths if d[0] < 20 and d[3] and 0 < d[3] < 1e5]
    at = np.array([turns[c] @ (d * np.array([(u - 320) / 500, (v - 240) / 500, 1])) + centres[c] for c, u, v, d in ok])
    ground, seen = np.median(at[:, 2]), []
    for c in {d[0] for d in depths} & set(range(20)):
        for u, v in ((0, 0), (640, 0), (640, 480), (0, 480)):
            ray = turns[c] @ np.array([(u - 320) / 500, (v - 240) / 500, 1])
            t = (ground - centres[c][2]) / ray[2]
            t = 2000 / np.hypot(*ray[:2]) if t <= 0 else min(t, 2000 / np.hypot(*ray[:2]))
            seen.append(centres[c][:2] + t * ray[:2])
    low, high = np.minimum(np.quantile(at[:, :2], 0.005, axis=0), np.min(seen, axis=0)) - 200, np.maximum(np.quantile(at[:, :2], 0.995, axis=0), np.max(seen, axis=0)) + 200
    if longest and (high - low).max() > longest:
        middle = (centres[:, :2].min(0) + centres[:, :2].max(0)) / 2
        low, high = np.maximum(low, middle - longest / 2), np.minimum(high, middle + longest / 2)
    assert np.allclose(got, [*low, *high])


def test_scene_box_without_depths_or_cameras(spark):
    rows, df = cameras(spark, 3)
    none = spark.createDataFrame([], "cam long, u double, v double, depth double")
    x, y = [r[10] for r in rows], [r[11] for r in rows]
    assert np.allclose(scene.scene_box(df, none, 640.0, 480.0, camera()).first(), [min(x) - 200, min(y) - 200, max(x) + 200, max(y) + 200])
    assert scene.scene_box(df.where("false"), none, 640.0, 480.0, camera()).count() == 0


def test_height_offset(spark):
    rng = np.random.default_rng(4)
    tiles = [("a", 0.0, 0.0, 10.0, 10.0, 0.5), ("b", 8.0, 0.0, 18.0, 10.0, 0.5), ("c", 100.0, 0.0, 110.0, 10.0, 0.5)]
    maps = {t[0]: rng.normal(size=(20, 20)) * 5 for t in tiles}
    maps["a"][:, 18:] = -9999
    cells = [(t, r, c, float(maps[t][r, c])) for t in maps for r in range(20) for c in range(20)]
    points = [tuple(map(float, p)) for p in np.column_stack([rng.uniform(-2, 20, 700), rng.uniform(-1, 11, 700), rng.normal(size=700) + 30])] + [(None, 1.0, 1.0), (5.0, 5.0, None)]
    offsets = []
    for x, y, z in points[:700]:
        for name, left, bottom, right, top, res in tiles:
            r, c = int(np.floor((top - y) / res)), int(np.floor((x - left) / res))
            if left <= x <= right and bottom <= y <= top and 0 <= r < 20 and 0 <= c < 20 and maps[name][r, c] > -1000:
                offsets.append(z - maps[name][r, c])
                break
    df = spark.createDataFrame(points, "x double, y double, z double")
    tile_df, cell_df = spark.createDataFrame(tiles, "tile string, left double, bottom double, right double, top double, res double"), spark.createDataFrame(cells, "tile string, row long, col long, z double")
    got = scene.height_offset(df, tile_df, cell_df, size=4.0).first()
    assert got.points == len(offsets) and np.isclose(got.offset, np.median(offsets))
    assert tuple(scene.height_offset(df.withColumn("z", F.col("z") + 200), tile_df, cell_df).first()) == (None, len(offsets))
    assert tuple(scene.height_offset(df.where("false"), tile_df, cell_df).first()) == (None, 0)


def test_height_offset_of_points_in_one_place(spark):
    """Nearly all points are over one cell of the map: looked up where they are, they give the same."""
    df = spark.range(0, 3000, 1, 4).selectExpr("CASE WHEN id % 50 = 0 THEN id % 8 + 0.5D ELSE 2.5D END AS x", "2.5D AS y", "id % 17 + 30D AS z")
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 8.0, 4.0, 1.0), ("b", 2.0, 0.0, 8.0, 4.0, 1.0)], "tile string, left double, bottom double, right double, top double, res double")
    cells = spark.range(64).selectExpr("CASE WHEN id < 32 THEN 'a' ELSE 'b' END AS tile", "id % 32 DIV 8 AS row", "id % 8 AS col", "CASE WHEN id % 3 = 0 THEN -9999D ELSE id % 5 + 1D END AS z")
    got = [tuple(scene.height_offset(df, tiles, cells, size=4.0, heavy=n).first()) for n in (20, 100_000)]
    assert got[0] == got[1] and got[0][1] > 2500
