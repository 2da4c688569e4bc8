"""Depth and normal images of meshes as tables: each task keeps its own nearest fragments, a minimum joins them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAGMENTS = "row int, col int, z double, f long"


def clipped(corners: np.ndarray, near: float) -> list[np.ndarray]:
    """The parts of a triangle in camera coordinates with z >= ``near``: none, one or two triangles."""
    inside = corners[:, 2] >= near
    if inside.all() or not inside.any():
        return [corners] if inside.all() else []
    out = []
    for k in range(3):
        a, b = corners[k], corners[(k + 1) % 3]
        if a[2] >= near:
            out.append(a)
        if (a[2] >= near) != (b[2] >= near):
            out.append(a + (b - a) * (near - a[2]) / (b[2] - a[2]))
    return [np.array(out[:3])] if len(out) == 3 else [np.array(out[:3]), np.array([out[0], out[2], out[3]])]


def cover(corners: np.ndarray, focal: float, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and depths of the pixels whose centres a triangle in front of the camera covers.

    Depth is linear in the image, not along the surface.
    """
    u, v = focal * corners[:, 0] / corners[:, 2] + width / 2, focal * corners[:, 1] / corners[:, 2] + height / 2
    c0, c1 = max(int(np.ceil(u.min() - 0.5)), 0), min(int(np.floor(u.max() - 0.5)), width - 1)
    r0, r1 = max(int(np.ceil(v.min() - 0.5)), 0), min(int(np.floor(v.max() - 0.5)), height - 1)
    area = (u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])
    if c1 < c0 or r1 < r0 or area == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows, cols = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
    x, y = cols + 0.5, rows + 0.5
    weights = [((u[(k + 1) % 3] - x) * (v[(k + 2) % 3] - y) - (u[(k + 2) % 3] - x) * (v[(k + 1) % 3] - y)) / area for k in range(3)]
    hit = (weights[0] >= 0) & (weights[1] >= 0) & (weights[2] >= 0)
    return rows[hit], cols[hit], sum(w * z for w, z in zip(weights, corners[:, 2], strict=True))[hit]


def depth_image(faces: DataFrame, vertices: DataFrame, rotation: list[float], translation: list[float], focal: float, width: int, height: int, near: float = 0.5) -> DataFrame:
    """(row, col, z, f): the nearest face of each covered pixel under a world-to-camera pose; of equals the lowest f.

    A task's image is bounded by the image's size, whatever the number of faces.
    """
    joined = faces
    for corner in "abc":
        joined = joined.join(vertices.select(F.col("v").alias(corner), *[F.col(k).alias(f"{corner}{k}") for k in "xyz"]), corner)
    names = [f"{corner}{k}" for corner in "abc" for k in "xyz"]
    turn, shift = np.asarray(rotation, float).reshape(3, 3), np.asarray(translation, float)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        depth, face = np.full((height, width), np.inf), np.full((height, width), np.iinfo(np.int64).max)
        for batch in batches:
            for f, corners in zip(batch["f"].tolist(), batch[names].to_numpy(float).reshape(-1, 3, 3), strict=True):
                for part in clipped(corners @ turn.T + shift, near):
                    rows, cols, z = cover(part, focal, width, height)
                    better = (z < depth[rows, cols]) | ((z == depth[rows, cols]) & (f < face[rows, cols]))
                    depth[rows[better], cols[better]], face[rows[better], cols[better]] = z[better], f
        rows, cols = np.nonzero(np.isfinite(depth))
        yield pd.DataFrame({"row": rows, "col": cols, "z": depth[rows, cols], "f": face[rows, cols]})

    fragments = joined.select("f", *names).mapInPandas(draw, FRAGMENTS)
    best = fragments.groupBy("row", "col").agg(F.min(F.struct("z", "f")).alias("best"))
    return best.select("row", "col", "best.z", "best.f")


def wireframe(edges: DataFrame, vertices: DataFrame, interval: float) -> DataFrame:
    """Points along each edge (low, high), ``interval`` apart, both ends included."""
    ends = edges
    for end in ("low", "high"):
        ends = ends.join(vertices.select(F.col("v").alias(end), *[F.col(k).alias(f"{end}_{k}") for k in "xyz"]), end)
    length = F.sqrt(sum(((F.col(f"high_{k}") - F.col(f"low_{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    steps = F.greatest(F.ceil(length / interval), F.lit(1)).cast("int")
    points = ends.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    part = F.col("k") / F.col("steps")
    return points.select("low", "high", "k", *[(F.col(f"low_{c}") + (F.col(f"high_{c}") - F.col(f"low_{c}")) * part).alias(c) for c in "xyz"])
