"""Planes of a raster of depths and normals: connected cells that go on evenly, by blocks.

Each block of cells is labelled in one task, as arrays; a block also gets the first row and column of those after it, so it
knows which links lead over its border. Only border cells and their labels are shuffled further: components of the
labels that such links join give the segments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saved
from .joins import heavy_keys, looked_up
from .mesh import components

#: Cells on a side of a block; least cosine between the normals of neighbours, largest step of depth as a share of the larger, and cells at least of a segment.
BLOCK, COSINE, STEP, LEAST_CELLS = 256, 0.995, 0.02, 50
#: Squared length of a normal from which on it counts.
LEAST_NORMAL = 0.25
WIDE = 1 << 31


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0 .. n - 1 is linked to by pairs a, b, directly or through others."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(further := label[label], label):
            label = further


def plane_segments(cells: DataFrame, key: str = "frame", block: int = BLOCK, cosine: float = COSINE, step: float = STEP, least: int = LEAST_CELLS) -> DataFrame:
    """(key, row, col, segment) of ``cells`` (key, row, col, depth, nx, ny, nz) in segments of ``least`` cells or more.

    Neighbours in a row or column belong together if their normals' cosine is ``cosine`` at least and their depths
    differ by less than ``step`` of the larger one. A segment is named by its first cell, as row * 2**31 + column. Cells without a positive depth or
    a normal of half a length are in none; nulls count as such. Of rows for one cell one counts. Rows and columns are from 0 to 2**31.
    """
    kind = dict(cells.dtypes)[key]
    values = ["depth", "nx", "ny", "nz"]
    valid = (F.col("depth") > 0) & (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz") > LEAST_NORMAL)
    own = cells.where(valid).select(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(F.col(c).cast("double").alias(c) for c in values))
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    places = [F.struct(br.alias("br"), bc.alias("bc"), F.lit(True).alias("inside")), F.when((F.col("row") % block == 0) & (br > 0), F.struct((br - 1).alias("br"), bc.alias("bc"), F.lit(False).alias("inside"))), F.when((F.col("col") % block == 0) & (bc > 0), F.struct(br.alias("br"), (bc - 1).alias("bc"), F.lit(False).alias("inside")))]
    dealt = own.select("*", F.inline(F.filter(F.array(*places), lambda x: x.isNotNull())))

    def label(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["row", "col"]).sort_values(["row", "col"])
        r0, c0 = int(name[1]) * block, int(name[2]) * block
        grid = np.full((block + 1, block + 1), -1)
        at = (rows["row"].to_numpy() - r0, rows["col"].to_numpy() - c0)
        grid[at] = np.arange(len(rows))
        depth, normal = rows["depth"].to_numpy(), rows[["nx", "ny", "nz"]].to_numpy()
        normal = normal / np.linalg.norm(normal, axis=1, keepdims=True)
        a, b = (np.concatenate(ends) for ends in zip(*((x.ravel(), y.ravel()) for x, y in ((grid[:-1, :-1], grid[:-1, 1:]), (grid[:-1, :-1], grid[1:, :-1]))), strict=True))
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        even = ((normal[a] * normal[b]).sum(1) >= cosine) & (np.abs(depth[a] - depth[b]) < step * np.maximum(depth[a], depth[b]))
        a, b, inside = a[even], b[even], rows["inside"].to_numpy()
        within = inside[b]
        cell = rows["row"].to_numpy() * WIDE + rows["col"].to_numpy()
        named = cell[labels(len(rows), a[within], b[within])]
        over: dict[int, list[int]] = {}
        for start, end in zip(a[~within].tolist(), cell[b[~within]].tolist(), strict=True):
            over.setdefault(start, []).append(end)
        found = pd.DataFrame({"row": rows["row"].to_numpy(), "col": rows["col"].to_numpy(), "label": named, "over": pd.Series([over.get(k) for k in range(len(rows))], dtype="object")})[inside]
        found.insert(0, key, [name[0]] * len(found))
        return found

    blocks = saved(dealt.groupBy(key, "br", "bc").applyInPandas(label, f"`{key}` {kind}, row long, col long, label long, over array<long>"), "blocks")
    edge = blocks.where((F.col("row") % block == 0) | (F.col("col") % block == 0))
    border = edge.select(F.col(key).alias("k"), (F.col("row") * WIDE + F.col("col")).alias("next"), F.col("label").alias("other"))
    over = blocks.where("over is not null").select(F.col(key).alias("k"), "label", F.explode("over").alias("next"))
    links = saved(over.join(border, over["k"].eqNullSafe(border["k"]) & (over["next"] == border["next"])).select(over["k"], "label", "other").distinct(), "pairs")
    ends = links.select("k", F.explode(F.array("label", "other")).alias("l")).distinct()
    numbers = saved(ends.sort("k", "l").withColumn("node", F.monotonically_increasing_id()), "numbers")  # in the order of the labels, so the least number is the least label's
    for end, label_of in (("a", "label"), ("b", "other")):
        number = numbers.select(F.col("k").alias("of"), "l", F.col("node").alias(end))
        links = links.join(number, F.col("k").eqNullSafe(F.col("of")) & (F.col(label_of) == F.col("l"))).drop("of", "l")
    found = saved(numbers.join(components(links.select("a", "b")), "node"), "named")
    firsts = numbers.select(F.col("node").alias("component"), F.col("l").alias("segment"))
    joined = looked_up(found, firsts, ["component"], heavy_keys(found, ["component"])).select("k", "l", "segment")
    whole = blocks.select(key, "row", "col", "label").join(joined, F.col(key).eqNullSafe(F.col("k")) & (F.col("label") == F.col("l")), "left")
    named = whole.select(key, "row", "col", F.coalesce("segment", "label").alias("segment"))
    large = named.groupBy(F.col(key).alias("k"), F.col("segment").alias("s")).agg(F.count("*").alias("cells")).where(F.col("cells") >= least)
    return named.join(large, F.col(key).eqNullSafe(F.col("k")) & (F.col("segment") == F.col("s")), "left_semi")


#: Square metres and metres that a plane has at least, and how many times as long as wide it is at most.
LEAST_AREA, LEAST_EXTENT, LONGEST_SIDE = 1.0, 0.3, 25.0


def eigenvalues(a: list[list[Column]]) -> list[Column]:
    """The eigenvalues of a symmetric matrix of three rows, from the largest on, in closed form."""
    mean = (a[0][0] + a[1][1] + a[2][2]) / 3
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    size = F.sqrt((sum(((a[i][i] - mean) * (a[i][i] - mean) for i in (1, 2)), (a[0][0] - mean) * (a[0][0] - mean)) + 2 * off) / 6)
    b = [[((a[i][j] - mean) if i == j else a[i][j]) / size for j in range(3)] for i in range(3)]
    half = (b[0][0] * (b[1][1] * b[2][2] - b[1][2] * b[1][2]) - b[0][1] * (b[0][1] * b[2][2] - b[1][2] * b[0][2]) + b[0][2] * (b[0][1] * b[1][2] - b[1][1] * b[0][2])) / 2
    angle = F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3
    first, last = mean + 2 * size * F.cos(angle), mean + 2 * size * F.cos(angle + 2 * np.pi / 3)
    return [F.when(size > 0, x).otherwise(mean) for x in (first, 3 * mean - first - last, last)]


def fitted_planes(points: DataFrame, keys: list[str], area: float = LEAST_AREA, extent: float = LEAST_EXTENT, longest: float = LONGEST_SIDE) -> DataFrame:
    """The planes of segments, from ``points`` (keys, x, y, z, and nx, ny, nz of length one) in world coordinates.

    A row for each segment: keys, cells, nx, ny, nz (the mean normal), cx, cy, cz (the mean point), d (normal times mean point), extent_major and extent_minor (twice the
    deviation along the two longest axes) and area, their product. Segments of fewer than three points, of less than ``area`` or ``extent``, or over ``longest`` times as
    long as wide are left out; so are points with a null. All comes from moments that tasks sum up before the shuffle.
    """
    own = points.dropna(subset=["x", "y", "z", "nx", "ny", "nz"])
    moments = [F.covar_pop(p, q).alias(f"{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    found = own.groupBy(*keys).agg(F.count("*").alias("cells"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"), *moments)
    spread = eigenvalues([[F.col(min(p, q) + max(p, q)) for q in "xyz"] for p in "xyz"])
    found = found.where("cells >= 3").withColumns({f"e{k}": F.sqrt(F.greatest(e, F.lit(0.0))) for k, e in enumerate(spread[:2])})
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")) + 1e-12
    found = found.withColumns({f"n{c}": F.col(f"m{c}") / size for c in "xyz"}).withColumns({"extent_major": 2 * F.col("e0"), "extent_minor": 2 * F.col("e1")})
    kept = found.withColumn("area", F.col("extent_major") * F.col("extent_minor")).where((F.col("area") >= area) & (F.col("extent_minor") >= extent) & (F.col("extent_major") <= longest * F.col("extent_minor")))
    return kept.select(*keys, "cells", "nx", "ny", "nz", "cx", "cy", "cz", (F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz")).alias("d"), "extent_major", "extent_minor", "area")
