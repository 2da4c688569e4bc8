"""Readers of rasters, depth maps, meshes and points in array files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 256


def _arrays(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def raster_blocks(spark: SparkSession, path: str, key: str = "height", block: int = BLOCK) -> DataFrame:
    """Blocks of two-dimensional arrays of npz files: path, block row and column, width, and values row by row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                a = _arrays(content)[key].astype(np.float32)
                for r in range(0, a.shape[0], block):
                    cells = [(name, r // block, c // block, min(block, a.shape[1] - c), a[r : r + block, c : c + block].reshape(-1)) for c in range(0, a.shape[1], block)]
                    yield pd.DataFrame(cells, columns=["path", "br", "bc", "width", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, br int, bc int, width int, values array<float>")


def cells(blocks: DataFrame, block: int = BLOCK, nodata: float = -9999.0) -> DataFrame:
    """(path, row, col, z) of raster_blocks(); ``nodata`` and NaN become null."""
    at = blocks.select("path", "br", "bc", "width", F.posexplode("values").alias("k", "v"))
    z = F.when(~F.isnan("v") & (F.col("v") != nodata), F.col("v").cast("double"))
    return at.select("path", (F.col("br") * block + F.floor(F.col("k") / F.col("width"))).alias("row"), (F.col("bc") * block + F.col("k") % F.col("width")).cast("long").alias("col"), z.alias("z"))


def depth_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """As raster_blocks() for depth files: floats as they are, 16-bit counts between depth_min and depth_max, 0 invalid."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = _arrays(content)
                a = found["depth"] if "depth" in found else found.get("arr_0", next(iter(found.values())))
                if a.dtype == np.uint16:
                    low, high = float(found["depth_min"]), float(found["depth_max"])
                    a = np.where(a > 0, low + (a.astype(np.float64) - 1) / 65534 * (high - low), 0.0)
                a = a.astype(np.float32)
                for r in range(0, a.shape[0], block):
                    parts = [(name, r // block, c // block, min(block, a.shape[1] - c), a[r : r + block, c : c + block].reshape(-1)) for c in range(0, a.shape[1], block)]
                    yield pd.DataFrame(parts, columns=["path", "br", "bc", "width", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, br int, bc int, width int, values array<float>")


def points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, intensity and classification of point files; the last two may be missing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = _arrays(content)
                p = found["points"].astype(np.float64)
                out = pd.DataFrame({"path": name, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
                for k in ("intensity", "classification"):
                    out[k] = found[k].astype("int64") if k in found else pd.array([None] * len(p), dtype="Int64")
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, x double, y double, z double, intensity long, classification long")


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, v, x, y, z) and triangles (path, f, a, b, c) of OBJ texts; polygons become fans."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    fields = lines.withColumn("p", F.split(F.trim("value"), r"\s+"))
    order = Window.partitionBy("path").orderBy("line")
    vertex = fields.where(F.col("p")[0] == "v").withColumn("v", F.row_number().over(order) - 1)
    vertices = vertex.select("path", F.col("v").cast("long").alias("v"), *[F.col("p")[k + 1].try_cast("double").alias(n) for k, n in enumerate("xyz")])
    corner = F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: F.split(x, "/")[0].try_cast("long") - 1)
    polygons = fields.where((F.col("p")[0] == "f") & (F.size("p") >= 4)).select("path", "line", corner.alias("q"))
    fans = polygons.select("path", "line", "q", F.explode(F.sequence(F.lit(1), F.size("q") - 2)).alias("k"))
    triangles = fans.select("path", "line", "k", F.col("q")[0].alias("a"), F.get("q", F.col("k")).alias("b"), F.get("q", F.col("k") + 1).alias("c"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("line", "k")) - 1
    return vertices, triangles.select("path", number.cast("long").alias("f"), "a", "b", "c")


def merged_meshes(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All files as one mesh, in the order of their paths: each file's numbers follow those before it."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    counts = vertices.groupBy("path").agg(F.count("*").alias("n"))
    shift = F.broadcast(counts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s")))  # a row for each file
    moved = vertices.join(shift, "path").select((F.col("v") + F.col("s")).alias("v"), "x", "y", "z")
    own = faces.join(shift, "path").select("path", "f", *[(F.col(k) + F.col("s")).alias(k) for k in "abc"])
    return moved, own


def array_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, v, x, y, z, in world coordinates) and faces (path, f, a, b, c, label) of npz meshes.

    An offset that a file has is added to its vertices. A file without labels, or with none, has ``building`` for all faces.
    """

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = _arrays(content)
                at = found["vertices"].astype(float).reshape(-1, 3) + found.get("utm_offset", np.zeros(3)).astype(float)
                yield pd.DataFrame({"path": name, "v": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = _arrays(content)
                at = found["faces"].astype(np.int64).reshape(-1, 3)
                label = found.get("labels", np.zeros(0))
                yield pd.DataFrame({"path": name, "f": np.arange(len(at)), "a": at[:, 0], "b": at[:, 1], "c": at[:, 2], "label": label.astype(str) if len(label) else "building"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(vertices, "path string, v long, x double, y double, z double"), files.mapInPandas(faces, "path string, f long, a long, b long, c long, label string")
