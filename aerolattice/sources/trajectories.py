"""Readers of trajectories and camera files, with fixed schemas, through Spark's own readers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = """name string, width int, height int, frameRate int, numFrames int, durationSeconds double, cameraFrames array<struct<
  position: struct<x: double, y: double, z: double>, rotation: struct<x: double, y: double, z: double>,
  coordinate: struct<latitude: double, longitude: double, altitude: double>, fovVertical: double>>"""
POSES = "frame_id int, x double, y double, z double, qw double, qx double, qy double, qz double, latitude double, longitude double, altitude double, fov_vertical double, roll double, pitch double, yaw double"
COLMAP = "path string, image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string"


def document_frames(spark: SparkSession, path: str) -> DataFrame:
    """A row for each camera frame of trajectory documents; the frame's number is its place in the array.

    The document's own numFrames is the last index, so n_frames is counted anew.
    """
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("path", F.input_file_name())
    head = docs.select("path", "name", "width", "height", "frameRate", F.size("cameraFrames").alias("n_frames"), F.posexplode("cameraFrames").alias("frame_id", "f"))
    return head.select("path", "name", "width", "height", "frameRate", "n_frames", "frame_id", "f.position", "f.rotation", "f.coordinate", "f.fovVertical")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """poses.csv by header; other columns are left out, missing ones null."""
    raw = spark.read.option("header", True).csv(path)
    names = [f.strip().split(" ") for f in POSES.split(",")]
    return raw.select(*[(F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in names])


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    fields = lines.withColumn("fields", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""))
    return fields.where(~F.ltrim("value").startswith("#") & (F.size("fields") >= least))


def tum(spark: SparkSession, path: str) -> DataFrame:
    """``ts x y z qx qy qz qw`` lines; comments and short lines are skipped, of equal times the last counts."""
    names = ("ts", "x", "y", "z", "qx", "qy", "qz", "qw")
    rows = _fields(spark, path, 8).select("path", "line", *[F.col("fields")[k].try_cast("double").alias(n) for k, n in enumerate(names)])
    last = Window.partitionBy("path", "ts").orderBy(F.desc("line"))
    kept = rows.where("ts is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return kept.select("path", *names, F.rint("ts").cast("long").alias("frame_id"))


def flat_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 16 numbers, a row-major camera-to-world matrix; the line's place is the frame."""
    rows = _fields(spark, path, 16).select("path", "line", F.transform(F.slice("fields", 1, 16), lambda x: x.try_cast("double")).alias("c2w"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select("path", place.cast("long").alias("frame_id"), "c2w")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """``key = value`` lines of numbers as a map for each file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.split("value", "\r?\n")).alias("value"))
    pairs = lines.select("path", F.split(F.regexp_replace("value", "#.*$", ""), "=", 2).alias("kv")).where(F.size("kv") == 2)
    found = pairs.select("path", F.trim(F.col("kv")[0]).alias("k"), F.trim(F.col("kv")[1]).try_cast("double").alias("v")).where("v is not null")
    return found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """fx, fy, cx, cy and size of intrinsics.json; distortion from any of its three names or k1, k2, p1, p2, k3."""
    names = ("distortion", "dist", "dist_coef")
    schema = "fx double, fy double, cx double, cy double, width int, height int, k1 double, k2 double, p1 double, p2 double, k3 double, " + ", ".join(f"{n} array<double>" for n in names)
    raw = spark.read.schema(schema).json(path, multiLine=True)
    scalars = F.when(F.col("k1").isNotNull(), F.array(*[F.coalesce(F.col(k), F.lit(0.0)) for k in ("k1", "k2", "p1", "p2", "k3")]))
    return raw.select(F.input_file_name().alias("path"), "fx", F.coalesce("fy", "fx").alias("fy"), F.coalesce("cx", F.col("width") / 2).alias("cx"), F.coalesce("cy", F.col("height") / 2).alias("cy"), "width", "height", F.coalesce(*names, scalars).alias("distortion"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, sequence) of splits.json."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("split", "names")).select("split", F.explode("names").alias("sequence"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """World-to-camera poses of images.bin files: a file is one row of the scan, read in one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, at = [], 8
                for _ in range(struct.unpack_from("<Q", content)[0]):
                    image, *pose, camera = struct.unpack_from("<I7dI", content, at)
                    end = content.index(b"\0", at + 64)
                    points = struct.unpack_from("<Q", content, end + 1)[0]
                    rows.append((name, image, *pose, camera, content[at + 64 : end].decode()))
                    at = end + 9 + 24 * points
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in COLMAP.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, COLMAP)


def colmap_images_text(spark: SparkSession, path: str) -> DataFrame:
    """As colmap_images() of images.txt: of the lines that aren't comments or blank, each pose is followed by one of points."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", "\r?\n"), lambda x: ~F.ltrim(x).startswith("#")).alias("lines"))
    # a line of points may be empty, so lines count in pairs from the first that isn't
    first = F.array_position(F.transform("lines", lambda x: F.trim(x) != ""), True).cast("int")
    poses = lines.where(first > 0).select("path", F.posexplode(F.slice("lines", first, F.size("lines"))).alias("k", "value")).where("k % 2 = 0")
    f = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    named = poses.withColumn("f", f).where(F.size("f") >= 10)
    columns = [F.col("f")[k].try_cast(t).alias(n) for k, (n, t) in enumerate((x.split()[0], x.split()[1]) for x in COLMAP.split(", ")[1:])]
    return named.select("path", *columns).where("image_id is not null")


def colmap_model(spark: SparkSession, folders: str) -> DataFrame:
    """Images of the model folders that match: those of images.bin, and of images.txt where a folder has no images.bin."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "images.{bin,txt}").load(folders).select("path")
    kinds = {r.kind for r in listed.select(F.regexp_extract("path", r"([a-z]+)$", 1).alias("kind")).distinct().collect()}  # two at most
    empty = spark.createDataFrame([], COLMAP)
    binary = colmap_images(spark, f"{folders.rstrip('/')}/images.bin") if "bin" in kinds else empty
    text = colmap_images_text(spark, f"{folders.rstrip('/')}/images.txt") if "txt" in kinds else empty
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, r"/[^/]*$", ""), "^file:/+", "/")
    done = listed.where(F.col("path").endswith(".bin")).select(folder(F.col("path")).alias("_folder")).distinct()
    return binary.unionByName(text.join(done, folder(F.col("path")) == F.col("_folder"), "left_anti"))


def matrix_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """fx, fy, cx, cy of files that hold a bare 3x3 matrix; files with other than nine numbers are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "#[^\n]*", " ").alias("value"))
    n = raw.select("path", F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double")).alias("k")).where(F.size("k") == 9)
    return n.select("path", F.col("k")[0].alias("fx"), F.col("k")[4].alias("fy"), F.col("k")[2].alias("cx"), F.col("k")[5].alias("cy"))
