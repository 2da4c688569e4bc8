"""Writers of poses, results and metrics; all are Spark's own, so commits and retries are too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_poses(poses: DataFrame, path: str) -> None:
    """CSV with six places for metres and degrees, eight for quaternions, ten for coordinates."""
    places = {"x": 6, "y": 6, "z": 6, "qw": 8, "qx": 8, "qy": 8, "qz": 8, "latitude": 10, "longitude": 10, "altitude": 6, "fov_vertical": 6, "roll": 6, "pitch": 6, "yaw": 6}
    columns = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c))).alias(c) for c, n in places.items() if c in poses.columns]
    poses.select("frame_id", *columns).write.option("header", True).csv(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """Frame results as CSV, nulls as ``None``."""
    results.write.option("header", True).option("nullValue", "None").csv(path)


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("seq",)) -> None:
    """Frame results as Parquet, a folder for each value of ``by``; equal values meet before the write."""
    results.repartition(*by).write.partitionBy(*by).parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
