"""Metrics by sequence, method and frame as plain aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_below(error: str, limit: float) -> Column:
    """Percent of the known errors below ``limit``, strictly."""
    return 100 * F.avg(F.when(F.col(error) < limit, 1.0).when(F.col(error).isNotNull(), 0.0))


def error_summary(error: str, prefix: str) -> list[Column]:
    """Mean, median, standard deviation, maximum and root mean square."""
    e = F.col(error)
    named = (("mean", F.avg(e)), ("median", F.percentile(e, F.lit(0.5))), ("std", F.stddev_pop(e)), ("max", F.max(e)), ("rmse", F.sqrt(F.avg(e * e))))
    return [F.round(c, 4).alias(f"{prefix}_{n}") for n, c in named]


def depth_metrics(gt: Column, pred: Column) -> dict[str, Column]:
    """Of valid pixels: relative errors, root mean squares, and shares within factors of 1.25, its square and cube."""
    ratio = F.greatest(gt / pred, pred / gt)
    log_error = F.log(F.greatest(gt, F.lit(1e-6))) - F.log(F.greatest(pred, F.lit(1e-6)))
    within = {f"delta{k}": F.avg((ratio < 1.25**k).cast("double")) for k in (1, 2, 3)}
    return {
        "abs_rel": F.avg(F.abs(gt - pred) / gt), "sq_rel": F.avg((gt - pred) * (gt - pred) / gt),
        "rmse": F.sqrt(F.avg((gt - pred) * (gt - pred))), "rmse_log": F.sqrt(F.avg(log_error * log_error)), **within,
    }


def first_frame_alignment(df: DataFrame, pred: list[str], gt: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """scale by sequence: least squares of the offsets from the first frame, 1 where the prediction stands still."""
    first = df.groupBy(seq).agg(F.min_by(F.struct(*pred, *gt), order).alias("_first"))
    joined = df.join(first, seq)
    dot = norm = F.lit(0.0)
    for p, g in zip(pred, gt, strict=True):
        dp, dg = F.col(p) - F.col(f"_first.{p}"), F.col(g) - F.col(f"_first.{g}")
        dot, norm = dot + dp * dg, norm + dp * dp
    sums = joined.groupBy(seq).agg(F.sum(norm).alias("_norm"), F.sum(dot).alias("_dot"))
    return sums.select(seq, F.when(F.col("_norm") > 1e-12, F.col("_dot") / F.col("_norm")).otherwise(1.0).alias("scale"))


def anchored(df: DataFrame, pred: list[str], gt: list[str], pred_rotation: str | None = None, gt_rotation: str | None = None, with_scale: bool = False, seq: str = "seq", order: str = "ord") -> DataFrame:
    """``df`` with ``scale`` and the coordinates ``ax``, ``ay``, ``az`` of ``pred`` once its first frame is the truth's.

    Where camera-to-world rotations are named (row-major arrays), the turn that makes the first ones equal is applied;
    ``with_scale`` then fits the offsets from the first frame by least squares, 1 where the prediction stands still.
    Two aggregates by sequence, of one row each; no sequence is held in one place.
    """
    named = [c for c in (pred_rotation, gt_rotation) if c]
    first = df.groupBy(seq).agg(F.min_by(F.struct(*pred, *gt, *named), order).alias("_first"))
    joined = df.join(first, seq)
    moved = [F.col(p) - F.col(f"_first.{p}") for p in pred]
    if pred_rotation and gt_rotation:
        a, b = F.col(f"_first.{gt_rotation}"), F.col(f"_first.{pred_rotation}")
        turn = [[sum((a[3 * i + k] * b[3 * j + k] for k in (1, 2)), a[3 * i] * b[3 * j]) for j in range(3)] for i in range(3)]
        moved = [row[0] * moved[0] + row[1] * moved[1] + row[2] * moved[2] for row in turn]
    joined = joined.withColumns({f"_m{i}": m for i, m in enumerate(moved)})
    offset = [F.col(g) - F.col(f"_first.{g}") for g in gt]
    if with_scale:
        dot, norm = (sum((F.col(f"_m{i}") * x for i, x in enumerate(xs[1:], 1)), F.col("_m0") * xs[0]) for xs in (offset, [F.col(f"_m{i}") for i in range(3)]))
        sums = joined.groupBy(seq).agg(F.sum(norm).alias("_norm"), F.sum(dot).alias("_dot"))
        scale = sums.select(seq, F.when(F.col("_norm") > 1e-12, F.col("_dot") / F.col("_norm")).otherwise(1.0).alias("scale"))
        joined = joined.join(scale, seq)
    else:
        joined = joined.withColumn("scale", F.lit(1.0))
    placed = joined.withColumns({f"a{c}": F.col(f"_first.{g}") + F.col("scale") * F.col(f"_m{i}") for i, (c, g) in enumerate(zip("xyz", gt, strict=True))})
    return placed.drop("_first", "_m0", "_m1", "_m2")


ALIGNMENT = "seq long, n long, scale double, rotation array<double>, shift array<double>"


def similarity_alignment(df: DataFrame, pred: list[str], gt: list[str], seq: str = "seq", with_scale: bool = True) -> DataFrame:
    """Scale, rotation and shift by sequence that bring ``pred`` nearest to ``gt`` in the least-squares sense.

    Spark sums up the moments; Python solves one 3x3 problem for each sequence. Sequences of fewer than
    three points, or whose prediction is one point, have none.
    """
    sums = [F.count("*").alias("n")] + [F.avg(c).alias(f"m_{c}") for c in (*pred, *gt)]
    sums += [F.covar_pop(g, p).alias(f"c_{i}{j}") for i, g in enumerate(gt) for j, p in enumerate(pred)]
    sums += [(F.var_pop(pred[0]) + F.var_pop(pred[1]) + F.var_pop(pred[2])).alias("spread")]
    moments = df.dropna(subset=[*pred, *gt]).groupBy(F.col(seq).cast("long").alias("seq")).agg(*sums).where("n >= 3 and spread > 0")

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                cov = np.array([[getattr(r, f"c_{i}{j}") for j in range(3)] for i in range(3)])
                u, d, vt = np.linalg.svd(cov)
                sign = np.ones(3)
                sign[2] = -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0
                rotation = u @ np.diag(sign) @ vt
                scale = float((d * sign).sum() / r.spread) if with_scale else 1.0
                shift = np.array([getattr(r, f"m_{c}") for c in gt]) - scale * rotation @ np.array([getattr(r, f"m_{c}") for c in pred])
                out.append((r.seq, r.n, scale, rotation.reshape(-1).tolist(), shift.tolist()))
            yield pd.DataFrame(out, columns=["seq", "n", "scale", "rotation", "shift"])

    return moments.mapInPandas(solve, ALIGNMENT)


def aligned(df: DataFrame, alignment: DataFrame, pred: list[str], seq: str = "seq") -> DataFrame:
    """``df`` with ax, ay, az: its predictions under the alignment of their sequence."""
    joined = df.join(alignment.drop("n"), seq)
    for k, name in enumerate(("ax", "ay", "az")):
        turned = F.col("rotation")[3 * k] * F.col(pred[0]) + F.col("rotation")[3 * k + 1] * F.col(pred[1]) + F.col("rotation")[3 * k + 2] * F.col(pred[2])
        joined = joined.withColumn(name, F.col("scale") * turned + F.col("shift")[k])
    return joined.drop("scale", "rotation", "shift")


def nearest_in_cells(df: DataFrame, keys: list[str], u: str, v: str, depth: str, order: str, size: float) -> DataFrame:
    """Of each cell of ``size`` pixels the nearest point, the first of equals."""
    kept = [c for c in df.columns if c not in keys]
    cells = [F.floor(F.col(u) / size).alias("cell_u"), F.floor(F.col(v) / size).alias("cell_v")]
    picked = df.groupBy(*keys, *cells).agg(F.min_by(F.struct(*kept), F.struct(depth, order)).alias("_p"))
    return picked.select(*keys, "cell_u", "cell_v", *[F.col("_p")[c].alias(c) for c in kept])


def spread_box(keys: list[str], df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Percentile box and its centre for each of ``keys``."""
    def p(c, q):
        return F.percentile(c, F.lit(q))

    boxes = df.groupBy(*keys).agg(F.count("*").alias("n"), p(x, low).alias("x_low"), p(x, high).alias("x_high"), p(y, low).alias("y_low"), p(y, high).alias("y_high"), p(x, 0.5).alias("cx"), p(y, 0.5).alias("cy"))
    return boxes
