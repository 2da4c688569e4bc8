"""Joins by box, time, place and likeness, each through equal keys: no theta join over all pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved

BOX = ("minx", "miny", "maxx", "maxy")
#: Rows of one key from which on its partner goes to all tasks; boxes of one cell from which on it is split, and into how many along each axis.
HEAVY, CROWDED, SPLIT = 100_000, 5_000, 8


def heavy_keys(df: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame | None:
    """The keys of ``heavy`` rows or more, which are one in ``heavy`` of all rows at most; None where no key has as many."""
    found = df.groupBy(*keys).count().where(F.col("count") >= heavy).select(*keys)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], often: DataFrame | None) -> DataFrame:
    """``df`` joined to ``table`` on ``keys``. Rows of the keys ``often``, as heavy_keys() of ``df`` tells, stay where they are and aren't brought to one task."""
    if often is None:
        return df.join(table, keys)
    near = df.join(F.broadcast(table.join(F.broadcast(often), keys, "left_semi")), keys)
    return df.join(F.broadcast(often), keys, "left_anti").join(table, keys).unionByName(near)


def cells_of(df: DataFrame, size: float) -> DataFrame:
    """Boxes with each grid cell (_cx, _cy) that they touch."""
    xs = F.sequence(F.floor(F.col("minx") / size), F.floor(F.col("maxx") / size))
    ys = F.sequence(F.floor(F.col("miny") / size), F.floor(F.col("maxy") / size))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def overlapping(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float, closed: bool = True) -> DataFrame:
    """Pairs (a_key, b_key) of boxes (minx, miny, maxx, maxy) that overlap; ``closed``: touching counts.

    Boxes are dealt out to grid cells. A pair is reported in one cell alone, the lowest that both share,
    so no distinct is needed. Nulls overlap nothing.
    """
    left = cells_of(a.select(a_key, *BOX), size)
    right = cells_of(b.select(b_key, *[F.col(c).alias(f"_{c}") for c in BOX]).withColumns({c: F.col(f"_{c}") for c in BOX}), size).drop(*BOX)
    own = (F.col("_cx") == F.floor(F.greatest("minx", "_minx") / size)) & (F.col("_cy") == F.floor(F.greatest("miny", "_miny") / size))
    if closed:
        meet = (F.col("minx") <= F.col("_maxx")) & (F.col("maxx") >= F.col("_minx")) & (F.col("miny") <= F.col("_maxy")) & (F.col("maxy") >= F.col("_miny"))
    else:
        meet = (F.col("minx") < F.col("_maxx")) & (F.col("maxx") > F.col("_minx")) & (F.col("miny") < F.col("_maxy")) & (F.col("maxy") > F.col("_miny"))
    return left.join(right, ["_cx", "_cy"]).where(own & meet).select(a_key, b_key)


def touching(boxes: DataFrame, key: str, size: float, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that join all boxes which touch or overlap, directly or through others: far fewer than the pairs.

    Equal boxes are linked to the least of them, which stands for all. The others are dealt out to grid cells, and cells of over ``crowded`` boxes split.
    Boxes that reach over a cell on all sides are linked to the least of these; what else is in a cell is swept along x. Nulls touch nothing.
    """
    own = saved(boxes.select(F.col(key).alias("box"), *BOX).where("minx <= maxx and miny <= maxy"), "boxes")
    each = own.groupBy(*BOX).agg(F.min("box").alias("least"))
    links = [own.join(each, list(BOX)).where("box <> least").select(F.col("box").alias("a"), F.col("least").alias("b"))]
    cells, at = cells_of(each.withColumnRenamed("least", "box"), size), ["_cx", "_cy"]
    while True:
        over = [(F.floor(F.col(low) / size) < F.col(c)) & (F.floor(F.col(high) / size) > F.col(c)) for low, high, c in (("minx", "maxx", "_cx"), ("miny", "maxy", "_cy"))]
        placed = saved(cells.withColumn("whole", over[0] & over[1]), "cells")
        first = placed.where("whole").groupBy(*at).agg(F.min("box").alias("least"))
        whole = placed.where("whole").join(first, at)
        links.append(whole.where("box <> least").select(F.col("box").alias("a"), F.col("least").alias("b")))
        kept = placed.where("not whole").drop("whole").unionByName(whole.where("box = least").drop("whole", "least"))
        full = saved(kept.groupBy(*at).count().where(F.col("count") > crowded).select(*at), "crowded")
        links.append(kept.join(full, at, "left_anti").groupBy(*at).applyInPandas(_swept, "a long, b long"))
        if full.isEmpty() or size < 1e-6:
            if not full.isEmpty():
                links.append(kept.join(full, at, "left_semi").groupBy(*at).applyInPandas(_swept, "a long, b long"))
            break
        size /= SPLIT
        ranges = [F.sequence(F.greatest(F.floor(F.col(low) / size), F.col(c) * SPLIT), F.least(F.floor(F.col(high) / size), F.col(c) * SPLIT + SPLIT - 1)).alias(c) for low, high, c in (("minx", "maxx", "_cx"), ("miny", "maxy", "_cy"))]
        dealt = kept.join(full, at, "left_semi").select("box", *BOX, *ranges)
        cells = dealt.withColumn("_cx", F.explode("_cx")).withColumn("_cy", F.explode("_cy"))
    return reduce(DataFrame.unionByName, links)


def _swept(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of the boxes of a cell. For each least y of a box, that box of all so far which reaches furthest along x is held: whatever else reaches as far as the next box is linked to it."""
    rows = rows.sort_values(["minx", "box"])
    box, (minx, miny, maxx, maxy) = rows.box.to_numpy(), rows[list(BOX)].to_numpy(float).T
    ys = np.unique(miny)
    lows, highs = np.searchsorted(ys, miny), np.searchsorted(ys, maxy, "right")
    reach, holder = np.full(len(ys), -np.inf), np.zeros(len(ys), np.int64)
    ends: list[np.ndarray] = []
    for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
        far, held = reach[low:high], holder[low:high]
        others = np.unique(held[far >= minx[k]])
        ends.append(np.column_stack([np.full(len(others), box[k]), others]))
        longer = far < maxx[k]
        far[longer], held[longer] = maxx[k], box[k]
    return pd.DataFrame(np.concatenate(ends), columns=["a", "b"]).drop_duplicates()


def covering_cells(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """(key, east, north): lower left corners of all grid cells that a box touches."""
    return cells_of(boxes.select(key, *BOX), size).select(key, (F.col("_cx") * size).alias("east"), (F.col("_cy") * size).alias("north"))


def nearest_in_time(frames: DataFrame, samples: DataFrame, keys: list[str], t: str, sample_t: str, tolerance: float, tie: str, row_key: list[str]) -> DataFrame:
    """Each of ``frames`` with the sample nearest in time within ``tolerance``, the lowest ``tie`` of equals; else nulls.

    ``row_key`` tells the frames apart, nulls among them too; no other column is compared. Times are dealt out to slots of the tolerance; a frame looks into its own slot and both neighbours.
    """
    slot = F.floor(F.col(t) / tolerance)
    left = frames.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    right = samples.withColumn("_slot", F.floor(F.col(sample_t) / tolerance))
    kept = [c for c in right.columns if c not in (*keys, "_slot")]
    near = left.join(right, [*keys, "_slot"]).where(F.abs(F.col(t) - F.col(sample_t)) <= tolerance)
    picked = near.groupBy(*[F.col(k).alias(f"_key_{k}") for k in row_key]).agg(F.min_by(F.struct(*kept), F.struct(F.abs(F.col(t) - F.col(sample_t)), F.col(tie))).alias("_found"))
    joined = frames.join(picked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in row_key]), "left")
    return joined.select(*frames.columns, *[F.col("_found")[c].alias(c) for c in kept])


def apart_from(old: DataFrame, new: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Points (u, v) of ``old`` that no point of ``new`` with the same keys is within ``distance`` of."""
    x, y = F.floor(F.col("u") / distance), F.floor(F.col("v") / distance)
    around = F.array(*[F.struct((x + i).alias("_cx"), (y + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = new.select(*keys, F.col("u").alias("_u"), F.col("v").alias("_v"), F.inline(around))
    placed = old.withColumn("_cx", x).withColumn("_cy", y)
    near = reduce(lambda a, b: a & b, [placed[k] == dealt[k] for k in (*keys, "_cx", "_cy")])
    du, dv = placed["u"] - dealt["_u"], placed["v"] - dealt["_v"]
    return placed.join(dealt, near & (du * du + dv * dv <= distance * distance), "left_anti").drop("_cx", "_cy")


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, keys: list[str]) -> DataFrame:
    """Pairs that are each other's best by ``score``; of equals the lowest key is the best."""
    best_b = Window.partitionBy(*keys, a).orderBy(F.desc(score), b)
    best_a = Window.partitionBy(*keys, b).orderBy(F.desc(score), a)
    ranked = pairs.withColumn("_rb", F.row_number().over(best_b)).withColumn("_ra", F.row_number().over(best_a))
    return ranked.where("_ra = 1 and _rb = 1").drop("_ra", "_rb")


def ratio_test(pairs: DataFrame, a: str, b: str, distance: str, keys: list[str], ratio: float = 0.75) -> DataFrame:
    """The nearest partner of each ``a`` if it is nearer than ``ratio`` times the second; those with one partner go."""
    w = Window.partitionBy(*keys, a).orderBy(distance, b)
    ranked = pairs.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.lead(distance).over(w))
    return ranked.where((F.col("_n") == 1) & (F.col(distance) < ratio * F.col("_second"))).drop("_n", "_second")


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays of equal length; null if one has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
