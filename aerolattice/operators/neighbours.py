"""The rows nearest by angle to each of many queries, exactly, through grid cells instead of all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from .joins import cosine


def _unit(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def _has_length(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0


def nearest_by_angle(points: DataFrame, queries: DataFrame, k: int = 5, size: float | None = None) -> DataFrame:
    """(q, n, k): the ``k`` rows of ``points`` (n, v) of greatest cosine to each of ``queries`` (q, v), the least n of equals, without the row n = q.

    ``v`` are four doubles. Directions are dealt out to cells of the unit sphere, so all that are at most a cell's ``size`` apart are in neighbouring cells; a query
    that has found k + 1 rows as near as that is done, and the others go on with cells of twice the size, in the end with all rows. Equal
    vectors are asked for once, and k + 1 of them stand for all. Vectors without length are left out.
    """
    first = Window.partitionBy("v").orderBy("n")
    index = saved(points.select("n", "v").where(_has_length("v")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("n", "v", _unit("v").alias("u")), "directions")
    asked = saved(queries.select("q", "v").where(_has_length("v")), "asked")
    distinct = saved(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("w"), "v", _unit("v").alias("u")), "asked-vectors")
    size = min(2.0, size or (22 / max(index.count(), 1)) ** (1 / 3) / 2)
    left, found, cells = distinct, [], [f"c{i}" for i in range(4)]
    best = Window.partitionBy("w").orderBy(F.desc("c"), "n")
    while True:
        at = [F.floor(F.col("u")[i] / size) for i in range(4)]
        held = index.select("n", F.col("v").alias("b"), *[c.alias(name) for c, name in zip(at, cells, strict=True)])
        around = left.select("w", F.col("v").alias("a"), *[F.array(c - 1, c, c + 1).alias(name) for c, name in zip(at, cells, strict=True)])
        for name in cells:
            around = around.withColumn(name, F.explode(name))
        near = around.join(held, cells).select("w", "n", cosine("a", "b").alias("c"))
        top = saved(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("w", "n", "c"), "nearest")
        if size >= 2:
            found.append(top)
            break
        done = top.groupBy("w").agg(F.count("*").alias("rows"), F.min("c").alias("least")).where((F.col("rows") > k) & (F.col("least") >= 1 - size * size / 2 + 1e-9)).select("w")
        found.append(top.join(done, "w", "left_semi"))
        left = saved(left.join(done, "w", "left_anti"), "asked-vectors")
        if left.isEmpty():
            break
        size = min(2.0, size * 2)
    each = reduce(DataFrame.unionByName, found).join(distinct.select("w", "v"), "w").join(asked, "v").where("q <> n")
    return each.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "n")).cast("long")).where(F.col("k") <= k).select("q", "n", "k")
