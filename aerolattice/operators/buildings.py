"""Buildings from the parts of meshes: what touches is one, and small pieces go to the nearest large one."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saved
from .mesh import components

#: Labels of faces that make a part a building's.
BUILDING = ("wall", "roof", "ground", "closure", "building")
#: Metres between vertices of parts that belong together; faces of a small piece, below, and metres to the middle of the building that takes it in.
REACH, SMALL, ABSORBED_WITHIN = 1.0, 20, 5.0
XYZ = ("x", "y", "z")


def _cell(size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"c{c}") for c in XYZ]


def _around(reach: int, forward: bool) -> Column:
    """Moves of up to ``reach`` cells along each axis, as an array; ``forward``: only one of each two that undo each other, and not none."""
    moves = [m for m in product(range(-reach, reach + 1), repeat=3) if not forward or m > (0, 0, 0)]
    return F.array(*[F.struct(*((F.col(f"c{c}") + k).alias(f"n{c}") for c, k in zip(XYZ, m, strict=True))) for m in moves])


def _square() -> Column:
    return sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in XYZ[1:]), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))


def merged_parts(faces: DataFrame, vertices: DataFrame, reach: float = REACH, small: int = SMALL, absorbed_within: float = ABSORBED_WITHIN) -> DataFrame:
    """(f, building) of ``faces`` (f, a, b, c, label, part) whose parts are merged into buildings.

    Parts with a face labelled as in BUILDING belong together if vertices of theirs are at most ``reach`` apart, directly or through others. Then such
    groups of fewer than ``small`` faces go to the nearest larger group whose vertices' middle is at most ``absorbed_within`` from theirs, the least of equals. A building is
    named by the least part of its (larger) group; parts of no building keep their own name. ``vertices``: v, x, y, z.

    Vertices meet in grid cells whose diagonal is the reach: all parts in one cell belong together, so each is linked to the least of them
    instead of to all, and only vertices of neighbouring cells are compared.
    """
    own = saved(faces.select("f", "a", "b", "c", F.col("part").cast("long").alias("part"), F.coalesce(F.col("label").isin(*BUILDING), F.lit(False)).alias("is_building")), "faces")
    parts = own.groupBy("part").agg(F.count("*").alias("faces"), F.max("is_building").alias("is_building"))
    of_building = parts.where("is_building").select("part", "faces")
    corners = own.join(of_building, "part", "left_semi").select("part", F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    placed = saved(corners.join(vertices.select("v", *XYZ).dropna(), "v").select("part", *XYZ, *_cell(reach / 3**0.5 * (1 - 1e-9))), "corners")
    cell = [f"c{c}" for c in XYZ]
    least = placed.groupBy(*cell).agg(F.min("part").alias("least"))
    inside = placed.join(least, cell).where("part <> least").select(F.col("part").alias("a"), F.col("least").alias("b"))
    points = placed.select(*XYZ, *cell).distinct().join(least, cell)
    moved = points.select(*XYZ, F.col("least").alias("one"), F.inline(_around(2, forward=True)))
    others = points.select(*(F.col(f"c{c}").alias(f"n{c}") for c in XYZ), *(F.col(c).alias(f"o{c}") for c in XYZ), F.col("least").alias("other"))
    across = moved.join(others, [f"n{c}" for c in XYZ]).where((F.col("one") != F.col("other")) & (_square() <= reach * reach)).select(F.col("one").alias("a"), F.col("other").alias("b"))
    joined = components(inside.union(across).distinct()).select(F.col("node").alias("part"), "component")
    group_of = saved(of_building.join(joined, "part", "left").select("part", "faces", F.coalesce("component", "part").alias("group")), "groups")

    middles = placed.join(group_of.select("part", "group"), "part").groupBy("group").agg(*(F.avg(c).alias(c) for c in XYZ))
    groups = saved(group_of.groupBy("group").agg(F.sum("faces").alias("faces")).join(middles, "group").select("group", "faces", *XYZ, *_cell(absorbed_within)), "middles")
    pieces = groups.where(F.col("faces") < small).select("group", *XYZ, F.inline(_around(1, forward=False)))
    large = groups.where(F.col("faces") >= small).select(F.col("group").alias("large"), *(F.col(c).alias(f"o{c}") for c in XYZ), *(F.col(f"c{c}").alias(f"n{c}") for c in XYZ))
    near = pieces.join(large, [f"n{c}" for c in XYZ]).withColumn("far", _square()).where(F.col("far") <= absorbed_within * absorbed_within)
    taken = near.groupBy("group").agg(F.min_by("large", F.struct("far", "large")).alias("large"))
    named = group_of.join(taken, "group", "left").select("part", F.coalesce("large", "group").alias("building"))
    return own.select("f", "part").join(named, "part", "left").select("f", F.coalesce("building", "part").alias("building"))
