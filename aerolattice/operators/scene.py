"""What a sequence's cameras and depths say of its scene: the box to cut from the maps, and how high the maps lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cameras as cam
from ..scratch import saved
from .joins import BOX, HEAVY, cells_of, heavy_keys, looked_up
from .quantiles import quantile

#: Metres: around the seen area for errors and for the crops of single frames, and the longest side of a box.
MARGIN, CROP_PADDING, LONGEST = 50.0, 150.0, 5000.0
#: Shares of the points' coordinates that a box reaches from and to, and depths that count, exclusive.
SHARES, DEPTHS = (0.005, 0.995), (0.0, 1e5)
#: Without depths the ground is taken to lie so far below the lowest camera.
BELOW_CAMERA = 100.0
#: Offsets in metres beyond which none is given, and heights of a map from which on they are.
MOST_OFFSET, LEAST_HEIGHT = 100.0, -1000.0


def scene_box(cameras: DataFrame, depths: DataFrame, width: float, height: float, k: list[Column], margin: float = MARGIN, padding: float = CROP_PADDING, longest: float | None = LONGEST) -> DataFrame:
    """One row minx, miny, maxx, maxy: what the cameras see, from points of known depth and the corners of the views.

    ``cameras``: cam, m0 to m8 (to the world, by rows), x, y, z; ``depths``: cam, u, v, depth (along a ray whose part along the axis is one). Points of
    depth reach from the 0.5th to the 99.5th percentile; the corners of all cameras that have depths, on the level of the
    points' median height or at most MAX_REACH away, count whole. Margin and padding are added; sides over ``longest`` are cut to half
    of it from the middle of the cameras. Without valid depths it is the cameras' own box with margin and padding; without cameras there is no row.
    Nulls and depths outside DEPTHS don't count.
    """
    turn, centre = F.array(*[F.col(f"m{i}") for i in range(9)]), [F.col(c) for c in "xyz"]
    frames = cameras.select("cam", turn.alias("turn"), *"xyz")
    pad = margin + padding
    own = frames.agg(*(f(c).alias(f"{name}{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max)))).first()
    spark = cameras.sparkSession
    schema = ", ".join(f"{c} double" for c in BOX)
    if own.minx is None:
        return spark.createDataFrame([], schema)
    valid = depths.where((F.col("depth") > DEPTHS[0]) & (F.col("depth") < DEPTHS[1])).select("cam", "u", "v", "depth")
    seen = frames.join(valid, "cam")
    points = saved(seen.select("cam", *[c.alias(f"p{a}") for c, a in zip(cam.unprojected(F.col("u"), F.col("v"), F.col("depth"), F.col("turn"), centre, *k), "xyz", strict=True)]), "scene-points")
    ground = quantile(points, "pz", 0.5)
    if ground is None:
        return spark.createDataFrame([(own.minx - pad, own.miny - pad, own.maxx + pad, own.maxy + pad)], schema)
    corners = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in cam.image_corners(F.lit(width), F.lit(height))])
    rays = frames.join(depths.select("cam").distinct(), "cam", "left_semi").select(*"xyz", "turn", F.inline(corners))
    rays = rays.select(*"xyz", *[c.alias(f"d{i}") for i, c in enumerate(cam.pixel_ray(F.col("u"), F.col("v"), F.col("turn"), *k))])
    placed = rays.select(*[c.alias(f"p{a}") for a, c in zip("xy", cam.ground_point([F.col(f"d{i}") for i in range(3)], centre, F.lit(ground)), strict=True)])
    reach = placed.agg(F.min("px").alias("minx"), F.min("py").alias("miny"), F.max("px").alias("maxx"), F.max("py").alias("maxy")).first()
    box = []
    for side, (axis, share, pick, sign) in zip(BOX, (("px", 0, min, -1), ("py", 0, min, -1), ("px", 1, max, 1), ("py", 1, max, 1)), strict=True):
        known = [x for x in (quantile(points, axis, SHARES[share]), reach[side]) if x is not None]
        box.append(pick(known) + sign * pad)
    if longest is not None and max(box[2] - box[0], box[3] - box[1]) > longest:
        for i, (low, high) in enumerate(((own.minx, own.maxx), (own.miny, own.maxy))):
            middle = (low + high) / 2
            box[i], box[i + 2] = max(box[i], middle - longest / 2), min(box[i + 2], middle + longest / 2)
    return spark.createDataFrame([tuple(map(float, box))], schema)


def height_offset(points: DataFrame, tiles: DataFrame, cells: DataFrame, size: float = 1000.0, heavy: int = HEAVY) -> DataFrame:
    """One row (offset, points): the median of how high ``points`` (x, y, z) lie above the map; null beyond MOST_OFFSET or without points.

    ``tiles``: tile, left, bottom, right, top, res; ``cells``: tile, row, col, z, the first row at the top. Of tiles that hold a point the
    first with a height over LEAST_HEIGHT at its cell counts. Points are dealt out to grid cells of ``size`` to find their tiles, then to raster cells; where
    one cell has ``heavy`` points or more, its tiles or height go to these, so that no task gets them all.
    """
    asked = points.select("x", "y", F.col("z").alias("pz")).where("x is not null and y is not null and pz is not null")
    asked = saved(asked.select("*", F.monotonically_increasing_id().alias("point"), *(F.floor(F.col(c) / size).alias(f"_c{c}") for c in "xy")), "offset-points")
    boxes = tiles.select("tile", "left", "top", "res", F.col("left").alias("minx"), F.col("bottom").alias("miny"), F.col("right").alias("maxx"), F.col("top").alias("maxy"))
    within = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    inside = looked_up(asked, cells_of(boxes, size), ["_cx", "_cy"], heavy_keys(asked, ["_cx", "_cy"], heavy)).where(within)
    row, col = (F.floor((F.col("top") - F.col("y")) / F.col("res")), F.floor((F.col("x") - F.col("left")) / F.col("res")))
    placed = saved(inside.select("point", "tile", "pz", row.cast("long").alias("row"), col.cast("long").alias("col")), "offset-places")
    heights = cells.select("tile", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z").where(F.col("z") > LEAST_HEIGHT)
    raster = ["tile", "row", "col"]
    first = looked_up(placed, heights, raster, heavy_keys(placed, raster, heavy)).groupBy("point").agg(F.min_by(F.col("pz") - F.col("z"), "tile").alias("offset"))
    found = saved(first.select("offset"), "offsets")
    offset = quantile(found, "offset", 0.5)
    told = None if offset is None or abs(offset) > MOST_OFFSET else offset
    return found.agg(F.lit(told).cast("double").alias("offset"), F.count("*").alias("points"))
