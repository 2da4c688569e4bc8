"""Cameras as Columns: rays, footprints on the ground, projections, and the poses of other conventions.

A camera is a camera-to-world matrix (row-major array), a centre (three Columns) and fx, fy, cx, cy. All
functions give Columns, so a plan stays in generated code whatever the number of cameras.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import ecef_inverse, matrix_vector

#: How far in metres a corner of the view is placed that misses the ground, or meets it far off.
MAX_REACH = 2000.0


def pixel_ray(u: Column, v: Column, c2w: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """World direction through a pixel, not normalised: its depth along the optical axis is 1."""
    return matrix_vector(c2w, [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)])


def unit(v: list[Column]) -> list[Column]:
    n = F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))
    return [F.when(n > 0, c / n) for c in v]


def unprojected(u: Column, v: Column, depth: Column, c2w: Column, centre: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """World point of a pixel of that depth along the optical axis; zeros where the depth is not positive."""
    ray = pixel_ray(u, v, c2w, fx, fy, cx, cy)
    return [F.when(depth > 0, c + depth * r).otherwise(0.0) for c, r in zip(centre, ray, strict=True)]


def image_corners(width: Column, height: Column) -> list[tuple[Column, Column]]:
    zero = F.lit(0.0)
    return [(zero, zero), (width, zero), (width, height), (zero, height)]


def footprint_box(c2w: Column, centre: list[Column], width: Column, height: Column, k: list[Column], ground: Column, reach: float = 1000.0) -> list[Column]:
    """min_x, min_y, max_x, max_y of what the corners and the middle of the image see of a plane.

    A ray meets the plane at most ``reach`` away; those that run along the plane or away from it see nothing. If none
    sees it, the box is 100 metres around the camera.
    """
    points = []
    for u, v in [*image_corners(width, height), (width / 2, height / 2)]:
        d = unit(pixel_ray(u, v, c2w, *k))
        t = (ground - centre[2]) / d[2]
        seen = (F.abs(d[2]) >= 1e-6) & (t >= 0)
        points.append([F.when(seen, c + F.least(t, F.lit(reach)) * x) for c, x in zip(centre[:2], d[:2], strict=True)])
    low = [F.coalesce(F.least(*[p[i] for p in points]), centre[i] - 100) for i in (0, 1)]
    high = [F.coalesce(F.greatest(*[p[i] for p in points]), centre[i] + 100) for i in (0, 1)]
    return [*low, *high]


def frustum_corners(c2w: Column, centre: list[Column], width: Column, height: Column, k: list[Column], ground: Column) -> list[list[Column]]:
    """x and y on the ground of the four image corners, none further from the camera than MAX_REACH.

    A ray that misses the ground goes MAX_REACH along its direction on the map; one without such a direction
    has no corner.
    """
    return [ground_point(pixel_ray(u, v, c2w, *k), centre, ground) for u, v in image_corners(width, height)]


def ground_point(d: list[Column], centre: list[Column], ground: Column) -> list[Column]:
    """x and y where the direction ``d`` meets the ground, as frustum_corners() has it."""
    t = F.when(F.abs(d[2]) > 1e-6, (ground - centre[2]) / d[2])
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    slope = flat / F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    missed = t.isNull() | (t <= 0)
    far = F.when(missed, F.when(slope >= 1e-8, MAX_REACH / flat)).when(t * flat > MAX_REACH, MAX_REACH / flat).otherwise(t)
    return [centre[i] + far * d[i] for i in (0, 1)]


def camera_triangle(c2w: Column, centre: list[Column], size: float = 5.0) -> list[list[Column]]:
    """A triangle on the map: the camera, and two points ahead of it to the left and to the right.

    Ahead is the optical axis; where that points straight down, the image's x axis.
    """
    axis, side = [c2w[2], c2w[5]], [c2w[0], c2w[3]]
    n, m = (F.sqrt(a[0] * a[0] + a[1] * a[1]) for a in (axis, side))
    x, y = (F.when(n >= 1e-6, axis[i] / n).otherwise(F.when(m >= 1e-6, side[i] / m)) for i in (0, 1))
    left = [centre[0] + size * x - 0.6 * size * y, centre[1] + size * y + 0.6 * size * x]
    right = [centre[0] + size * x + 0.6 * size * y, centre[1] + size * y - 0.6 * size * x]
    return [centre[:2], left, right]


def ground_region(c2w: Column, centre: list[Column], width: Column, height: Column, k: list[Column], ground: Column, least: float = 100.0, most: float = 8000.0) -> Column:
    """Side of a square around the camera that holds what it sees of the ground, with a margin of 2.5.

    The camera is at least 10 metres up, and 200 if the height of the ground is unknown or below -100. A
    corner whose ray doesn't go down counts as ten times the height.
    """
    up = F.when(ground.isNull() | (ground < -100), 200.0).otherwise(F.greatest(centre[2] - ground, F.lit(10.0)))
    far = []
    for u, v in image_corners(width, height):
        d = pixel_ray(u, v, c2w, *k)
        far.append(F.when(d[2] >= -1e-6, 10 * up).otherwise(up / -d[2] * F.sqrt(d[0] * d[0] + d[1] * d[1])))
    return F.least(F.greatest(F.greatest(*far) * 2.5, F.lit(least)), F.lit(most))


def shifted_translation(w2c: Column, t: list[Column], offset: list[Column]) -> list[Column]:
    """Translation for points that ``offset`` has been taken from."""
    return [a + b for a, b in zip(matrix_vector(w2c, offset), t, strict=True)]


def euler_matrix(x: Column, y: Column, z: Column) -> Column:
    """Rotation matrix, row-major, of intrinsic turns by degrees about x, then the new y, then the new z."""
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in (x, y, z))
    return F.array(
        cy * cz, -cy * sz, sy,
        cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy,
        sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy,
    )


def local_rotation(m: Column, x: Column, y: Column, z: Column) -> Column:
    """``m``, a rotation to earth-centred axes, as one to east, north and up at the earth-centred point."""
    lat, lon, _ = ecef_inverse(x, y, z)
    (sp, cp), (sl, cl) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in (lat, lon))
    rows = ((-sl, cl, F.lit(0.0)), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp))
    return F.array(*[row[0] * m[c] + row[1] * m[3 + c] + row[2] * m[6 + c] for row in rows for c in range(3)])


def slerp(p: list[Column], q: list[Column], share: Column) -> list[Column]:
    """The unit quaternion ``share`` of the shorter way from ``p`` to ``q``, which are unit quaternions."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = F.sin(angle) < 1e-9
    a = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    b = sign * F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle))
    return [a * x + b * y for x, y in zip(p, q, strict=True)]


def normalised_to_pixel(value: Column, size: Column) -> Column:
    """Pixel of a coordinate from -1 to 1."""
    return (value + 1) / 2 * size


def neighbour_als_id(tile: Column) -> Column:
    """``als_33EEE-NNNN`` of the name ``3dm_33_EEE_NNNN_1_be``; null for other names."""
    form = r"^3dm_33_(\d+)_(\d+)_1_be"
    return F.when(tile.rlike(form), F.concat(F.lit("als_33"), F.regexp_extract(tile, form, 1), F.lit("-"), F.regexp_extract(tile, form, 2)))


def first_number(name: Column) -> Column:
    """The first run of digits in a file name without its folder and extension; null if there is none."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")
    found = F.regexp_extract(stem, r"\d+", 0)
    return F.when(found != "", found.cast("long"))
