"""Poses, cameras, map projections and grids as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84: semi-major axis in metres and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST = 0.9996, 500000.0


def _sum(terms) -> Column:
    first, *rest = terms
    for t in rest:
        first = first + t
    return first


# --- errors -------------------------------------------------------------------------------------------


def position_error(est: list, gt: list) -> Column:
    """Euclidean distance of two points of any dimension; null if any coordinate is."""
    return F.sqrt(_sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(est, gt, strict=True)))


def angle_between(q: list, p: list) -> Column:
    """Degrees of the rotation between two quaternions of any length and sign; null for a zero one."""
    dot = _sum(F.col(a) * F.col(b) for a, b in zip(q, p, strict=True))
    norm = F.sqrt(_sum(F.col(a) * F.col(a) for a in q) * _sum(F.col(b) * F.col(b) for b in p))
    cosine = F.when(norm > 0, 2 * dot * dot / (norm * norm) - 1)
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))))


# --- rotations and poses ------------------------------------------------------------------------------


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation matrix of a quaternion, row-major; the quaternion is normalised, a zero one gives null."""
    n = w * w + x * x + y * y + z * z
    cells = (
        1 - 2 * (y * y + z * z) / n, 2 * (x * y - z * w) / n, 2 * (x * z + y * w) / n,
        2 * (x * y + z * w) / n, 1 - 2 * (x * x + z * z) / n, 2 * (y * z - x * w) / n,
        2 * (x * z - y * w) / n, 2 * (y * z + x * w) / n, 1 - 2 * (x * x + y * y) / n,
    )
    return F.when(n > 0, F.array(*cells))


def matrix_quaternion(m: Column) -> Column:
    """(w, x, y, z) of a row-major rotation matrix, from its largest component, with w >= 0."""
    t = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    rows = (
        (t[0], m[7] - m[5], m[2] - m[6], m[3] - m[1]),
        (m[7] - m[5], t[1], m[1] + m[3], m[2] + m[6]),
        (m[2] - m[6], m[1] + m[3], t[2], m[5] + m[7]),
        (m[3] - m[1], m[2] + m[6], m[5] + m[7], t[3]),
    )
    largest = F.greatest(*t)
    picked = F.when(t[0] == largest, F.array(*rows[0]))
    for k in (1, 2, 3):
        picked = picked.when(t[k] == largest, F.array(*rows[k]))
    scaled = F.transform(picked, lambda c: c / (2 * F.sqrt(largest)))
    return F.when(scaled[0] < 0, F.transform(scaled, lambda c: -c)).otherwise(scaled)


def matrix_vector(m: Column, v: list[Column], transposed: bool = False) -> list[Column]:
    at = (lambda r, c: m[3 * c + r]) if transposed else (lambda r, c: m[3 * r + c])
    return [_sum(at(r, c) * v[c] for c in range(3)) for r in range(3)]


def world_to_camera(c2w: Column, centre: list[Column]) -> list[Column]:
    """Translation of the world-to-camera transform: minus the transposed rotation times the centre."""
    return [-t for t in matrix_vector(c2w, centre, transposed=True)]


def camera_centre(w2c: Column, t: list[Column]) -> list[Column]:
    return [-c for c in matrix_vector(w2c, t, transposed=True)]


def euler_xyz(m: Column) -> list[Column]:
    """Roll, pitch and yaw in degrees of extrinsic turns about x, y, z."""
    return [F.degrees(F.atan2(m[7], m[8])), F.degrees(F.asin(F.greatest(F.least(-m[6], F.lit(1.0)), F.lit(-1.0)))), F.degrees(F.atan2(m[3], m[0]))]


# --- cameras ------------------------------------------------------------------------------------------


def focal_length(height: Column, fov_degrees: Column) -> Column:
    return height / (2 * F.tan(F.radians(fov_degrees) / 2))


def project(point: list[Column], m: Column, t: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Pixel and depth of a world point under world-to-camera ``m``, ``t``; null behind the camera."""
    x, y, z = (a + b for a, b in zip(matrix_vector(m, point), t, strict=True))
    return F.when(z > 0, fx * x / z + cx), F.when(z > 0, fy * y / z + cy), z


def ray_to_depth(distance: Column, col: Column, row: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Depth along the axis of a distance along the pixel's ray; 0 stays 0."""
    a, b = (col - cx) / fx, (row - cy) / fy
    return distance / F.sqrt(a * a + b * b + 1)


def view_reliability(pitch: Column) -> Column:
    """1 looking down, falling to 0.4 at 60 degrees from it and to 0 at the horizon."""
    off = 90 - F.abs(pitch)
    value = F.when(off <= 30, 1 - 0.2 * off / 30).when(off <= 60, 0.8 - 0.4 * (off - 30) / 30).otherwise(0.4 - 0.4 * (off - 60) / 30)
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def required_inliers(pitch: Column, base: int = 100) -> Column:
    return F.greatest(F.lit(30), F.floor(base * (0.3 + 0.7 * view_reliability(pitch))).cast("int"))


def downsample_size(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    scale = limit / F.greatest(width, height)
    fits = F.greatest(width, height) <= limit
    return tuple(F.when(fits, side.cast("int")).otherwise(F.floor(side * scale).cast("int")) for side in (width, height))


def pyramid_level(width: Column, height: Column) -> Column:
    reach = F.greatest(F.lit(84.0), 0.1 * F.greatest(width, height))
    return F.least(F.lit(7), F.greatest(F.lit(3), F.ceil(F.log2(reach / 10.5)).cast("int")))


def effective_pyramid_level(displacement: Column, base: Column) -> Column:
    level = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), 4 * displacement) / 10.5)).cast("int"))
    return F.when(displacement <= 0, base).otherwise(F.least(base, level))


# --- affine grids -------------------------------------------------------------------------------------


def pixel_to_map(col: Column, row: Column, min_x: Column, max_y: Column, res: Column) -> tuple[Column, Column]:
    return min_x + col * res, max_y - row * res


def map_to_pixel(x: Column, y: Column, min_x: Column, max_y: Column, res: Column) -> tuple[Column, Column]:
    return (x - min_x) / res, (max_y - y) / res


def toward_zero(value: Column) -> Column:
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")


def grid_origin(value: Column, size: float) -> Column:
    return F.floor(value / size) * size


def scaled(value: Column, scale: Column, offset: Column, kind: str) -> Column:
    """``minmax_11``: to -1..1, ``minmax_01``: to 0..1, ``mean_std``: standardised, else unchanged."""
    if kind == "minmax_11":
        return 2 * (value - offset) / scale - 1
    return (value - offset) / scale if kind in ("minmax_01", "mean_std") else value


def unscaled(value: Column, scale: Column, offset: Column, kind: str) -> Column:
    if kind == "minmax_11":
        return (value + 1) / 2 * scale + offset
    return value * scale + offset if kind in ("minmax_01", "mean_std") else value


# --- the ellipsoid ------------------------------------------------------------------------------------

_N = WGS84_F / (2 - WGS84_F)
_E2 = WGS84_F * (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Coefficients of the transverse Mercator series in the third flattening, to its fourth power.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def with_utm(df: DataFrame, lat: str, lon: str, zone: str, east: str = "east", north: str = "north") -> DataFrame:
    """``df`` with easting and northing on the northern hemisphere; each step is computed once, as a column."""
    phi, lam, e = F.radians(lat), F.radians(F.col(lon) - (6 * F.col(zone) - 183)), math.sqrt(_E2)
    xi, eta = F.col("_xi"), F.col("_eta")
    staged = df.withColumn("_t", F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))))
    staged = staged.withColumns({"_xi": F.atan2(F.col("_t"), F.cos(lam)), "_eta": F.asinh(F.sin(lam) / F.sqrt(F.col("_t") * F.col("_t") + F.cos(lam) * F.cos(lam)))})
    up = xi + _sum(a * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(_FORWARD))
    right = eta + _sum(a * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(_FORWARD))
    placed = staged.withColumns({east: UTM_EAST + UTM_SCALE * _RADIUS * right, north: UTM_SCALE * _RADIUS * up})
    return placed.drop("_t", "_xi", "_eta")


def with_latlon(df: DataFrame, east: str, north: str, zone: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with latitude and longitude in degrees; two steps of Newton's method from the conformal latitude."""
    xi, eta = F.col(north) / (UTM_SCALE * _RADIUS), (F.col(east) - UTM_EAST) / (UTM_SCALE * _RADIUS)
    staged = df.withColumns({"_xi": xi, "_eta": eta})
    xi, eta = F.col("_xi"), F.col("_eta")
    up = xi - _sum(b * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(_BACK))
    right = eta - _sum(b * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(_BACK))
    staged = staged.withColumns({"_up": up, "_right": right})
    up, right = F.col("_up"), F.col("_right")
    staged = staged.withColumn("_tau0", F.sin(up) / F.sqrt(F.sinh(right) * F.sinh(right) + F.cos(up) * F.cos(up))).withColumn("_tau", F.col("_tau0"))
    e, tau, now = math.sqrt(_E2), F.col("_tau"), F.col("_now")
    for _ in range(2):
        staged = staged.withColumn("_s", F.sinh(e * F.atanh(e * tau / F.sqrt(1 + tau * tau))))
        staged = staged.withColumn("_now", tau * F.sqrt(1 + F.col("_s") * F.col("_s")) - F.col("_s") * F.sqrt(1 + tau * tau))
        slope = F.sqrt(1 + now * now) * F.sqrt(1 + tau * tau) * (1 - _E2) / (1 + (1 - _E2) * tau * tau)
        staged = staged.withColumn("_tau", tau + (F.col("_tau0") - now) / slope)
    placed = staged.withColumns({lat: F.degrees(F.atan(tau)), lon: F.degrees(F.atan2(F.sinh(right), F.cos(up))) + 6 * F.col(zone) - 183})
    return placed.drop("_xi", "_eta", "_up", "_right", "_tau0", "_tau", "_s", "_now")


def ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - _E2) + height) * F.sin(phi)


def ecef_inverse(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height by the closed form with one parametric latitude; good to a millimetre."""
    p, b = F.sqrt(x * x + y * y), WGS84_A * (1 - WGS84_F)
    theta = F.atan2(z * WGS84_A, p * b)
    second = (WGS84_A * WGS84_A - b * b) / (b * b)
    phi = F.atan2(z + second * b * F.pow(F.sin(theta), 3), p - _E2 * WGS84_A * F.pow(F.cos(theta), 3))
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(phi) * F.sin(phi))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), p / F.cos(phi) - n


# --- tile names ---------------------------------------------------------------------------------------

#: Forms of tile names, each with east and north in kilometres.
TILE_FORMS = (r"\d{2}(\d{3})-(\d{4})", r"_33_(\d{3})_(\d{4})", r"_(\d{3})_(\d{4})$", r"^(\d{3})_(\d{4})", r"^32(\d+)_(\d+)(?:_|$)", r"^(?!32_)(\d+)_(\d+)(?:_|$)")
#: What tile names may end in besides, in the order in which it is taken out.
TILE_SUFFIXES = ("_20_DOM", "_DOM", "_DSM")


def tile_origin(name: Column) -> tuple[Column, Column]:
    """Lower left corner in metres of the kilometre tile that ``name`` (without extension) names; else null."""
    east = north = F.lit(None).cast("string")
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")
    for suffix in TILE_SUFFIXES:
        stem = F.replace(stem, F.lit(suffix), F.lit(""))
    for form in reversed(TILE_FORMS):
        east = F.when(stem.rlike(form), F.regexp_extract(stem, form, 1)).otherwise(east)
        north = F.when(stem.rlike(form), F.regexp_extract(stem, form, 2)).otherwise(north)
    return east.cast("long") * 1000, north.cast("long") * 1000


def kilometre(value: Column) -> Column:
    return F.floor(value / 1000).cast("long")


def tile_id(east: Column, north: Column, form: str) -> Column:
    """``dop``: 33EEE-NNNN, ``als``: 3dm_33_EEE_NNNN_1_be, ``lod``: LoD2_EEE_NNNN."""
    e, n = kilometre(east).cast("string"), kilometre(north).cast("string")
    parts = {"dop": ("33", e, "-", n), "als": ("3dm_33_", e, "_", n, "_1_be"), "lod": ("LoD2_", e, "_", n)}[form]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- the keyframe rule --------------------------------------------------------------------------------


def keyframe_reason(
    tracked: Column, since: Column, min_points: int = 100, initial: Column | None = None, error: Column | None = None, baseline: Column | None = None, spread: tuple[Column, Column, Column] | None = None,
    min_interval: int = 5, max_interval: int = 0, growth: float = 2.0, absolute: float = 2.0, grace: int = 15, drop: float = 0.4, collapse: float = 30.0, decay: int = 100, margin: float = 0.35,
) -> Column:
    """Why a frame becomes a keyframe, by the first rule that holds; empty if none does.

    ``max_interval``, if any, holds even before the minimum interval. Then: fewer points than ``min_points``; fewer than
    ``drop`` of the keyframe's and than three times ``min_points``; ten points or more (``spread`` has their number and
    standard deviations in x and y) that lie within ``collapse``; an error beyond ``absolute``, or beyond the
    keyframe's where that is larger, both looser in the first ``grace`` frames; and after these an error that has
    grown beyond the keyframe's by a factor that falls from ``growth`` to 1 + ``margin`` over ``decay`` frames.
    """
    none = F.lit("")
    reason = F.when(since >= max_interval, "max_interval") if max_interval > 0 else F.when(F.lit(False), none)
    reason = reason.when(since < min_interval, none).when(tracked < min_points, "low_points")
    if initial is not None:
        reason = reason.when((initial > 0) & (tracked < drop * initial) & (tracked < 3 * min_points), "point_drop")
    if spread is not None:
        n, x, y = spread
        reason = reason.when((n >= 10) & ((x < collapse) | (y < collapse)), "spatial_collapse")
    if error is not None:
        slack = 2 * F.greatest(F.lit(0.0), 1 - since / grace)
        known = F.coalesce(baseline, F.lit(0.0)) if baseline is not None else F.lit(0.0)
        limit = F.when((known > 0) & (known > absolute + slack), known + slack).otherwise(absolute + slack)
        reason = reason.when(error > limit, "reproj_abs")
        if baseline is not None:
            gone = F.least(F.lit(1.0), (since - grace) / decay)
            factor = 1 + (growth - 1) * (1 - gone) + margin * gone
            reason = reason.when((known > 0) & (since >= grace) & (error > known * factor), "reproj_growth")
    return reason.otherwise(none)
