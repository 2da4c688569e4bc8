"""Camera poses and focal lengths from correspondences of pixels and world points.

Each frame's correspondences are one group, a few thousand rows from a matcher. Many samples of three points, and several focal
lengths, are solved at once as arrays; the pose that most points agree with is refined by damped Gauss-Newton steps over
all of these, with the focal length as one more unknown where it is to be calibrated. Poses of several focal lengths take their steps together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples that are solved at once.
SAMPLES = 64
#: Points on which all poses are judged first, and how many of the best are then judged on all points.
PREVIEW, CALLED = 128, 8
#: Projections that are reckoned at once.
TOGETHER = 1 << 14
#: Chance that a sample without a wrong point was among those drawn.
SURE = 0.9999
#: Correspondences at least and inliers at least of a frame; above ground, in metres, the camera may be from and to.
LEAST, ABOVE_GROUND = 30, (1.0, 2000.0)
#: Calibration: vertical angles of view in degrees, inliers of an angle and of a refinement at least, and how far the latter may go.
ANGLES, LEAST_OF_ANGLE, LEAST_TO_REFINE, REFINED_BY = tuple(range(12, 91)), 15, 50, 0.08
#: Of these angles every one is sampled whose focal length is about this far from the last one's; those between the neighbours of the best one start from its pose.
COARSE = 1.2
#: Share of the squared distances by which a step has to lower them for an angle to be refined further.
SETTLED = 1e-6
#: Arrow's types of the fields that are found.
ARROW = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
POSE_COLUMNS = ["x", "y", "z", "rotation", "inliers", "error"]


class Pose(NamedTuple):
    """World to camera: ``turn`` @ point + ``shift``; focal length in pixels."""

    turn: np.ndarray
    shift: np.ndarray
    focal: float

    @property
    def centre(self) -> np.ndarray:
        return -self.turn.T @ self.shift


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By rows; numpy's own takes longer on few of them."""
    return a[:, [1, 2, 0]] * b[:, [2, 0, 1]] - a[:, [2, 0, 1]] * b[:, [1, 2, 0]]


def quartic_roots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The real roots of quartics x^4 + c0 x^3 + c1 x^2 + c2 x + c3 by rows: four a row, and which of them are real, to about 1e-3.

    By a root of the cubic resolvent, then two steps of Newton's method on the quartic.
    """
    with np.errstate(all="ignore"):
        k = c[:, 0] / 4
        p, q = c[:, 1] - 6 * k * k, c[:, 2] - 2 * c[:, 1] * k + 8 * k**3
        r = c[:, 3] - c[:, 2] * k + c[:, 1] * k * k - 3 * k**4
        # m^3 + p m^2 + (p^2 / 4 - r) m - q^2 / 8 has a root that isn't negative: the largest
        lean, fall = -p * p / 12 - r, -(p**3) / 108 + p * r / 3 - q * q / 8
        inside = fall * fall / 4 + lean**3 / 27
        side = np.sqrt(np.maximum(inside, 0))
        far = np.cbrt(-fall / 2 - np.copysign(side, fall))
        alone = np.where(far == 0, 0.0, far - lean / (3 * np.where(far == 0, 1.0, far)))
        length = np.sqrt(np.maximum(-lean / 3, 0))
        three = 2 * length * np.cos(np.arccos(np.clip(np.where(length > 0, 3 * fall / (2 * lean * length), 0.0), -1, 1)) / 3)
        m = np.maximum(np.where(inside > 0, alone, three) - p / 3, 0)
        # without a linear term the quartic is one in squares
        flat = m <= 1e-12 * (1 + np.abs(p))
        s = np.sqrt(2 * np.where(flat, 1.0, m))
        under = np.stack([-(2 * p + 2 * m + 2 * q / s), -(2 * p + 2 * m - 2 * q / s)], axis=1)
        middle = np.stack([s, -s], axis=1) / 2
        if flat.any():
            square = np.sqrt(np.maximum(p * p / 4 - r, 0))
            under[flat], middle[flat] = 4 * np.stack([-p / 2 + square, -p / 2 - square], axis=1)[flat], 0.0
        real, half = under > -4e-6, np.sqrt(np.maximum(under, 0)) / 2
        x = np.concatenate([middle + half, middle - half], axis=1) - k[:, None]
        for _ in range(2):
            value = (((x + c[:, :1]) * x + c[:, 1:2]) * x + c[:, 2:3]) * x + c[:, 3:]
            slope = ((4 * x + 3 * c[:, :1]) * x + 2 * c[:, 1:2]) * x + c[:, 2:3]
            step = value / slope
            x = np.where(np.abs(step) < 0.1 * (1e-3 + np.abs(x)), x - step, x)
        return x, np.concatenate([real, real], axis=1) & np.isfinite(x)


def three_point_poses(rays: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All poses (turns, shifts) that put three world points each on their rays: (n, 3, 3) both, rays of length one."""
    return poses_of_samples(rays, points)[:2]


def poses_of_samples(rays: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """three_point_poses(), and the row of the sample that each pose is of.

    By the law of cosines the ratio of two distances is a root of a quartic; up to four poses a sample.
    """
    rays, points = (np.ascontiguousarray(x.transpose(1, 2, 0)) for x in (rays, points))  # by point and coordinate
    a2, b2, c2 = (((points[i] - points[j]) ** 2).sum(0) for i, j in ((1, 2), (0, 2), (0, 1)))
    ca, cb, cg = ((rays[i] * rays[j]).sum(0) for i, j in ((1, 2), (0, 2), (0, 1)))
    usable = (a2 > 1e-12) & (b2 > 1e-12) & (c2 > 1e-12)
    b2 = np.where(usable, b2, 1.0)
    p, q, r = (a2 - c2) / b2, (a2 + c2) / b2, c2 / b2
    s = a2 / b2
    quartic = np.stack(
        [
            (p - 1) ** 2 - 4 * r * ca**2,
            4 * (p * (1 - p) * cb - (1 - q) * ca * cg + 2 * r * ca**2 * cb),
            2 * (p**2 - 1 + 2 * p**2 * cb**2 + 2 * (1 - r) * ca**2 - 4 * q * ca * cb * cg + 2 * (1 - s) * cg**2),
            4 * (-p * (1 + p) * cb + 2 * s * cg**2 * cb - (1 - q) * ca * cg),
            (1 + p) ** 2 - 4 * s * cg**2,
        ],
        axis=1,
    )
    usable &= np.abs(quartic[:, 0]) > 1e-12
    quartic[~usable, 0] = 1.0
    roots, real = quartic_roots(quartic[:, 1:] / quartic[:, :1])
    sample, which = np.nonzero(real & (roots > 1e-9) & usable[:, None])
    v = roots[sample, which]
    pk, ck, bk, gk = p[sample], ca[sample], cb[sample], cg[sample]
    below = 2 * (gk - v * ck)
    u = ((pk - 1) * v**2 - 2 * pk * bk * v + 1 + pk) / np.where(np.abs(below) > 1e-12, below, np.nan)
    first = np.sqrt(b2[sample] / (1 + v**2 - 2 * v * bk))
    good = np.isfinite(first) & (u > 0)
    sample, first, u, v = sample[good], first[good], u[good], v[good]
    seen = rays[:, :, sample] * np.stack([first, u * first, v * first])[:, None]
    there = points[:, :, sample]

    def axes(of: np.ndarray) -> np.ndarray:
        along, other = of[1] - of[0], of[2] - of[0]
        normal = cross(along.T, other.T).T
        with np.errstate(invalid="ignore", divide="ignore"):
            along, normal = along / np.sqrt((along * along).sum(0)), normal / np.sqrt((normal * normal).sum(0))
        return np.stack([along, cross(normal.T, along.T).T, normal])

    turns = np.einsum("kin,kjn->nij", axes(seen), axes(there))
    shifts = seen[0].T - (turns @ there[0].T[:, :, None])[:, :, 0]
    fine = np.isfinite(turns).all(axis=(1, 2))
    return turns[fine], shifts[fine], sample[fine]


def projection_errors(turns: np.ndarray, shifts: np.ndarray, pixels: np.ndarray, points: np.ndarray, focal: float | np.ndarray) -> np.ndarray:
    """Distances in pixels from the centre for each pose and point; infinite behind the camera. Focal lengths of the poses are a column."""
    seen = points @ turns.transpose(0, 2, 1) + shifts[:, None]
    ahead = seen[..., 2] > 1e-9
    scale = focal / np.where(ahead, seen[..., 2], 1.0)
    across, down = seen[..., 0] * scale - pixels[:, 0], seen[..., 1] * scale - pixels[:, 1]
    return np.where(ahead, np.sqrt(across * across + down * down), np.inf)


def _near(turns: np.ndarray, shifts: np.ndarray, pixels: np.ndarray, points: np.ndarray, focals: np.ndarray, thresholds: np.ndarray, kind: type = float) -> np.ndarray:
    """Whether each point is ahead of each pose and projected within its threshold; reckoned in numbers of ``kind``, for some poses at a time as arrays."""
    whole, (us, vs) = np.concatenate([points.T, np.ones((1, len(points)))]).astype(kind), pixels.T.astype(kind)
    placed = np.concatenate([turns, shifts[:, :, None]], axis=2)
    x, y, z = ((placed[:, k] * (focals[:, None] if k < 2 else 1)).astype(kind) for k in range(3))
    found, rows = np.empty((len(turns), len(points)), bool), TOGETHER // len(points) + 1
    for k in range(0, len(turns), rows):
        some = slice(k, k + rows)
        away, across, down = z[some] @ whole, x[some] @ whole, y[some] @ whole
        across -= us * away
        down -= vs * away
        across *= across
        down *= down
        across += down
        within = away * thresholds[some, None].astype(kind)
        within *= within
        np.logical_and(across < within, away > 1e-9, out=found[some])
    return found


def _triples(n: int, of: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` rows of three different numbers below ``of``."""
    first, second, third = (rng.integers(0, of - k, n) for k in range(3))
    second += second >= first
    third += third >= np.minimum(first, second)
    third += third >= np.maximum(first, second)
    return np.column_stack([first, second, third])


def sampled_poses(pixels: np.ndarray, points: np.ndarray, focals: np.ndarray, thresholds: np.ndarray, rounds: int, rng: np.random.Generator, share: float = 0.0) -> list[tuple[Pose | None, np.ndarray]]:
    """For each of ``focals`` the pose with most points within its threshold in pixels, and which these are.

    Rounds end when, at the greatest share of inliers found, some sample of each focal length was free of wrong points with SURE; or after ``rounds`` samples of each. Where only
    a pose of a ``share`` of inliers or more is of use, they end when that would have been found.
    """

    def enough(part: float) -> float:
        return min(rounds, np.log(1 - SURE) / np.log1p(-min(part**3, 1 - 1e-12))) if part else rounds

    rays = np.concatenate([pixels[None] / focals[:, None, None], np.ones((len(focals), len(pixels), 1))], axis=2)
    rays /= np.sqrt((rays * rays).sum(2, keepdims=True))
    best: list[Pose | None] = [None] * len(focals)
    most, drawn, needed = np.zeros((len(focals), len(pixels)), bool), 0, enough(share)
    preview = rng.permutation(len(pixels))[:PREVIEW]
    while drawn < needed and len(pixels) > 2:
        n = int(min(SAMPLES, rounds - drawn)) or 1
        of, some = np.repeat(np.arange(len(focals)), n), _triples(n * len(focals), len(pixels), rng)
        drawn += n
        turns, shifts, sample = poses_of_samples(rays[of[:, None], some], points[some])
        if not len(turns):
            continue
        of = of[sample]
        if len(pixels) > 2 * PREVIEW:
            seen = _near(turns, shifts, pixels[preview], points[preview], focals[of], thresholds[of], np.float32).sum(1)
            order = np.lexsort((-seen, of))
            called = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < CALLED]
            turns, shifts, of = turns[called], shifts[called], of[called]
        near = _near(turns, shifts, pixels, points, focals[of], thresholds[of])
        counts = near.sum(1)
        order = np.lexsort((-counts, of))
        for k in order[np.unique(of[order], return_index=True)[1]]:
            if counts[k] > most[of[k]].sum():
                best[of[k]], most[of[k]] = Pose(turns[k], shifts[k], float(focals[of[k]])), near[k]
        needed = enough(max(share, most.sum(1).max() / len(pixels)))
    return list(zip(best, most, strict=True))


def sampled_pose(pixels: np.ndarray, points: np.ndarray, focal: float, threshold: float, rounds: int, rng: np.random.Generator, share: float = 0.0) -> tuple[Pose | None, np.ndarray]:
    """sampled_poses() of one focal length."""
    return sampled_poses(pixels, points, np.array([focal], float), np.array([threshold], float), rounds, rng, share)[0]


_EYE = np.eye(3)
#: Rows of the matrices that make cross products with each axis.
_CROSS = np.array([[0, 0, 0, 0, 0, -1, 0, 1, 0], [0, 0, 1, 0, 0, 0, -1, 0, 0], [0, -1, 0, 1, 0, 0, 0, 0, 0]], float)


def turn_by(w: np.ndarray) -> np.ndarray:
    """The rotation about ``w`` by its length, or one for each row."""
    square = (w * w).sum(-1)[..., None, None]
    angle = np.sqrt(np.maximum(square, 1e-24))
    half = np.sin(angle / 2) / angle
    outer = w[..., :, None] * w[..., None, :]
    return _EYE + np.sin(angle) / angle * (w @ _CROSS).reshape(*w.shape, 3) + 2 * half * half * (outer - square * _EYE)


def refined_poses(poses: list[Pose], pixels: np.ndarray, points: np.ndarray, inliers: np.ndarray, with_focal: bool = False, steps: int = 50, settled: float = 1e-12) -> list[Pose]:
    """For each of ``poses`` the one of least squared distances in pixels over its ``inliers`` (by rows), by Gauss-Newton steps damped until each one helps.

    Unknown are a shift and a turn after the camera's own, and the logarithm of the focal length if ``with_focal``. Steps end after one that lowers the sum by no more than ``settled`` of it.
    """
    counts = inliers.sum(1)
    some = np.argsort(~inliers, axis=1, kind="stable")[:, : counts.max()]
    weight = (np.arange(some.shape[1]) < counts[:, None]).astype(float)
    some = np.where(weight > 0, some, some[:, :1])
    there, wanted = points[some].transpose(0, 2, 1), pixels[some].transpose(0, 2, 1)
    turns, shifts, focals = np.stack([p.turn for p in poses]), np.stack([p.shift for p in poses]), np.array([p.focal for p in poses], float)

    unknown = np.arange(6 + with_focal)

    def residuals(k: np.ndarray, turns: np.ndarray, shifts: np.ndarray, focals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gaps in pixels, coordinates in units of depth, one over depth, and the sum of squared gaps; infinite if a point is behind."""
        seen = turns @ there[k] + shifts[:, :, None]
        inverse = 1 / seen[:, 2]
        flat = seen[:, :2] * inverse[:, None]
        gap = (flat * focals[:, None, None] - wanted[k]) * weight[k, None]
        return gap, flat, inverse, np.where((inverse > 0).all(1), (gap * gap).sum((1, 2)), np.inf)

    gaps, flats, inverses, costs = residuals(np.arange(len(poses)), turns, shifts, focals)
    damping, taken, going = np.full(len(poses), 1e-3), np.zeros(len(poses), int), np.full(len(poses), steps > 0)
    square, pull = np.zeros((len(poses), len(unknown), len(unknown))), np.zeros((len(poses), len(unknown)))
    fresh = np.ones(len(poses), bool)
    while going.any():
        k = np.flatnonzero(going & fresh)
        if len(k):
            x, y, focal = flats[k, 0], flats[k, 1], focals[k, None] * weight[k]
            fx, fy, scale = focal * x, focal * y, focal * inverses[k]
            slope = np.zeros((len(k), len(unknown) + 1, 2, x.shape[1]))  # by shift, turn and focal length, and the gaps
            slope[:, 0, 0] = slope[:, 1, 1] = scale
            slope[:, 2, 0], slope[:, 2, 1] = -scale * x, -scale * y
            slope[:, 4, 1] = fx * y
            slope[:, 3, 0] = -slope[:, 4, 1]
            slope[:, 3, 1], slope[:, 4, 0] = -focal - fy * y, focal + fx * x
            slope[:, 5, 0], slope[:, 5, 1] = -fy, fx
            if with_focal:
                slope[:, 6, 0], slope[:, 6, 1] = fx, fy
            slope[:, -1] = gaps[k]
            slope = slope.reshape(len(k), len(unknown) + 1, -1)
            products = slope @ slope.transpose(0, 2, 1)
            square[k], pull[k], fresh[k] = products[:, :-1, :-1], products[:, :-1, -1], False
        k = np.flatnonzero(going)
        damped = square[k]
        damped[:, unknown, unknown] += damping[k, None] * (damped[:, unknown, unknown] + 1e-12)
        try:
            step = -np.linalg.solve(damped, pull[k][:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            step = np.full((len(k), len(unknown)), np.nan)
            for i in range(len(k)):
                try:
                    step[i] = -np.linalg.solve(damped[i], pull[k[i]])
                except np.linalg.LinAlgError:
                    pass
        turn = turn_by(step[:, 3:6])
        new = turn @ turns[k], (turn @ shifts[k][:, :, None])[:, :, 0] + step[:, :3], focals[k] * np.exp(np.clip(step[:, 6], -1, 1)) if with_focal else focals[k]
        with np.errstate(all="ignore"):
            now = (*new, *residuals(k, *new))
            old, cost = costs[k], now[-1]
            better = (cost <= old) & (cost < np.inf)
            done = (old - cost <= settled * old + 1e-20) & (old < np.inf)
        damping[k] = np.where(better, np.maximum(damping[k] / 10, 1e-12), damping[k] * 10)
        to = k[better]
        for kept, found in zip((turns, shifts, focals, gaps, flats, inverses, costs), now, strict=True):
            kept[to] = found if len(to) == len(k) else found[better]
        taken[to] += 1
        fresh[to] = True
        going[k] = np.where(better, ~done & (taken[k] < steps), damping[k] < 1e12)
    return [Pose(*p[:2], float(p[2])) for p in zip(turns, shifts, focals, strict=True)]


def refined_pose(pose: Pose, pixels: np.ndarray, points: np.ndarray, with_focal: bool = False, steps: int = 50) -> Pose:
    """refined_poses() of one pose and all of ``points``."""
    return refined_poses([pose], pixels, points, np.ones((1, len(points)), bool), with_focal, steps)[0]


def fitted_pose(pixels: np.ndarray, points: np.ndarray, focal: float, threshold: float, rounds: int, rng: np.random.Generator) -> tuple[Pose | None, np.ndarray]:
    """sampled_pose(), refined on its inliers; these are counted anew while more points join."""
    pose, inliers = sampled_pose(pixels, points, focal, threshold, rounds, rng)
    for _ in range(5 if pose is not None and inliers.sum() >= 4 else 0):
        better = refined_pose(pose, pixels[inliers], points[inliers])
        near = projection_errors(better.turn[None], better.shift[None], pixels, points, focal)[0] < threshold
        if near.sum() < inliers.sum():
            break
        same = (near == inliers).all()
        pose, inliers = better, near
        if same:
            break
    return pose, inliers


def _focal(height: float, angle: float) -> float:
    return height / 2 / np.tan(np.radians(angle) / 2)


@cache
def _coarse_angles(height: float) -> list[int]:
    found = [ANGLES[0]]
    for angle, after in zip(ANGLES[1:], (*ANGLES[2:], None), strict=True):
        if after is None or _focal(height, found[-1]) / _focal(height, after) > COARSE:
            found.append(angle)
    return found


def calibrated(pixels: np.ndarray, points: np.ndarray, height: float, threshold: float, rounds: int, rng: np.random.Generator) -> tuple[Pose | None, np.ndarray, float]:
    """Pose with the focal length that fits best, its inliers and their error; pixels are from the image's centre.

    Angles of view are tried with a threshold of the same angle: first those a factor of COARSE apart in focal length, each by samples, then all between the
    neighbours of the best one, from its pose. Inliers are counted at ``threshold`` pixels; the angle of the
    greatest product of inliers, as a share of the most, and of one minus the error, as a share of its range, wins. The winner is refined
    with the focal length free, and keeps that if it is within REFINED_BY of the angle's.
    """
    at_60, tried, share = height / 2 / np.tan(np.radians(30)), {}, 0.0

    def judge(angles: list[int], poses: list[Pose], inliers: list[np.ndarray]) -> None:
        if not angles:
            return
        found = refined_poses(poses, pixels, points, np.stack(inliers), steps=8, settled=SETTLED)
        all_errors = projection_errors(np.stack([p.turn for p in found]), np.stack([p.shift for p in found]), pixels, points, np.array([[p.focal] for p in found]))
        for angle, pose, errors in zip(angles, found, all_errors, strict=True):
            if (near := errors < threshold).sum() >= LEAST_OF_ANGLE:
                tried[angle] = pose, near, float(errors[near].mean())

    def best() -> int:
        counts, errors = np.array([n.sum() for _, n, _ in tried.values()]), np.array([e for _, _, e in tried.values()])
        spread = errors.max() - errors.min() or 1.0
        return list(tried)[int((counts / counts.max() * (1 - (errors - errors.min()) / spread)).argmax())]

    coarse, found = _coarse_angles(height), []
    for angles in (coarse[len(coarse) // 2 :], coarse[: len(coarse) // 2]):  # those of the middle first, as they tell soonest what share fits
        focals = np.array([_focal(height, a) for a in angles])
        sampled = sampled_poses(pixels, points, focals, threshold * focals / at_60, rounds, rng, share)
        found += [(angle, pose, near) for angle, (pose, near) in zip(angles, sampled, strict=True) if pose is not None and near.sum() >= LEAST_OF_ANGLE]
        share = max([share, *(near.sum() / len(pixels) for _, _, near in found)])
    judge(*([f[i] for f in found] for i in range(3)))
    if tried:
        middle = coarse.index(best())
        start, inliers, _ = tried[coarse[middle]]
        away = float(np.median((points @ start.turn.T + start.shift)[:, 2]))
        rest = [a for a in range(coarse[max(middle - 1, 0)], coarse[min(middle + 1, len(coarse) - 1)] + 1) if a not in tried]
        judge(rest, [start._replace(focal=_focal(height, a), shift=start.shift + [0, 0, (_focal(height, a) / start.focal - 1) * away]) for a in rest], [inliers] * len(rest))
    if not tried:
        return None, np.zeros(len(pixels), bool), np.inf
    pose, near, error = tried[best()]
    if near.sum() >= LEAST_TO_REFINE:
        free = refined_pose(pose, pixels[near], points[near], with_focal=True)
        if abs(free.focal / pose.focal - 1) <= REFINED_BY:
            gaps = projection_errors(free.turn[None], free.shift[None], pixels[near], points[near], free.focal)[0]
            pose, error = free, float(np.sqrt((gaps**2).mean()))
    return pose, near, error


def _groups(df: DataFrame, key: str, fit: Callable[[np.ndarray, np.ndarray, np.random.Generator], tuple], fields: str, seed: int) -> DataFrame:
    """``fit`` for each ``key``, with its rows without nulls in an order of their values, so that a rerun gives the same."""
    columns = ["u", "v", "X", "Y", "Z"]
    names, kinds = zip(*(f.split() for f in f"points long, {fields}".split(", ")), strict=True)

    def run(rows: pa.Table) -> pa.Table:
        values = np.column_stack([rows[c].to_numpy() for c in columns])
        values = values[~np.isnan(values).any(axis=1)]
        values = values[np.lexsort(values.T[::-1])]
        found = len(values), *fit(values[:, :2], values[:, 2:], np.random.default_rng(seed))
        return pa.table([rows[key].slice(0, 1), *(pa.array([v], ARROW[k]) for v, k in zip(found, kinds, strict=True))], [key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key, *(df[c].cast("double").alias(c) for c in columns)).groupBy(key).applyInArrow(run, f"`{key}` {kind}, points long, {fields}")


def locate(df: DataFrame, focal: float, principal: tuple[float, float], key: str = "frame", threshold: float = 4.0, rounds: int = 5000, least: int = LEAST, above_ground: tuple[float, float] | None = ABOVE_GROUND, seed: int = 42) -> DataFrame:
    """Camera poses of frames from correspondences (key, u, v, X, Y, Z): pixels and world points.

    A row for each ``key``: points (correspondences without nulls), x, y, z of the camera, rotation (camera to world, by rows),
    inliers within ``threshold`` pixels and their mean error in pixels. Pose and error are null with
    fewer than ``least`` points or inliers, and where the camera isn't as far over its inliers' median height as
    ``above_ground`` says (None: anywhere). Repeated rows count each; an empty table gives no rows.
    With least=10, rounds=500, threshold=5 and above_ground=None it is the pose of tracked points.
    """

    def fit(pixels: np.ndarray, points: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(pixels) < max(least, 4):
            return None, None, None, None, 0, None
        middle = points.mean(axis=0)
        pixels = pixels - principal
        pose, inliers = fitted_pose(pixels, points - middle, focal, threshold, rounds, rng)
        n = int(inliers.sum())
        if pose is None or n < least:
            return None, None, None, None, n, None
        centre = pose.centre + middle
        if above_ground and not above_ground[0] <= centre[2] - np.median(points[inliers, 2]) <= above_ground[1]:
            return None, None, None, None, n, None
        error = projection_errors(pose.turn[None], pose.shift[None], pixels[inliers], points[inliers] - middle, focal)[0].mean()
        return *centre, pose.turn.T.reshape(-1).tolist(), n, float(error)

    return _groups(df, key, fit, "x double, y double, z double, rotation array<double>, inliers long, error double", seed)


def calibrate(df: DataFrame, width: float, height: float, key: str = "camera", threshold: float = 8.0, rounds: int = 400, seed: int = 42) -> DataFrame:
    """Focal lengths from correspondences (key, u, v, X, Y, Z) of images of one size: as calibrated() finds them.

    A row for each ``key``: points, focal, fov (vertical, degrees), x, y, z, rotation, inliers and error. All but the counts are null
    with fewer than LEAST points or where no angle of view has LEAST_OF_ANGLE inliers.
    """

    def fit(pixels: np.ndarray, points: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(pixels) < LEAST:
            return None, None, None, None, None, None, 0, None
        middle = points.mean(axis=0)
        pose, near, error = calibrated(pixels - (width / 2, height / 2), points - middle, height, threshold, rounds, rng)
        if pose is None:
            return None, None, None, None, None, None, 0, None
        return float(pose.focal), float(np.degrees(2 * np.arctan(height / 2 / pose.focal))), *(pose.centre + middle), pose.turn.T.reshape(-1).tolist(), int(near.sum()), error

    return _groups(df, key, fit, "focal double, fov double, x double, y double, z double, rotation array<double>, inliers long, error double", seed)
