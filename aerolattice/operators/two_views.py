"""The motion between two views of one camera, from the pixels of the same points in both.

The essential matrix of five points and the homography of four are both fitted to random samples, many at once as
arrays. The one that explains the view decides: flat ground, which a homography explains as well, leaves
the essential matrix with too much freedom. What a matrix leaves open, its signs, is told by the depths of the points.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .camera_fit import cross, turn_by

#: Samples that are solved at once, and the chance that one of those drawn was free of wrong points.
SAMPLES, SURE = 64, 0.999
#: Pairs of pixels on which all matrices are judged first, and how many of the best are then judged on all pairs.
PREVIEW, CALLED = 64, 8
#: Pairs of pixels at least, points before both cameras at least of an essential matrix and of a homography.
LEAST, LEAST_AHEAD, LEAST_ON_PLANE = 10, 10, 5
#: A homography is taken from this share of its inliers among those of both matrices on.
PLANE_SHARE = 0.40

# Monomials of degree three in x, y, z and 1 (named 3): those of degree three in x, y, z first.
_CUBIC = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 1, 1), (0, 0, 2), (0, 1, 2), (1, 1, 2), (0, 2, 2), (1, 2, 2), (2, 2, 2)]
_LOWER = [(0, 0, 3), (0, 1, 3), (1, 1, 3), (0, 2, 3), (1, 2, 3), (2, 2, 3), (0, 3, 3), (1, 3, 3), (2, 3, 3), (3, 3, 3)]
_PLACE = {m: k for k, m in enumerate(_CUBIC + _LOWER)}
assert set(_PLACE) == set(combinations_with_replacement(range(4), 3))


def essential_matrices(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """All essential matrices of samples of five points: (n, 5, 3) rays in both views, up to ten matrices a sample.

    A matrix is a mix of four that fit the points; ten cubic equations in the weights are brought to the form in
    which multiplying by one weight is a linear map of the lower monomials, whose eigenvectors are the solutions.
    """
    rows = np.einsum("nki,nkj->nkij", second, first).reshape(len(first), 5, 9)
    basis = np.linalg.svd(rows)[2][:, 5:].reshape(-1, 4, 3, 3)
    squares = np.einsum("niab,njcb->nijac", basis, basis)
    cubes = 2 * np.einsum("nijac,nkcd->nijkad", squares, basis) - np.einsum("nijaa,nkbd->nijkbd", squares, basis)
    levi = np.zeros((3, 3, 3))
    levi[[0, 1, 2], [1, 2, 0], [2, 0, 1]], levi[[0, 2, 1], [2, 1, 0], [1, 0, 2]] = 1, -1
    volumes = np.einsum("abc,nia,njb,nkc->nijk", levi, basis[:, :, 0], basis[:, :, 1], basis[:, :, 2], optimize=True)
    forms = np.concatenate([cubes.reshape(-1, 4, 4, 4, 9), volumes[..., None]], axis=4)
    system = np.zeros((len(first), 10, 20))
    for ijk in product(range(4), repeat=3):
        system[:, :, _PLACE[tuple(sorted(ijk))]] += forms[(slice(None), *ijk)]
    sound = np.abs(np.linalg.det(system[:, :, :10])) > 1e-30
    basis, reduced = basis[sound], np.linalg.solve(system[sound, :, :10], system[sound, :, 10:])
    times_x = np.zeros_like(reduced)
    for row, (i, j, _) in enumerate(_LOWER):  # x times x^2, xy, y^2, xz, yz, z^2, x, y, z and 1
        target = tuple(sorted((0, i, j))) if row < 6 else tuple(sorted((0, i, 3)))
        if target in _CUBIC:
            times_x[:, row] = -reduced[:, _PLACE[target]]
        else:
            times_x[:, row, _PLACE[target] - 10] = 1
    fine = np.isfinite(times_x).all(axis=(1, 2))
    values, vectors = np.linalg.eig(times_x[fine])
    sample, which = np.nonzero(np.abs(values.imag) < 1e-9)
    found = vectors.real[sample, :, which]
    ends = found[:, 9:]
    weights = np.concatenate([found[:, 6:9] / np.where(np.abs(ends) > 1e-14, ends, np.nan), np.ones_like(ends)], axis=1)
    matrices = np.einsum("nk,nkab->nab", weights, basis[fine][sample])
    return matrices[np.isfinite(matrices).all(axis=(1, 2))]


def epipolar_errors(matrices: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Squared distances (to first order) of each pair of rays (x, y, 1) from what each matrix allows."""
    lines, back = first @ matrices.transpose(0, 2, 1), second @ matrices
    off = np.einsum("mnk,nk->mn", lines, second)
    return off**2 / np.maximum(lines[..., 0] ** 2 + lines[..., 1] ** 2 + back[..., 0] ** 2 + back[..., 1] ** 2, 1e-300)


def homographies(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The homography of each sample of four points or more: (n, k, 3) rays (x, y, 1) in both views."""
    zero = np.zeros_like(first)
    rows = np.concatenate([np.concatenate([first, zero, -second[..., :1] * first], axis=2), np.concatenate([zero, first, -second[..., 1:2] * first], axis=2)], axis=1)
    return np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3)


def four_point_homographies(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The homography of each sample of four points, without those that it isn't told by: (n, 4, 3) rays in both views.

    Three rays and the sum of them, at the lengths that make it the fourth, are a base in each view; it takes one to the other.
    """

    def inverse(rays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c = rays[:, 0], rays[:, 1], rays[:, 2]
        rows = np.stack([cross(b, c), cross(c, a), cross(a, b)], axis=1)
        return rows, (rows[:, 0] * a).sum(1), np.einsum("nij,nj->ni", rows, rays[:, 3])

    (back, size, weights), (_, other, wanted) = inverse(first), inverse(second)
    sound = (np.abs(size) > 1e-12) & (np.abs(other) > 1e-12) & (np.abs(weights).min(1) > 1e-12)
    scale = wanted[sound] / weights[sound]
    return np.einsum("nki,nk,nkj->nij", second[sound, :3], scale, back[sound])


def transfer_errors(matrices: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Squared distances in the second view of where each matrix puts the points of the first."""
    there = first @ matrices.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = there[..., :2] / there[..., 2:] - second[:, :2]
    return np.where(np.isfinite(gap).all(axis=2), (gap**2).sum(axis=2), np.inf)


def _sampled(first, second, size, solve, errors, threshold, rounds, rng) -> tuple[np.ndarray | None, np.ndarray]:
    """The matrix with the least sum of squared distances, each ``threshold`` at most, and which pairs are nearer than that."""
    best, most, least, drawn, needed = None, np.zeros(len(first), bool), np.inf, 0, rounds
    preview = rng.permutation(len(first))[:PREVIEW]
    while drawn < needed:
        some = rng.random((SAMPLES, len(first))).argpartition(size - 1, axis=1)[:, :size] if len(first) < 200 else rng.integers(0, len(first), (SAMPLES, size))
        drawn += SAMPLES
        found = solve(first[some], second[some])
        if not len(found):
            continue
        if len(first) > 2 * PREVIEW:
            seen = np.minimum(errors(found, first[preview], second[preview]), threshold**2).sum(1)
            found = found[np.argsort(seen, kind="stable")[:CALLED]]
        off = np.minimum(errors(found, first, second), threshold**2)
        costs = off.sum(1)
        k = int(costs.argmin())
        if costs[k] < least:
            best, most, least = found[k], off[k] < threshold**2, costs[k]
            clean = min((most.sum() / len(first)) ** size, 1 - 1e-12)
            needed = min(rounds, np.log(1 - SURE) / np.log1p(-clean))
    return best, most


def depths(turn: np.ndarray, shift: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far along its rays each point is in both views, by the nearest points of the two; 0 where they are parallel."""
    turned = first @ turn.T
    aside = cross(second, turned)
    below = (aside**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        along = -(np.cross(second, shift) * aside).sum(1) / below, -(np.cross(turned, shift) * aside).sum(1) / below
    return tuple(np.where(below > 1e-16, x, 0.0) for x in along)


def _ahead(turn, shift, first, second) -> int:
    d1, d2 = depths(turn, shift, first, second)
    return int(((d1 > 0) & (d2 > 0)).sum())


def motion_of_essential(matrix: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of the two turns and signs that a matrix leaves, those with most points before both cameras."""
    u, _, vt = np.linalg.svd(matrix)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    quarter = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    found = [(turn, sign * u[:, 2]) for turn in (u @ quarter @ vt, u @ quarter.T @ vt) for sign in (1, -1)]
    counts = [_ahead(*m, first, second) for m in found]
    k = int(np.argmax(counts))
    return counts[k], *found[k]


def _signed_errors(turn: np.ndarray, shift: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x, y, z = shift
    matrix = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) @ turn
    lines, back = first @ matrix.T, second @ matrix
    return (lines * second).sum(1) / np.sqrt(np.maximum(lines[:, 0] ** 2 + lines[:, 1] ** 2 + back[:, 0] ** 2 + back[:, 1] ** 2, 1e-300))


def refined_motion(turn: np.ndarray, shift: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The motion of least squared distances from what it allows, by damped Gauss-Newton steps over turn and direction.

    After each round those pairs count that are within ``threshold`` and within five times the median distance, so that a wrong pair that happens
    to lie near its line is left out once the others fit better.
    """
    off = _signed_errors(turn, shift, first, second)
    fits = np.abs(off) < threshold
    for _ in range(rounds):
        if fits.sum() < LEAST_AHEAD:
            break
        turn, shift = _least_squares(turn, shift, first[fits], second[fits])
        off = np.abs(_signed_errors(turn, shift, first, second))
        now = off < min(threshold, max(5 * float(np.median(off[fits])), 1e-12))
        if (now == fits).all():
            break
        fits = now
    return turn, shift


def _least_squares(turn: np.ndarray, shift: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    damping, off = 1e-6, _signed_errors(turn, shift, first, second)

    def moved(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = shift + step[3:] @ aside
        return turn_by(step[:3]) @ turn, to / np.linalg.norm(to)

    for _ in range(steps):
        aside = np.linalg.svd(shift[None])[2][1:]
        slope = np.stack([(_signed_errors(*moved(h), first, second) - _signed_errors(*moved(-h), first, second)) / 2e-6 for h in 1e-6 * np.eye(5)], axis=1)
        square, pull = slope.T @ slope, slope.T @ off
        while damping < 1e9:
            step = -np.linalg.solve(square + damping * np.diag(np.diag(square) + 1e-15), pull)
            now = moved(step)
            new = _signed_errors(*now, first, second)
            if new @ new < off @ off:
                break
            damping *= 10
        else:
            break
        (turn, shift), off, damping = now, new, max(damping / 10, 1e-12)
        if np.abs(step).max() < 1e-12:
            break
    return turn, shift


def motions_of_homography(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Turns, shifts over the plane's distance and normals that a homography between rays may stand for: four, or one without a shift.

    Two planes through the middle axis of its ellipsoid keep lengths; each gives a turn, and either sign of its normal fits.
    """
    matrix = matrix / np.linalg.svd(matrix)[1][1]
    matrix = matrix * (np.sign(np.linalg.det(matrix)) or 1.0)
    values, axes = np.linalg.eigh(matrix.T @ matrix)
    low, high = values[0], values[2]
    if high - low < 1e-12:
        u, _, vt = np.linalg.svd(matrix)
        return [(u @ vt, np.zeros(3), np.array([0.0, 0, 1]))]
    v1, v2, v3 = axes[:, 2], axes[:, 1], axes[:, 0]
    found = []
    for sign in (1, -1):
        kept = (np.sqrt(max(1 - low, 0)) * v1 + sign * np.sqrt(max(high - 1, 0)) * v3) / np.sqrt(high - low)
        before = np.column_stack([v2, kept, np.cross(v2, kept)])
        after = np.column_stack([matrix @ v2, matrix @ kept, np.cross(matrix @ v2, matrix @ kept)])
        turn, normal = after @ before.T, np.cross(v2, kept)
        found += [(turn, s * (matrix - turn) @ normal, s * normal) for s in (1, -1)]
    return found


def motion_of_homography(matrix: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The motion with most points before both cameras; of equal ones that whose plane faces the camera most.

    Two views of a plane may leave two motions with all points ahead; ground seen from above tells them apart by its normal.
    """
    found = motions_of_homography(matrix)
    counts = [_ahead(turn, shift, first, second) for turn, shift, _ in found]
    k = max(range(len(found)), key=lambda i: (counts[i], abs(found[i][2][2])))
    return counts[k], found[k][0], found[k][1]


def motion(first: np.ndarray, second: np.ndarray, threshold: float, rounds: int, rng: np.random.Generator) -> tuple[str, int, np.ndarray, np.ndarray] | None:
    """Model (essential or plane), its inliers, turn and shift of length one: a point p of the first camera is at turn @ p + shift in the second.

    ``first`` and ``second`` are rays (x, y, 1), ``threshold`` is in their unit. None where neither model has enough points ahead.
    """
    essential, fits = _sampled(first, second, 5, essential_matrices, epipolar_errors, threshold, rounds, rng)
    plane, on = _sampled(first, second, 4, four_point_homographies, transfer_errors, threshold, rounds, rng)
    found = None
    if essential is not None:
        count, turn, shift = motion_of_essential(essential, first[fits], second[fits])
        if count >= LEAST_AHEAD:
            turn, shift = refined_motion(turn, shift, first, second, threshold)
            fits = np.abs(_signed_errors(turn, shift, first, second)) < threshold
            found = "essential", int(fits.sum()), turn, shift
    if plane is not None and (found is None or on.sum() > PLANE_SHARE * max(on.sum() + fits.sum(), 1)):
        plane = homographies(first[on][None], second[on][None])[0] if on.sum() > 4 else plane
        count, turn, shift = motion_of_homography(plane, first[on], second[on])
        if count >= LEAST_ON_PLANE:
            length = np.linalg.norm(shift)
            found = "plane", int(on.sum()), turn, shift / length if length > 1e-8 else shift
    return found


def relative_poses(df: DataFrame, focal: float, principal: tuple[float, float], keys: tuple[str, ...] = ("pair",), threshold: float = 1.0, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """The motion between two views of each ``keys``, from correspondences (keys, u1, v1, u2, v2) in pixels.

    A row for each: points (without nulls), ok, model (essential or plane), inliers within ``threshold`` pixels, rel (nine values by rows) and tx, ty, tz of length one: a
    point p of the first camera is at rel @ p + t in the second, so chained_poses() takes these. Without LEAST points, or where no model has enough
    of them before both cameras, ok is false and the others are null. Repeated rows count each. A pair's correspondences, thousands from a matcher, are one group.
    """
    columns = ["u1", "v1", "u2", "v2"]

    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[columns].dropna().sort_values(columns).to_numpy(float)
        rays = (values - np.tile(principal, 2)) / focal
        first, second = (np.column_stack([rays[:, k : k + 2], np.ones(len(rays))]) for k in (0, 2))
        found = motion(first, second, threshold / focal, rounds, np.random.default_rng(seed)) if len(values) >= LEAST else None
        told = (None, None, None, None, None, None) if found is None else (found[0], found[1], found[2].reshape(-1).tolist(), *map(float, found[3]))
        return pd.DataFrame([(*names, len(values), found is not None, *told)], columns=[*keys, "points", "ok", "model", "inliers", "rel", "tx", "ty", "tz"]).astype({k: rows[k].dtype for k in keys})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", points long, ok boolean, model string, inliers long, rel array<double>, tx double, ty double, tz double"
    return df.select(*keys, *(df[c].cast("double").alias(c) for c in columns)).groupBy(*keys).applyInPandas(run, schema)
