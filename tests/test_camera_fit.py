"""Poses, focal lengths and motions of made scenes against what they were made from."""

import numpy as np
import pandas as pd
import pytest

from aerolattice.operators import camera_fit, sequences, two_views

COLUMNS = ["frame", "u", "v", "X", "Y", "Z"]
DOWN = np.diag([1.0, -1.0, -1.0])


def scene(seed, n=400, focal=500.0, wrong=0.0, noise=0.0, flat=False, spread=100):
    rng = np.random.default_rng(seed)
    world = rng.uniform(-spread, spread, (n, 3)) * [1, 1, 0 if flat else 0.2] + [3000, 5000, 40]
    turn = camera_fit.turn_by(rng.uniform(-0.4, 0.4, 3)) @ camera_fit.turn_by(np.array([0, 0, rng.uniform(-3, 3)])) @ DOWN
    centre = np.array([3005.0, 4990.0, 190.0]) + rng.uniform(-20, 20, 3)
    seen = (world - centre) @ turn.T
    pixels = focal * seen[:, :2] / seen[:, 2:] + [320, 240] + rng.normal(size=(n, 2)) * noise
    k = int(wrong * n)
    pixels[:k] = rng.uniform(0, 640, (k, 2))
    return pixels, world, turn, centre


def table(spark, scenes):
    rows = np.concatenate([np.column_stack([np.full(len(p), k), p, w]) for k, (p, w, *_) in scenes.items()])
    return spark.createDataFrame(pd.DataFrame(rows, columns=COLUMNS).astype({"frame": "int64"}))


@pytest.mark.parametrize("flat", [False, True])
def test_three_points_have_their_pose_among_the_found(flat):
    for seed in range(50):
        pixels, world, turn, centre = scene(seed, 3, flat=flat)
        rays = np.column_stack([(pixels - [320, 240]) / 500, np.ones(3)])
        rays /= np.linalg.norm(rays, axis=1, keepdims=True)
        turns, shifts = camera_fit.three_point_poses(rays[None], world[None] - world.mean(0))
        centres = -np.einsum("nji,nj->ni", turns, shifts) + world.mean(0)
        assert min(np.abs(c - centre).max() + np.abs(t - turn).max() for c, t in zip(centres, turns, strict=True)) < 1e-4


def test_locate(spark):
    scenes = {k: scene(k, wrong=0.7 if k % 2 else 0.0, flat=k % 3 == 0) for k in range(6)} | {6: scene(6, 29), 7: scene(7, 31)}
    pixels, world, *_ = scene(8)
    scenes[8] = (pixels, world * 20)  # the camera is too high above these
    rng = np.random.default_rng(9)
    scenes[9] = (rng.uniform(0, 640, (200, 2)), rng.uniform(0, 100, (200, 3)))
    df = table(spark, scenes)
    got = {r.frame: r for r in camera_fit.locate(df, 500.0, (320.0, 240.0)).collect()}
    assert len(got) == 10
    for k in (*range(6), 7):
        _, _, turn, centre = scenes[k]
        assert np.allclose([got[k].x, got[k].y, got[k].z], centre, atol=1e-6) and np.allclose(np.reshape(got[k].rotation, (3, 3)), turn.T, atol=1e-8)
        assert got[k].inliers >= (120 if k % 2 and k < 6 else 31 if k == 7 else 400) and got[k].error < 0.2
    assert [(got[k].x, got[k].rotation, got[k].error) for k in (6, 8, 9)] == [(None, None, None)] * 3 and got[6].points == 29
    again = {r.frame: r for r in camera_fit.locate(df.repartition(7), 500.0, (320.0, 240.0)).collect()}
    assert again == got
    tracked = {r.frame: r for r in camera_fit.locate(df, 500.0, (320.0, 240.0), threshold=5.0, rounds=500, least=10, above_ground=None).collect()}
    assert np.allclose([tracked[6].x, tracked[6].y, tracked[6].z], scenes[6][3], atol=1e-6) and tracked[8].x is not None


def test_refinement_is_better_than_the_samples():
    first, last = [], []
    for seed in range(25):
        pixels, world, _, centre = scene(seed, 200, noise=1.0)
        pixels, middle = pixels - [320, 240], world.mean(0)
        pose, inliers = camera_fit.sampled_pose(pixels, world - middle, 500.0, 4.0, 1000, np.random.default_rng(1))
        better = camera_fit.refined_pose(pose, pixels[inliers], (world - middle)[inliers])
        first.append(np.linalg.norm(pose.centre + middle - centre))
        last.append(np.linalg.norm(better.centre + middle - centre))
        # no small step from the refined pose lowers the squared distances
        cost = lambda p, s=inliers, x=pixels, w=world, m=middle: (camera_fit.projection_errors(p.turn[None], p.shift[None], x[s], (w - m)[s], p.focal) ** 2).sum()
        for k in range(6):
            step = 1e-4 * np.eye(6)[k]
            assert cost(better) <= cost(camera_fit.Pose(camera_fit.turn_by(step[3:]) @ better.turn, camera_fit.turn_by(step[3:]) @ better.shift + step[:3], 500.0)) + 1e-9
    assert np.mean(last) < np.mean(first) / 2 and np.mean(last) < 0.3


def test_calibrate(spark):
    scenes = {k: scene(k, 300, focal=f, wrong=0.4, noise=s) for k, (f, s) in enumerate([(330.7, 0.0), (611.3, 0.0), (450.0, 0.5)])} | {3: scene(3, 29), 4: scene(4, 40, focal=400.0)}
    df = table(spark, scenes).withColumnRenamed("frame", "camera")
    got = {r.camera: r for r in camera_fit.calibrate(df, 640.0, 480.0).collect()}
    assert abs(got[0].focal - 330.7) < 1e-4 and abs(got[1].focal - 611.3) < 1e-4 and abs(got[2].focal / 450 - 1) < 0.02
    assert np.allclose([got[1].x, got[1].y, got[1].z], scenes[1][3], atol=1e-3) and abs(got[0].fov - np.degrees(2 * np.arctan(240 / 330.7))) < 1e-5
    assert got[3].focal is None and got[3].inliers == 0
    assert abs(got[4].focal / 400 - 1) < 0.03  # too few inliers to refine: the angle of the sweep


def views(seed, flat, n=300, wrong=0.3):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-0.5, 0.5, (n, 2))
    depth = np.full(n, 9.0) if flat else rng.uniform(6, 11, n)
    points = np.column_stack([at * depth[:, None], depth])
    turn, shift = camera_fit.turn_by(rng.uniform(-0.2, 0.2, 3)), rng.normal(size=3)
    shift /= np.linalg.norm(shift)
    there = points @ turn.T + shift
    first, second = points / points[:, 2:], there / there[:, 2:]
    k = int(n * wrong)
    second[:k, :2] += rng.uniform(0.1, 0.3, (k, 2))
    return first, second, turn, shift


def test_five_points_have_their_matrix_among_the_found():
    for seed in range(30):
        first, second, turn, shift = views(seed, False, 5, 0)
        x, y, z = shift
        true = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) @ turn
        found = two_views.essential_matrices(first[None], second[None])
        found = found / np.linalg.norm(found, axis=(1, 2), keepdims=True) * np.sqrt(2)
        assert min(min(np.abs(m - true).max(), np.abs(m + true).max()) for m in found) < 1e-5


@pytest.mark.parametrize("flat", [False, True])
def test_motion_between_views(flat):
    for seed in range(30):
        first, second, turn, shift = views(seed, flat)
        model, _, r, t = two_views.motion(first, second, 1 / 500, 1000, np.random.default_rng(seed))
        assert model == ("plane" if flat else "essential")
        assert np.allclose(r, turn, atol=1e-4) and np.allclose(t, shift, atol=1e-3), seed


def test_homography_of_a_slope_has_its_motion_among_four():
    rng = np.random.default_rng(4)
    for _ in range(30):
        turn, shift, normal = camera_fit.turn_by(rng.uniform(-0.3, 0.3, 3)), rng.normal(size=3) * 0.2, np.array([0.3, -0.2, 1.0])
        normal /= np.linalg.norm(normal)
        found = two_views.motions_of_homography(-3.0 * (turn + np.outer(shift, normal)))
        assert len(found) == 4 and min(np.abs(r - turn).max() + np.abs(t - shift).max() + np.abs(n - normal).max() for r, t, n in found) < 1e-8
    (r, t, _), = two_views.motions_of_homography(turn * 2)
    assert np.allclose(r, turn) and not t.any()


def test_trajectory_from_views(spark):
    """Motions of neighbouring frames, chained: all of length one, the last pair has too few points."""
    rows, truth, centre, rotation = [], [], np.zeros(3), np.eye(3)
    for k in range(4):
        first, second, turn, shift = views(40 + k, k == 1)
        centre, rotation = centre - rotation @ turn.T @ shift, rotation @ turn.T
        truth.append(centre)
        n = 9 if k == 3 else len(first)
        rows += [(1, k, *map(float, p), *map(float, q)) for p, q in zip((first[:, :2] * 500 + [320, 240])[-n:], (second[:, :2] * 500 + [320, 240])[-n:], strict=True)]
    df = spark.createDataFrame(rows + [(1, 0, None, 1.0, 1.0, 1.0)], "seq long, ord long, u1 double, v1 double, u2 double, v2 double")
    found = two_views.relative_poses(df, 500.0, (320.0, 240.0), keys=("seq", "ord"))
    got = sequences.chained_poses(found).orderBy("ord").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in got[:3]], truth[:3], atol=1e-2) and (got[3].x, got[3].y) == (got[2].x, got[2].y)
    assert sorted((r.ord, r.ok, r.points) for r in found.collect())[3] == (3, False, 9)
    assert two_views.relative_poses(df.where("false"), 500.0, (320.0, 240.0), keys=("seq", "ord")).count() == 0


def test_calibration_samples_few_angles(monkeypatch):
    """Angles between the best of the coarse ones start from its pose: narrow, middling and wide views are found with fewer samplings than angles."""
    from aerolattice.operators import camera_fit

    calls, sampled = [], camera_fit.sampled_pose
    monkeypatch.setattr(camera_fit, "sampled_pose", lambda *a, **k: (calls.append(1), sampled(*a, **k))[1])
    for fov in (14.3, 47.6, 83.2):
        rng = np.random.default_rng(int(fov))
        points = rng.uniform(-1, 1, (300, 3)) * [40, 40, 15] + [0, 0, 130.0]
        focal = 240 / np.tan(np.radians(fov) / 2)
        points[:, :2] *= 500 / focal
        pixels = focal * points[:, :2] / points[:, 2:]
        pixels[::3] += rng.uniform(40, 90, (100, 2))
        calls.clear()
        pose, near, _ = camera_fit.calibrated(pixels, points - [0, 0, 130.0], 480.0, 8.0, 400, np.random.default_rng(1))
        assert abs(pose.focal / focal - 1) < 1e-6 and near.sum() == 200
        assert len(calls) < 20


def test_homographies_of_four_points():
    from aerolattice.operators import two_views

    rng = np.random.default_rng(5)
    first = np.concatenate([rng.uniform(-1, 1, (50, 4, 2)), np.ones((50, 4, 1))], axis=2)
    wanted = rng.normal(size=(50, 3, 3)) * 0.1 + np.eye(3)
    second = first @ wanted.transpose(0, 2, 1)
    second /= second[..., 2:]
    found = two_views.four_point_homographies(first, second)
    assert np.allclose(found / found[:, 2:, 2:], wanted / wanted[:, 2:, 2:], rtol=1e-5, atol=1e-7)
    assert len(two_views.four_point_homographies(first[:3][:, [0, 0, 1, 2]], second[:3][:, [0, 0, 1, 2]])) == 0


def test_angles_are_refined_together(monkeypatch):
    """Each step of all angles of view is one call of the solver, so that a camera takes few calls."""
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: (calls.append(1), solve(*a))[1])
    pixels, world, _, _ = scene(3, 400, focal=450.0, wrong=0.5, noise=0.5)
    pose, near, _ = camera_fit.calibrated(pixels - [320, 240], world - world.mean(0), 480.0, 8.0, 400, np.random.default_rng(1))
    assert abs(pose.focal / 450 - 1) < 0.02 and near.sum() >= 200
    assert len(calls) < 50


def test_quartic_roots():
    rng = np.random.default_rng(6)
    wanted = [rng.uniform(-3, 3, 4) for _ in range(200)] + [np.array(r, float) for r in ((1, -1, 2, -2), (2, 2, 5, -1), (0, 0, 1, -1), (1, 1, 1, 1), (3, 3, -3, -3))]
    found, real = camera_fit.quartic_roots(np.array([np.poly(r)[1:] for r in wanted]))
    for want, x, ok in zip(wanted, found, real, strict=True):
        assert ok.all() and np.allclose(np.sort(x), np.sort(want), atol=2e-2 if len(set(want)) < 4 else 1e-5), want
    pairs = np.array([[0.0, 5.0, 0.0, 4.0], [0.0, 0.0, 0.0, -1.0], [-2.0, 2.0, -2.0, 1.0 - 1.0]])  # no real root; two; two
    found, real = camera_fit.quartic_roots(pairs)
    assert real.sum(1).tolist() == [0, 2, 2]
    for c, x, ok in zip(pairs, found, real, strict=True):
        assert np.allclose(np.polyval([1, *c], x[ok]), 0, atol=1e-9)


def test_poses_refined_together_are_those_refined_alone():
    """Poses of different inliers, one of which is there at once and one of which starts behind."""
    pixels, world, turn, centre = scene(11, 120, noise=1.0)
    pixels, world, centre = pixels - [320, 240], world - world.mean(0), centre - world.mean(0)
    rng = np.random.default_rng(2)
    poses = []
    for k in range(4):
        moved = camera_fit.turn_by(rng.normal(size=3) * 0.03 * k) @ turn
        poses.append(camera_fit.Pose(moved, -moved @ centre + rng.normal(size=3) * 2 * k, 500.0 - 10 * k))
    inliers = rng.random((4, 120)) < np.array([[0.9], [0.5], [0.2], [0.7]])
    for with_focal in (False, True):
        together = camera_fit.refined_poses(poses, pixels, world, inliers, with_focal=with_focal)
        for pose, near, got in zip(poses, inliers, together, strict=True):
            alone = camera_fit.refined_pose(pose, pixels[near], world[near], with_focal=with_focal)
            assert np.allclose(got.turn, alone.turn, atol=1e-7) and np.allclose(got.shift, alone.shift, rtol=1e-6) and np.isclose(got.focal, alone.focal, rtol=1e-7)
            assert np.allclose(got.turn @ got.turn.T, np.eye(3), atol=1e-12)


def test_cameras_with_names(spark):
    """Keys of any type, a null among them."""
    pixels, world, *_ = scene(1, 200, focal=500.0)
    rows = [(name, *map(float, p), *map(float, w)) for name in ("one", None) for p, w in zip(pixels, world, strict=True)] + [("one", None, 1.0, 1.0, 1.0, 1.0), ("one", float("nan"), 1.0, 1.0, 1.0, 1.0)]
    got = {r.camera: r for r in camera_fit.calibrate(spark.createDataFrame(rows, "camera string, u double, v double, X double, Y double, Z double"), 640.0, 480.0).collect()}
    assert set(got) == {"one", None} and all(r.points == 200 and abs(r.focal - 500) < 1e-4 and len(r.rotation) == 9 for r in got.values())
