import random

import numpy as np
from pyspark.sql import functions as F

from aerolattice.functions import cameras as cam
from aerolattice.functions import geometry as g
from aerolattice.operators import aggregates, joins, raster, sequences
from aerolattice.plans import pose_queries  # noqa: F401
from aerolattice.plans.queries import QUERIES  # noqa: F401
from aerolattice.sources import grids, trajectories


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lits(*values):
    return [F.lit(float(v)) for v in values]


DOWN = (1, 0, 0, 0, -1, 0, 0, 0, -1)  # looks straight down, the image's top to the north


def test_footprint_of_a_camera_that_looks_down(spark):
    k, centre, m = lits(100, 100, 50, 50), lits(10, 20, 30), F.array(*lits(*DOWN))
    box = one(spark, *cam.footprint_box(m, centre, *lits(100, 100), k, F.lit(0.0)))
    assert np.allclose(box, (10 - 15, 20 - 15, 10 + 15, 20 + 15))
    away = one(spark, *cam.footprint_box(F.array(*lits(1, 0, 0, 0, 1, 0, 0, 0, 1)), centre, *lits(100, 100), k, F.lit(0.0)))
    assert np.allclose(away, (-90, -80, 110, 120))
    corners = one(spark, *[c for p in cam.frustum_corners(m, centre, *lits(100, 100), k, F.lit(0.0)) for c in p])
    assert np.allclose(corners, (-5, 35, 25, 35, 25, 5, -5, 5))
    far = one(spark, *[c for p in cam.frustum_corners(F.array(*lits(1, 0, 0, 0, 1, 0, 0, 0, 1)), centre, *lits(100, 100), k, F.lit(0.0)) for c in p])
    assert np.allclose(np.hypot(far[0] - 10, far[1] - 20), 2000)
    tail = one(spark, *[c for p in cam.camera_triangle(m, centre) for c in p])
    assert np.allclose(tail, (10, 20, 15, 23, 15, 17))  # straight down: the image's x axis leads
    assert abs(one(spark, cam.ground_region(m, centre, *lits(100, 100), k, F.lit(0.0))).c0 - max(100, 2.5 * 15 * 2**0.5)) < 1e-9


def test_unprojected_is_the_inverse_of_project(spark):
    m, centre, k = F.array(*lits(*DOWN)), lits(10, 20, 30), lits(100, 90, 50, 40)
    point = cam.unprojected(*lits(70, 10, 12), m, centre, *k)
    w2c = F.array(*lits(*np.array(DOWN).reshape(3, 3).T.reshape(-1)))
    u, v, z = g.project(point, w2c, g.world_to_camera(m, centre), *k)
    assert np.allclose(one(spark, u, v, z), (70, 10, 12))
    assert tuple(one(spark, *cam.unprojected(*lits(70, 10, 0), m, centre, *k))) == (0, 0, 0)
    assert tuple(one(spark, *g.project(lits(0, 0, -5), F.array(*lits(1, 0, 0, 0, 1, 0, 0, 0, 1)), lits(0, 0, 0), *k)))[:2] == (None, None)


def test_turns(spark):
    half = one(spark, *cam.slerp(lits(1, 0, 0, 0), lits(-(0.5**0.5), 0, 0, -(0.5**0.5)), F.lit(0.5)))
    assert np.allclose(np.abs(half), (np.cos(np.pi / 8), 0, 0, np.sin(np.pi / 8)))
    assert np.allclose(one(spark, *cam.slerp(lits(1, 0, 0, 0), lits(1, 0, 0, 0), F.lit(0.3))), (1, 0, 0, 0))
    row = one(spark, cam.euler_matrix(*lits(90, 0, 0)), cam.first_number(F.lit("a1/frame_0030.v2.png")), cam.neighbour_als_id(F.lit("3dm_33_399_5802_1_be")), g.effective_pyramid_level(F.lit(30.0), F.lit(3)))
    assert np.allclose(row.c0, (1, 0, 0, 0, 0, -1, 0, 1, 0), atol=1e-12) and row.c1 == 30 and row.c2 == "als_33399-5802" and row.c3 is not None


def test_keyframe_rule_by_hand(spark):
    def reason(tracked, since, initial=0, error=0.0, base=0.0, spread=None, most=0):
        s = tuple(F.lit(x) for x in spread) if spread else None
        return one(spark, g.keyframe_reason(F.lit(tracked), F.lit(since), initial=F.lit(initial), error=F.lit(error), baseline=F.lit(base), spread=s, max_interval=most)).c0

    assert reason(10, 3) == "" and reason(10, 3, most=3) == "max_interval"  # the minimum interval goes before all but the longest
    assert reason(99, 5) == "low_points" and reason(100, 5) == ""
    assert reason(299, 5, initial=1000) == "point_drop" and reason(300, 5, initial=1000) == "" and reason(150, 5, initial=300) == ""
    assert reason(100, 5, spread=(100, 29.0, 90.0)) == "spatial_collapse" and reason(100, 5, spread=(9, 1.0, 1.0)) == ""
    assert reason(100, 15, error=2.1) == "reproj_abs" and reason(100, 5, error=3.3) == "" and reason(100, 5, error=3.4) == "reproj_abs"
    assert reason(100, 5, error=6.0, base=5.0) == "" and reason(100, 5, error=6.4, base=5.0) == "reproj_abs"
    assert reason(100, 15, error=1.9, base=0.9) == "reproj_growth" and reason(100, 14, error=1.9, base=0.9) == ""
    assert reason(100, 115, error=1.3, base=0.95) == "reproj_growth" and reason(100, 65, error=1.3, base=0.95) == ""


def test_anchoring_undoes_the_first_turn(spark):
    rnd, turn = random.Random(3), np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    gt = [np.array([rnd.random() * 9 for _ in range(3)]) for _ in range(20)]
    rows = [(1, k, *p, *(turn.T @ p / 3 + 5), np.eye(3).reshape(-1).tolist(), turn.T.reshape(-1).tolist()) for k, p in enumerate(gt)]
    df = spark.createDataFrame([tuple(v if isinstance(v, (int, list)) else float(v) for v in r) for r in rows], "seq long, ord long, x double, y double, z double, px double, py double, pz double, rg array<double>, rp array<double>")
    for scaled in (False, True):
        placed = aggregates.anchored(df, ["px", "py", "pz"], ["x", "y", "z"], "rp", "rg", scaled).orderBy("ord").collect()
        assert np.allclose([(r.ax, r.ay, r.az) for r in placed], [gt[0] + (p - gt[0]) * (1 if scaled else 1 / 3) for p in gt])
        assert abs(placed[0].scale - (3 if scaled else 1)) < 1e-9


def test_nearest_in_time_takes_nulls(spark):
    frames = spark.createDataFrame([(1, 0.0, None), (1, 0.5, "a"), (1, 9.0, None), (None, 0.0, "b")], "seq long, t double, note string")
    samples = spark.createDataFrame([(1, 7, 0.01), (1, 8, 0.52), (1, 9, 0.48)], "seq long, sid long, st double")
    got = joins.nearest_in_time(frames, samples, ["seq"], "t", "st", 0.05, "sid", row_key=["seq", "t"]).collect()
    assert sorted((r.seq or 0, r.t, r.note or "", r.sid) for r in got if r.sid) == [(1, 0.0, "", 7), (1, 0.5, "a", 8)] and len(got) == 4


def test_sampled_takes_repeated_points(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, z double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (1, 1.0, 0.25), (2, 2.4, 2.4), (3, 9.0, 9.0)], "p long, c double, r double")
    assert sorted((r.p, r.z) for r in raster.sampled(points, cells, "c", "r", "z", key=["p"]).collect() if r.z is not None) == [(1, 3.5), (1, 5.5), (1, 5.5), (2, 22.0)]


def test_long_spline_is_the_dense_solution():
    rnd = np.random.default_rng(1)
    t, y = np.cumsum(rnd.random(60) + 0.1), rnd.random(60)
    h, n = np.diff(t), 60
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(a, b)
    at = (t[:-1] + t[1:]) / 2
    wanted = (y[:-1] + y[1:]) / 2 - h**2 * (m[:-1] + m[1:]) / 16
    assert np.allclose(sequences.natural_spline(t, y, at), wanted)
    assert len(sequences.natural_spline(np.arange(50_000.0), np.arange(50_000.0), np.array([0.5]))) == 1


def test_buildings_of_faces(spark):
    rnd = random.Random(5)
    faces = [(k, *rnd.sample(range(90), 3)) for k in range(120)]
    parent = list(range(120))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edges = [{frozenset(p) for p in ((a, b), (b, c), (c, a))} for _, a, b, c in faces]
    for i in range(120):
        for j in range(i):
            if edges[i] & edges[j]:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = pose_queries.face_buildings(spark.createDataFrame(faces, "f long, a long, b long, c long"))
    assert {r.f: r.building for r in got.collect()} == {k: find(k) for k in range(120)}


def test_colmap_text_and_matrices(spark, tmp_path):
    for name in ("m1", "m2"):
        (tmp_path / name).mkdir()
    text = "# list\n# two lines each\n7 1 0 0 0 0.5 1 2 3 a.jpg\n1.0 2.0 -1\n9 0.5 0.5 0.5 0.5 1 2 3 4 b.jpg\n\n"
    (tmp_path / "m1" / "images.txt").write_text(text)
    rows = trajectories.colmap_images_text(spark, str(tmp_path / "m1" / "images.txt")).orderBy("image_id").collect()
    assert [(r.image_id, r.qw, r.tx, r.camera_id, r.name) for r in rows] == [(7, 1.0, 0.5, 3, "a.jpg"), (9, 0.5, 1.0, 4, "b.jpg")]
    assert trajectories.colmap_model(spark, str(tmp_path / "*")).count() == 2
    (tmp_path / "k.txt").write_text("500 0 320\n0 510 240 # y\n0 0 1\n")
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    k = trajectories.matrix_intrinsics(spark, str(tmp_path / "*.txt")).collect()
    assert [(r.fx, r.fy, r.cx, r.cy) for r in k] == [(500, 510, 320, 240)]


def test_array_meshes(spark, tmp_path):
    np.savez(tmp_path / "a.npz", vertices=np.eye(3), faces=np.array([[0, 1, 2]]), utm_offset=np.array([100.0, 200, 0]), labels=np.array(["roof"]))
    np.savez(tmp_path / "b.npz", vertices=np.eye(3), faces=np.array([[2, 1, 0]]))
    v, f = grids.array_meshes(spark, str(tmp_path / "*.npz"))
    assert sorted((r.x, r.y) for r in v.where("path like '%a.npz'").collect()) == [(100, 200), (100, 201), (101, 200)]
    assert sorted((r.a, r.label) for r in f.collect()) == [(0, "roof"), (2, "building")]
