import numpy as np

from aerolattice.operators import mesh, render, sequences


def scene(spark):
    vertices = spark.createDataFrame([(0, -10.0, -10.0, 20.0), (1, 10.0, -10.0, 20.0), (2, 0.0, 10.0, 20.0), (3, -1.0, -10.0, 10.0), (4, 1.0, -10.0, 10.0), (5, 0.0, 30.0, -5.0)], "v long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 1, 2), (2, 3, 4, 5)], "f long, a long, b long, c long")
    return faces, vertices


def test_nearest_face_wins_and_faces_behind_are_clipped(spark):
    faces, vertices = scene(spark)
    got = render.depth_image(faces, vertices, np.eye(3).reshape(-1).tolist(), [0.0, 0.0, 0.0], 20.0, 20, 20)
    cells = {(r.row, r.col): (round(r.z, 6), r.f) for r in got.collect()}
    assert cells[5, 4] == (20.0, 1)
    assert cells[10, 10][1] == 2 and cells[10, 10][0] < 20
    assert cells == {(r.row, r.col): (round(r.z, 6), r.f) for r in render.depth_image(faces.repartition(2), vertices, np.eye(3).reshape(-1).tolist(), [0.0, 0.0, 0.0], 20.0, 20, 20).collect()}


def test_clipping_counts():
    t = np.array([[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, -1.0]])
    assert len(render.clipped(t, 0.5)) == 2 and len(render.clipped(-t, 0.5)) == 1
    assert len(render.clipped(t + [0, 0, 5], 0.5)) == 1 and render.clipped(t - [0, 0, 5], 0.5) == []


def test_wireframe(spark):
    faces, vertices = scene(spark)
    points = render.wireframe(mesh.edges(faces.where("f = 1")), vertices, 5.0)
    assert points.where("low = 0 and high = 1").count() == 5
    assert [r.x for r in points.where("low = 0 and high = 1").orderBy("k").collect()] == [-10, -5, 0, 5, 10]


def test_jitter_and_gusts_repeat(spark):
    df = spark.range(40).selectExpr("id % 4 as seq", "cast(floor(id / 4) as bigint) as ord", "0.0D as yaw")
    one = sequences.jittered(df, "yaw", 2.0, share=1.0)
    assert sorted(round(r.yaw, 6) for r in one.where("seq = 1 and yaw <> 0").collect()) == [-0.7, -0.1, 0.3, 1.2]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, sequences.jittered(df.repartition(3), "yaw", 2.0, share=1.0).collect()))
    blown = sequences.gusts(df, "yaw", 0.5, frames=5, share=1.0).collect()
    assert max(abs(r.yaw) for r in blown) <= 0.5 and any(r.yaw for r in blown)
    assert all(r.yaw == 0 for r in sequences.gusts(df, "yaw", 0.5, share=0.0).collect())
