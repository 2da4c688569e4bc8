import json
import struct

import numpy as np

from aerolattice.sources import grids, sinks, trajectories


def test_document(spark, tmp_path):
    frame = {"position": {"x": 1.0, "y": 2.0, "z": 3.0}, "rotation": {"x": 0.0, "y": 0.0, "z": 9.0}, "coordinate": {"latitude": 52.5, "longitude": 13.4, "altitude": 200.0}, "fovVertical": 25.0}
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "width": 4, "height": 3, "frameRate": 30, "numFrames": 1, "cameraFrames": [frame, frame]}))
    rows = trajectories.document_frames(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.n_frames, r.coordinate.latitude) for r in rows] == [(0, 2, 52.5), (1, 2, 52.5)]


def test_poses_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("frame_id,x,y,z,qw,qx,qy,qz,extra\n3,1.5,2,3,1,0,0,0,n\n5,x,2,3,1,0,0,0,n\n")
    df = trajectories.poses(spark, str(tmp_path / "in.csv"))
    sinks.write_poses(df, str(tmp_path / "out"))
    back = trajectories.poses(spark, str(tmp_path / "out")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.x, r.qw, r.yaw) for r in back] == [(3, 1.5, 1.0, None), (5, None, 1.0, None)]


def test_tum_skips_and_last_wins(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n\n0.5 1 2 3 0 0 0 1\n1.0 1\n0.5 9 2 3 0 0 0 1\n2.5 4 4 4 0 0 0 1\n")
    rows = trajectories.tum(spark, str(tmp_path / "t.txt")).orderBy("ts").collect()
    assert [(r.ts, r.x, r.frame_id) for r in rows] == [(0.5, 9.0, 0), (2.5, 4.0, 2)]


def test_matrices_keys_and_splits(spark, tmp_path):
    (tmp_path / "m.txt").write_text(" ".join(map(str, range(16))) + "\n" + " ".join(["1"] * 16) + "\n")
    assert [(r.frame_id, r.c2w[5]) for r in trajectories.flat_matrices(spark, str(tmp_path / "m.txt")).orderBy("frame_id").collect()] == [(0, 5.0), (1, 1.0)]
    (tmp_path / "k.txt").write_text("fx = 10.5 # focal\nbad\nfy=3\n")
    assert trajectories.key_values(spark, str(tmp_path / "k.txt")).first()["values"] == {"fx": 10.5, "fy": 3.0}
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "val": []}))
    assert sorted(map(tuple, trajectories.splits(spark, str(tmp_path / "s.json")).collect())) == [("train", "a"), ("train", "b")]
    (tmp_path / "i.json").write_text(json.dumps({"fx": 100.0, "width": 40, "height": 20, "k1": 0.1}))
    row = trajectories.intrinsics(spark, str(tmp_path / "i.json")).first()
    assert (row.fy, row.cx, row.cy, row.distortion) == (100.0, 20.0, 10.0, [0.1, 0.0, 0.0, 0.0, 0.0])


def test_colmap(spark, tmp_path):
    one = struct.pack("<I7dI", 7, 1, 0, 0, 0, 1, 2, 3, 1) + b"frame_1.jpg\0" + struct.pack("<Q", 1) + bytes(24)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + one + one.replace(b"_1", b"_2"))
    rows = trajectories.colmap_images(spark, str(tmp_path / "images.bin")).orderBy("name").collect()
    assert [(r.image_id, r.qw, r.tz, r.name) for r in rows] == [(7, 1.0, 3.0, "frame_1.jpg"), (7, 1.0, 3.0, "frame_2.jpg")]


def test_rasters_depth_and_points(spark, tmp_path):
    z = np.arange(30, dtype=np.float32).reshape(5, 6)
    z[0, 0] = -9999
    np.savez(tmp_path / "dsm.npz", height=z, bounds=np.zeros(4), gsd=np.float32(1))
    cells = grids.cells(grids.raster_blocks(spark, str(tmp_path / "dsm.npz"), block=4), block=4).collect()
    assert {(r.row, r.col): r.z for r in cells} == {(r, c): None if r == c == 0 else float(z[r, c]) for r in range(5) for c in range(6)}
    np.savez(tmp_path / "d.npz", depth=np.array([[0, 1, 65535]], np.uint16), depth_min=np.float32(2), depth_max=np.float32(10))
    assert list(grids.depth_blocks(spark, str(tmp_path / "d.npz")).first()["values"]) == [0.0, 2.0, 10.0]
    np.savez(tmp_path / "p.npz", points=np.ones((2, 3), np.float32))
    assert [tuple(r)[1:] for r in grids.points(spark, str(tmp_path / "p.npz")).collect()] == [(1.0, 1.0, 1.0, None, None)] * 2


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2 3 4\n")
    (tmp_path / "b.obj").write_text("v 0 0 1\nv 1 0 1\nv 1 1 1\nf 1 2 3\n")
    vertices, faces = grids.obj_mesh(spark, str(tmp_path / "*.obj"))
    moved, own = grids.merged_meshes(vertices, faces)
    assert moved.count() == 7
    assert sorted((r.a, r.b, r.c) for r in own.collect()) == [(0, 1, 2), (0, 2, 3), (4, 5, 6)]
