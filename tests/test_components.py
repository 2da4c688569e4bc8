"""Touching boxes and components of links against all pairs."""

import numpy as np
import pytest

from aerolattice.operators import joins, mesh


def plain(nodes, links):
    group = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return group


@pytest.mark.parametrize("crowded", [5000, 12])
def test_touching_boxes_against_all_pairs(spark, crowded):
    """With few boxes to a cell these are split, and large ones reach over whole cells."""
    rng = np.random.default_rng(crowded)
    low = rng.integers(-60, 260, (220, 2))
    rows = [(k, *map(float, p), *map(float, p + rng.integers(0, 90 if k % 20 == 0 else 12, 2))) for k, p in enumerate(low)]
    rows += [(1000 + k, *rows[k][1:]) for k in range(0, 220, 7)] + [(2000, None, 0.0, 9.0, 9.0)]
    links = joins.touching(spark.createDataFrame(rows, "box long, minx double, miny double, maxx double, maxy double"), "box", 40.0, crowded=crowded)
    touch = [(p[0], q[0]) for p in rows[:-1] for q in rows[:-1] if p[0] < q[0] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    wanted = plain({n for link in touch for n in link}, touch)
    assert dict(map(tuple, mesh.components(links).collect())) == wanted and len(set(wanted.values())) > 5


def test_many_boxes_in_one_place_give_few_links(spark):
    """Each pair of 3000 boxes overlaps: links must not grow with their square."""
    boxes = spark.range(3000).selectExpr("id AS box", "id / 100D AS minx", "(id * 7 % 3000) / 100D AS miny", "50 + id / 100D AS maxx", "50 + id / 100D AS maxy")
    assert joins.touching(boxes, "box", 100.0).count() < 40_000


def test_components_of_hubs_and_paths(spark):
    """Rounds of contraction, with nodes that many rows go to, give what one task gives."""
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(0, 300)] + [(5000, 5001 + k) for k in range(200)] + [tuple(map(int, p)) for p in rng.integers(400, 900, (200, 2))]
    df = spark.createDataFrame(links, "a long, b long")
    assert dict(map(tuple, mesh.components(df, few=10, heavy=20).collect())) == plain({n for link in links for n in link}, links)
    assert mesh.components(df.where("false")).count() == 0


def test_rows_of_a_heavy_key_stay_where_they_are(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS k")
    table = spark.range(4000).selectExpr("id AS k", "id * 2 AS v")
    found = joins.looked_up(df, table, ["k"], joins.heavy_keys(df, ["k"], 1000))
    assert found.where("v = 2 * k").count() == found.count() == 4000
    assert found.where("k = 7").selectExpr("spark_partition_id() AS p").distinct().count() == 4


@pytest.mark.parametrize("heavy", [100_000, 30])
def test_faces_of_crowded_edges(spark, heavy):
    """Edges that many faces share, faces of the same number, of no area and of no number."""
    rng = np.random.default_rng(8)
    faces = [(k, int(a), 1000 + int(b), 2000 + int(c)) for k, (a, b, c) in enumerate(rng.integers(0, [400, 3, 3], (500, 3)))]
    faces += [(600 + k, *map(int, 5000 + rng.integers(0, 60, 3))) for k in range(60)] + [(600, 7000, 7001, 7002), (700, 7001, 7000, 7003), (800, 9, 9, 9), (801, 1, 8000, 8000), (None, 5000, 1, 1001)]
    of_edge = {}
    for f, *corners in faces:
        for p, q in zip(corners, corners[1:] + corners[:1]):
            if f is not None and p != q:
                of_edge.setdefault(frozenset((p, q)), []).append(f)
    wanted = plain({f for f, *_ in faces if f is not None}, [(fs[0], f) for fs in of_edge.values() for f in fs])
    got = mesh.joined_faces(spark.createDataFrame(faces, "f long, a long, b long, c long"), heavy=heavy).collect()
    assert len(got) == len({r.f for r in got}) and {f: wanted[f] for f in wanted} == {f: f for f in wanted} | {r.f: r.component for r in got}


def test_crowded_edges_leave_few_links(spark, monkeypatch):
    """Faces about nine common edges: what is left to join up must not grow with the faces."""
    counted = []
    real = mesh.components
    monkeypatch.setattr(mesh, "components", lambda links: counted.append(links.distinct().count()) or real(links))
    faces = spark.range(3000).selectExpr("id AS f", "10000 + id DIV 2 AS a", "id % 3 AS b", "3 + id DIV 3 % 3 AS c")
    assert mesh.joined_faces(faces).select("component").distinct().count() == 3 and counted[0] <= 36
