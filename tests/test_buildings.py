"""Merged parts of meshes against all pairs of vertices."""

import numpy as np
import pytest

from aerolattice.operators import buildings


def plain(faces, vertices, reach=1.0, small=20, within=5.0):
    parts = sorted({f[5] for f in faces})
    is_building = {p: any(f[5] == p and f[4] in buildings.BUILDING for f in faces) for p in parts}
    corners = {p: np.array([vertices[v] for v in sorted({v for f in faces if f[5] == p for v in f[1:4]})]) for p in parts if is_building[p]}
    group = {p: p for p in corners}
    changed = True
    while changed:
        changed = False
        for p in corners:
            for q in corners:
                if group[p] < group[q] and (np.linalg.norm(corners[p][:, None] - corners[q][None], axis=2) <= reach).any():
                    old = group[q]
                    group = {k: group[p] if g == old else g for k, g in group.items()}
                    changed = True
    count = {g: sum(f[5] in corners and group[f[5]] == g for f in faces) for g in set(group.values())}
    middle = {g: np.concatenate([corners[p] for p in corners if group[p] == g]).mean(0) for g in count}
    final = dict(zip(count, count, strict=True))
    for g in count:
        if count[g] < small:
            near = sorted((np.linalg.norm(middle[g] - middle[h]), h) for h in count if count[h] >= small)
            if near and near[0][0] <= within:
                final[g] = near[0][1]
    return {f[0]: final[group[f[5]]] if f[5] in corners else f[5] for f in faces}


@pytest.mark.parametrize("seed", range(4))
def test_merged_parts_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    faces, vertices = [], {}
    for part in range(40):
        n = int(rng.integers(1, 40))
        centre = rng.uniform(0, 28, 3) * [1, 1, 0.2]
        points = centre + rng.normal(size=(n, 3)) * rng.choice([0.3, 1.5])
        first = len(vertices)
        vertices |= {first + k: p for k, p in enumerate(points)}
        label = ["wall", "roof", "other", None][int(rng.choice(4, p=[0.5, 0.3, 0.1, 0.1]))]
        faces += [(len(faces) + k, *map(int, first + rng.integers(0, n, 3)), label if k else "other", 7 + 3 * part) for k in range(n)]
    df = spark.createDataFrame(faces, "f long, a long, b long, c long, label string, part long")
    at = spark.createDataFrame([(k, *map(float, p)) for k, p in vertices.items()], "v long, x double, y double, z double")
    got = dict(map(tuple, buildings.merged_parts(df, at).collect()))
    assert got == plain(faces, vertices)
    assert len(set(got.values())) < 40
    if not seed:
        assert buildings.merged_parts(df.where("false"), at).count() == 0
