import numpy as np
import pandas as pd

from aerolattice.operators import sequences


def test_chained_poses(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(1, 0, np.eye(3).reshape(-1).tolist(), -1.0, 0.0, 0.0, True), (1, 1, turn, 0.0, 0.0, 0.0, True), (1, 2, turn, 5.0, 5.0, 5.0, False), (1, 3, np.eye(3).reshape(-1).tolist(), -1.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["seq", "ord", "rel", "tx", "ty", "tz", "ok"]))
    got = sequences.chained_poses(df).orderBy("ord").collect()
    assert [(round(r.x, 9), round(r.y, 9)) for r in got] == [(1, 0), (1, 0), (1, 0), (1, -1)]
    assert got[1].rotation == got[2].rotation


def test_natural_spline_keeps_knots_and_lines():
    t = np.linspace(0, 1, 9)
    assert np.allclose(sequences.natural_spline(t, t**3 - t, t), t**3 - t)
    assert np.allclose(sequences.natural_spline(t, 3 * t + 1, np.linspace(0, 1, 31)), 3 * np.linspace(0, 1, 31) + 1)
    assert np.allclose(sequences.natural_spline(np.array([0.0, 1.0]), np.array([2.0, 4.0]), np.array([0.5])), 3)


def test_resampled_lengths_and_noise(spark):
    rows = [(s, k, float(k) * s, 0.0, 0.0) for s in (1, 4) for k in range(10)]
    df = spark.createDataFrame(rows, "seq long, ord long, x double, y double, z double")
    got = sequences.resampled(df, ["x", "y", "z"], target=60.0)
    assert dict(map(tuple, got.groupBy("seq").count().collect())) == {1: 10, 4: 20}
    one = sequences.perturbed(df, {"x": 0.5, "y": 0.1}).orderBy("seq", "ord").collect()
    assert one == sequences.perturbed(df.repartition(3), {"x": 0.5, "y": 0.1}).orderBy("seq", "ord").collect()
    noise = np.array([r.x - k * r.seq for r, k in zip(one, list(range(10)) * 2, strict=True)])
    assert np.allclose([noise[:10].std(), noise[10:].std()], 0.5)


def test_butterworth_response():
    for cutoff in (0.02, 0.133, 0.6, 0.95):
        into, out = sequences.butterworth(cutoff)
        for share in (0.0, 0.3 * cutoff, cutoff, min(1.2 * cutoff, 0.99)):
            z = np.exp(-1j * np.pi * share * np.arange(6))
            wanted = 1 / np.sqrt(1 + (np.tan(np.pi * share / 2) / np.tan(np.pi * cutoff / 2)) ** 10)
            assert np.isclose(abs((into @ z) / (out @ z)), wanted, rtol=1e-6)


def test_filter_both_ways():
    t = np.arange(2000)
    waves = [np.sin(np.pi * share * t + 0.3) for share in (0.05, 0.2, 0.3)]
    got = sequences.filtered_both_ways(np.column_stack([*waves, np.full(2000, 7.0)]), [0.2] * 4)
    for wave, share, k in zip(waves, (0.05, 0.2, 0.3), range(3), strict=True):
        gain = 1 / (1 + (np.tan(np.pi * share / 2) / np.tan(np.pi * 0.1)) ** 10)  # squared, and without a shift
        assert np.allclose(got[300:1700, k], gain * wave[300:1700], atol=1e-6)
    assert np.allclose(got[:, 3], 7.0)
    bump = np.zeros((401, 1))
    bump[200] = 1
    answer = sequences.filtered_both_ways(bump, [0.2])[:, 0]
    assert np.allclose(answer, answer[::-1], atol=1e-9) and np.isclose(answer.sum(), 1.0)
    line = np.linspace(0, 5, 30)[:, None]
    assert np.allclose(sequences.filtered_both_ways(line, [0.3]), line, atol=0.05)
    assert sequences.filtered_both_ways(line[:13], [0.3]).shape == (13, 1)


def test_sensor_noise(spark):
    rows = [(s, k, *[0.0] * 6, 52.0, 13.0, 100.0) for s, n in ((1, 400), (2, 12), (3, 400)) for k in range(n)]
    names = ["x", "y", "z", "roll", "pitch", "yaw", "latitude", "longitude", "altitude"]
    df = spark.createDataFrame(rows, "seq long, ord long, " + ", ".join(f"{c} double" for c in names))
    got = sequences.with_noise(df, 0.5).toPandas().sort_values(["seq", "ord"])
    assert got.equals(sequences.with_noise(df.repartition(5), 0.5).toPandas().sort_values(["seq", "ord"]).set_index(got.index))
    one, three = got[got.seq == 1], got[got.seq == 3]
    assert np.isclose(one.roll.std(ddof=0), 0.15) and np.isclose(one.yaw.std(ddof=0), 0.1) and 0.04 < one.x.std(ddof=0) < 0.11
    assert not np.allclose(one.x, three.x) and np.allclose((one.latitude - 52) * 111320, one.x) and np.allclose(one.altitude - 100, one.z)
    assert abs(np.diff(one.yaw)).max() < 0.05  # smooth: nothing above half a Hz
    assert (got[got.seq == 2][names] == [0.0] * 6 + [52.0, 13.0, 100.0]).all(axis=None)
    assert sequences.with_noise(df, 0.0).where("x <> 0").count() == 0 and sequences.with_noise(df.where("false"), 1.0).count() == 0
