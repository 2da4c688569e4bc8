import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolattice.plans.fixtures import relation
from aerolattice.streaming import tracking

SF = "/root/testdata/sf0.001"


def frames(rows):
    return pd.DataFrame(rows, columns=["seq", "ord", "x", "y", "tracked", "err", "failed"])


def run(spark, rows):
    df = spark.createDataFrame(frames(rows))
    return [tuple(r) for r in tracking.track_batch(df).orderBy("seq", "ord").collect()]


def test_first_frame_must_localise(spark):
    got = run(spark, [(1, 0, 0.0, 0.0, 200, 0.0, True), (1, 1, 0.0, 0.0, 200, 0.0, False), (1, 2, 1.0, 0.0, 200, 0.0, False)])
    assert [g[2] for g in got] == ["failed", "keyframe", "tracked"]
    assert [g[4] for g in got] == [-1, 1, 1]


def test_points_and_interval(spark):
    rows = [(1, k, float(k), 0.0, 200 if k == 0 else 50, 0.0, False) for k in range(7)]
    got = run(spark, rows)
    assert [g[2] for g in got] == ["keyframe", "tracked", "tracked", "tracked", "tracked", "keyframe", "tracked"]
    assert got[5][3] == "low_points"


def test_jump_fails_and_five_failures_relocalise(spark):
    rows = [(1, k, float(k), 0.0, 200, 0.0, False) for k in range(4)] + [(1, 4 + k, 900.0 + k, 0.0, 200, 0.0, False) for k in range(6)]
    got = run(spark, rows)
    assert [g[2] for g in got[4:]] == ["failed"] * 4 + ["re-localized", "tracked"]
    assert got[4][3] == "jump"


def test_stream_gives_what_batch_gives(spark, tmp_path):
    df = relation(spark, SF, "path").select(*[F.col(c) for c in tracking.IN])
    source, schema = str(tmp_path / "in"), df.schema
    for low, high in ((0, 20), (20, 45), (45, 10_000)):
        df.where(f"ord >= {low} and ord < {high}").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    query = tracking.track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("tracked").collect()))
    assert got == sorted(map(tuple, tracking.track_batch(df).collect()))


def test_late_frames_and_gaps(spark, tmp_path):
    """After frames 0, 10 and 20 a frame 5 is late, however few have been counted."""
    source = str(tmp_path / "in")
    schema = spark.createDataFrame(frames([(1, 0, 0.0, 0.0, 200, 0.0, False)])).schema
    for k, orders in enumerate(((0, 10, 20), (5, 30), (15, 31))):
        spark.createDataFrame(frames([(1, o, 0.0, 0.0, 200, 0.0, False) for o in orders]), schema).coalesce(1).write.mode("append").json(f"{source}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    query = tracking.track_stream(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.ord for r in spark.table("late").collect()) == [0, 10, 20, 30, 31]


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    assert tracking.track_batch(relation(spark, SF, "path").where("false")).count() == 0
