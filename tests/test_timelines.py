import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.errors import IngestError
from stepweave.operators import align, segment


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(3)
    rows = []
    for rec in ("x", "y"):
        for stream, n in (("p", 40), ("q", 25)):
            t = np.sort(r.choice(10_000, n, replace=False))
            rows += [(rec, stream, int(a), float(b)) for a, b in zip(t, r.normal(size=n), strict=True)]
    return spark.createDataFrame(rows, "recording_id string, stream string, t_ns bigint, value double").cache()


def test_linear_equals_numpy(samples):
    got = {(r["recording_id"], r["stream"], r["t_ns"]): r["value"] for r in align.align(samples, step_ns=37).collect()}
    own = samples.toPandas()
    n = 0
    for rec, g in own.groupby("recording_id"):
        spans = g.groupby("stream").t_ns.agg(["min", "max"])
        grid = np.arange(spans["min"].max(), spans["max"].min() + 1, 37)
        for stream, s in g.groupby("stream"):
            want = np.interp(grid, s.t_ns, s.value)
            assert [got[rec, stream, t] for t in grid] == pytest.approx(want)
            n += len(grid)
    assert n == len(got)


def test_nearest_prefers_the_earlier(spark):
    df = spark.createDataFrame([("r", "s", t, v) for t, v in ((0, 1.0), (10, 2.0), (20, 3.0))], "recording_id string, stream string, t_ns bigint, value double").withColumn("kind", F.lit("image"))
    got = [r["value"] for r in align.align(df, step_ns=5, kind="kind").orderBy("t_ns").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0, 3.0]


def test_no_overlap_and_bad_rate(spark):
    df = spark.createDataFrame([("r", "a", 0, 1.0), ("r", "a", 5, 1.0), ("r", "b", 10, 1.0), ("r", "b", 15, 1.0)], "recording_id string, stream string, t_ns bigint, value double")
    assert align.align(df, step_ns=5).count() == 0
    with pytest.raises(IngestError):
        align.align(df, hz=0)


def recording(spark, closed):
    rows = [("r", i, i * 20_000_000, 0.011 if i in closed else 0.03, 0.002 if i in closed else 0.4) for i in range(150)]
    return spark.createDataFrame(rows, "recording_id string, i int, t_ns bigint, grip double, vel double")


def test_gripper_gives_five_segments(spark):
    own = recording(spark, {*range(33, 47), *range(90, 101)})
    found = segment.transitions(own, F.col("grip") > segment.OPEN)
    assert sorted(r["i"] for r in found.collect()) == [32, 46, 89, 100]
    assert segment.cut(own, found).select("segment").distinct().count() == 5


def test_pauses_give_three_segments(spark):
    own = recording(spark, {*range(33, 47), *range(90, 101)})
    found = segment.pauses(own, F.abs("vel") < segment.STILL)
    assert sorted((r["first"], r["last"], r["middle"]) for r in found.collect()) == [(33, 47, 40), (90, 101, 95)]
    assert segment.cut(own, found.select("recording_id", F.col("middle").alias("i"))).select("segment").distinct().count() == 3
    trailing = segment.pauses(recording(spark, range(139, 150)), F.abs("vel") < segment.STILL).collect()
    assert [(r["first"], r["last"]) for r in trailing] == [(139, 149)]


def test_marker_takes_the_step_at_or_after(spark):
    own = recording(spark, ())
    marks = spark.createDataFrame([("r", 20_000_001), ("r", 40_000_000), ("r", 10**12)], "recording_id string, marker_ns bigint")
    assert sorted(r["i"] for r in segment.markers_to_steps(own, marks).collect()) == [2, 149]


def test_choice_of_what_cuts(spark):
    streams = spark.createDataFrame([("a", "gripper"), ("a", "joint_vel"), ("b", "joint_vel"), ("c", "x"), ("d", "x")], "recording_id string, stream string")
    marks = spark.createDataFrame([("c", 1)], "recording_id string, marker_ns bigint")
    got = {r["recording_id"]: r["by"] for r in segment.choose("auto", streams, marks).collect()}
    assert got == {"a": "gripper", "b": "velocity", "c": "markers", "d": "none"}
    with pytest.raises(IngestError):
        segment.choose("other", streams, marks)


def test_samples_without_a_value_are_no_neighbours(spark):
    rows = [("a", "x", 0, 0.0), ("a", "x", 10, None), ("a", "x", 20, 20.0), ("a", "x", 30, 30.0), ("a", "x", 30, 28.0), ("a", "x", None, 5.0)]
    got = align.align(spark.createDataFrame(rows, "recording_id string, stream string, t_ns bigint, value double"), step_ns=5)
    assert [(r["t_ns"], r["value"]) for r in got.orderBy("t_ns").collect()] == [(0, 0.0), (5, 5.0), (10, 10.0), (15, 15.0), (20, 20.0), (25, 25.0), (30, 30.0)]


def test_only_joint_vel_is_the_velocity(spark):
    streams = spark.createDataFrame([("a", "robot_cmd_vel"), ("b", "Gripper"), ("b", "joint_vel"), ("c", "left_gripper_pos")], "recording_id string, stream string")
    marks = spark.createDataFrame([("a", 1)], "recording_id string, marker_ns bigint")
    assert {r["recording_id"]: r["by"] for r in segment.choose("auto", streams, marks).collect()} == {"a": "markers", "b": "velocity", "c": "gripper"}
