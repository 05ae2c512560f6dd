import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.errors import IngestError
from stepweave.sources import ingest, messages

MS = 1_000_000


def recording(name, streams):
    """streams: {stream: (milliseconds, function of seconds)}."""
    return [(name, s, int(t) * MS, [float(x) for x in f(t / 1000)]) for s, (times, f) in streams.items() for t in times]


def plain(rows, hz):
    """Times and interpolated streams of one recording, by numpy."""
    own = {}
    for _, s, t, v in sorted(rows, key=lambda r: r[2]):
        own.setdefault(s, []).append((t, v))
    lo, hi = max(v[0][0] for v in own.values()), min(v[-1][0] for v in own.values())
    times = np.arange(lo, hi + 1, int(1e9 / hz))
    at = {s: np.stack([np.interp(times, [t for t, _ in v], col) for col in zip(*[x for _, x in v], strict=True)], 1) for s, v in own.items()}
    return times, at


def test_recordings_are_aligned_and_cut(spark):
    ticks, slow = np.arange(0, 2001, 10), np.arange(5, 1990, 33)
    rest = lambda t: (0.0 if 0.8 <= t < 1.2 else 1.0, 0.0)
    rows = {
        "grip": recording("grip", {"left_gripper": (ticks, lambda t: (0.04 if 0.5 <= t < 1.3 else 0.0,)), "joint_vel": (ticks, rest), "action_arm": (slow, lambda t: (t, -t))}),
        "rest": recording("rest", {"joint_vel": (ticks, rest), "x": (slow, lambda t: (t, 2 * t, 3.0))}),
        "mark": recording("mark", {"cmd_vel": (ticks, rest), "action": (slow, lambda t: (t,))}),
    }
    df = spark.createDataFrame([r for own in rows.values() for r in own] + [("grip", "x_lost", None, [1.0]), ("rest", "x", 20, None)], "recording_id string, stream string, t_ns bigint, values array<double>")
    marks = spark.createDataFrame([("mark", 701 * MS), ("grip", 100 * MS)], "recording_id string, marker_ns bigint")
    steps = ingest.cut_recordings(df, marks, hz=50.0).orderBy("recording_id", "t_ns").collect()
    for name, own in rows.items():
        times, at = plain(own, 50.0)
        got = [r for r in steps if r["recording_id"] == name]
        if name == "grip":
            cuts = np.flatnonzero(np.diff((at["left_gripper"][:, 0] > 0.02).astype(int)))
        elif name == "rest":
            still = np.flatnonzero(np.abs(at["joint_vel"]).max(1) < 0.01)
            cuts = [still[0] + (still[-1] + 1 - still[0]) // 2]
        else:
            cuts = [int(np.searchsorted(times, 701 * MS))]
        want = np.searchsorted(np.asarray(cuts) + 1, np.arange(len(times)), "right")
        assert [r["t_ns"] for r in got] == times.tolist() and [r["segment"] for r in got] == want.tolist()
        act = next((s for s in at if s.startswith("action")), None)
        assert np.allclose([r["action"] for r in got], at[act]) if act else all(r["action"] == [] for r in got)
        for s in at.keys() - {act}:
            assert np.allclose([r["obs"][s] for r in got], at[s])
        assert all(set(r["obs"]) == at.keys() - {act} for r in got) and got[0]["step"] == 0
    whole = ingest.cut_recordings(df, marks, strategy="none")
    assert whole.select("episode_id").distinct().count() == 3


def test_messages_are_projected_like_tables():
    xyz = lambda a, b, c: SimpleNamespace(x=a, y=b, z=c)
    assert messages.sampled("/robot/cmd_vel", "Twist", SimpleNamespace(linear=xyz(1, 2, 3), angular=xyz(4, 5, 6))) == [("robot_cmd_vel", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    assert messages.sampled("/j", "JointState", SimpleNamespace(position=[1], velocity=[])) == [("joint_pos", [1.0])]
    assert messages.sampled("/odd", "Image", None) == []


def test_folders(spark, tmp_path):
    for name in ("b_set", "a_set"):
        root = tmp_path / "in" / name
        (root / "meta").mkdir(parents=True)
        (root / "meta" / "info.json").write_text(json.dumps({"fps": 10, "features": {"action": {"dtype": "float32"}}}))
        own = spark.range(6).select((F.col("id") % 2).alias("episode_index"), F.floor(F.col("id") / 2).cast("int").alias("frame_index"), F.array(F.col("id") * 1.0).alias("action"))
        own.coalesce(1).write.parquet(str(root / "data" / "chunk-000"))
    bad = tmp_path / "in" / "c_bad"
    (bad / "meta").mkdir(parents=True)
    (bad / "meta" / "info.json").write_text("{")
    (tmp_path / "in" / "run.mcap").write_bytes(b"no recording")
    errors, stats = [], {}
    steps, episodes = ingest.ingest(spark, str(tmp_path / "in"), errors=errors, stats=stats)
    assert stats == {"files_succeeded": 2} and sorted(e["path"].rsplit("/", 1)[1] for e in errors) == ["c_bad", "run.mcap"]
    assert steps.count() == 12 and episodes.count() == 4 and {r["n_steps"] for r in episodes.collect()} == {3}
    assert {r["duration_ns"] for r in episodes.collect()} == {200 * MS}
    one, _ = ingest.ingest(spark, str(tmp_path / "in" / "a_set"), stats=stats)
    assert one.count() == 6 and stats == {"files_succeeded": 1}
    with pytest.raises(IngestError):
        ingest.ingest(spark, str(bad))
    with pytest.raises(IngestError):
        ingest.ingest(spark, str(tmp_path / "in" / "a_set"), fmt="odd")
    (tmp_path / "empty").mkdir()
    assert ingest.ingest(spark, str(tmp_path / "empty"))[0].count() == 0
