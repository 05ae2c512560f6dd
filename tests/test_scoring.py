import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.config import Settings
from stepweave.errors import QualityError
from stepweave.operators import scoring

rng = np.random.default_rng(0)
CASES = {
    "ramp": np.linspace(0, 1, 50)[:, None],
    "sine": np.sin(np.linspace(0, 2 * math.pi, 50))[:, None],
    "noise": rng.normal(size=(50, 1)) * 10,
    "swing": np.array([(-1.0) ** i for i in range(50)])[:, None],
    "short": np.zeros((5, 1)),
    "nan": np.array([0.0] * 7 + [math.nan] + [0.0] * 12)[:, None],
    "still": np.zeros((20, 1)),
    "many": rng.normal(size=(40, 1)),
}


def by_hand(a):
    if len(a) < 10 or np.isnan(a).any():
        return None, None
    j = np.diff(a, 3, axis=0)
    smooth = 1 / (1 + math.sqrt((j**2).mean()))
    d = np.diff(a, axis=0)
    m = np.linalg.norm(d, axis=1)
    x, y = m[:-1], m[1:]
    auto = 1.0 if x.std() < 1e-9 or y.std() < 1e-9 else np.corrcoef(x, y)[0, 1]
    turn = (np.sign(d[1:]) != np.sign(d[:-1])).any(axis=1).mean()
    return smooth, min(1, max(0, auto) * (1 - turn))


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(name, i, i * 33_333_333, [float(x) for x in v]) for name, a in CASES.items() for i, v in enumerate(a)]
    return spark.createDataFrame(rows, "episode_id string, step int, t_ns bigint, action array<double>").withColumn("a", F.col("action")[0]).cache()


@pytest.mark.parametrize("actions", ["action", ["a"]])
def test_scores_by_hand(steps, actions):
    got = {r["episode_id"]: r for r in scoring.score(steps, actions, ["step"]).collect()}
    for name, a in CASES.items():
        smooth, steady = by_hand(a)
        if smooth is None:
            assert got[name]["smoothness"] is None and got[name]["overall"] is None
        else:
            assert got[name]["smoothness"] == pytest.approx(smooth) and got[name]["consistency"] == pytest.approx(steady, abs=1e-9)
    assert got["ramp"]["smoothness"] == pytest.approx(1.0) and got["sine"]["smoothness"] > 0.7 and got["noise"]["smoothness"] < 0.5
    assert got["swing"]["consistency"] < 0.5 and got["ramp"]["consistency"] > 0.8


def test_weights_after_registering():
    share = lambda: F.avg(F.lit(1.0))
    one = scoring.Metrics().register("x", share, 0.2)
    assert one.weights == pytest.approx({"smoothness": 0.32, "consistency": 0.28, "completeness": 0.20, "x": 0.20})
    two = scoring.Metrics().register("x", share, 0.1).register("y", share, 0.1)
    assert two.weights["smoothness"] == pytest.approx(0.4 * 0.81)
    assert one.register("x", share, 0.2).weights == one.weights
    for name, w in (("smoothness", 0.1), ("z", 0.0), ("z", 1.0), ("z", True)):
        with pytest.raises(QualityError):
            scoring.Metrics().register(name, share, w)


def test_weights_are_checked():
    with pytest.raises(QualityError):
        Settings(weights={"smoothness": 1.0})
    with pytest.raises(QualityError):
        Settings(weights={"smoothness": 0.5, "consistency": 0.5, "completeness": 0.5})


def test_custom_value_out_of_range(steps):
    metrics = scoring.Metrics().register("big", lambda: F.max(F.lit(2.0)), 0.2)
    with pytest.raises(Exception, match="outside"):
        scoring.score(steps, ["a"], ["step"], metrics=metrics).collect()


def test_report_and_outliers(spark):
    own = np.random.default_rng(17).beta(5, 2, 36)
    own[[4, 20]] = 0.001, 0.003
    odd = spark.createDataFrame([(i, float(x)) for i, x in enumerate(own)], "episode_id int, overall double")
    r = scoring.report(odd).first()
    assert r["median"] == pytest.approx(np.median(own)) and r["std"] == pytest.approx(np.std(own)) and r["mean"] == pytest.approx(own.mean())
    want = np.flatnonzero(np.abs(own - own.mean()) > 2 * own.std()).tolist()
    assert sorted(r["episode_id"] for r in scoring.outliers(odd).collect()) == want and {4, 20} <= set(want)
    assert scoring.tracker_stats(odd.where("episode_id = 4")).first()["std"] == 0.0
    with pytest.raises(QualityError):
        scoring.at_least(odd, True)


def test_success_and_duration(spark):
    rows = [("a", i, i * 1_000_000_000, float(i), True) for i in range(12)] + [("b", i, i * 1_000_000_000, float(i), False) for i in range(12)] + [("c", i, i * 1_000_000_000, float(i), None) for i in range(16)]
    df = spark.createDataFrame(rows, "episode_id string, step int, t_ns bigint, a double, ok boolean")
    got = {r["episode_id"]: r["completeness"] for r in scoring.score(df, ["a"], ["step"], success=F.col("ok")).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.5})
