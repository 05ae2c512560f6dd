import random
import time

import pytest
from pyspark.sql import functions as F

from stepweave.errors import ComposeError
from stepweave.operators import catalog, sampling
from stepweave.operators.ranking import global_rank


@pytest.fixture(scope="module")
def five(spark):
    rows = [("ep_0001", "wipe", "mover-7", 0.31), ("ep_0002", "wipe", "lifter", 0.55), ("ep_0003", "fold", "mover-7", 0.47), ("ep_0004", "fold", "lifter", 0.98), ("ep_0005", "wipe and fold", "crane", None)]
    return catalog.with_keys(spark.createDataFrame(rows, "episode_id string, task string, embodiment string, overall double")).cache()


def ids(df):
    return [r["episode_id"] for r in df.collect()]


def test_filters(five):
    assert ids(catalog.find(five, task="wipe", quality_min=0.4)) == ["ep_0002"]
    assert ids(catalog.find(five, task=["WIPE", "fo-ld"], embodiment="Mover 7")) == ["ep_0001", "ep_0003"]
    assert ids(catalog.find(five, task=[])) == [] and ids(catalog.find(five, task="none")) == []
    assert ids(catalog.find(five)) == [f"ep_000{i}" for i in range(1, 6)]
    assert ids(catalog.find(five, quality_max=0.55)) == ["ep_0001", "ep_0002", "ep_0003"]
    with pytest.raises(ComposeError):
        catalog.find(five, quality_min=0.9, quality_max=0.1)
    with pytest.raises(ComposeError):
        catalog.find(five, quality_min=2)


@pytest.mark.parametrize("raw", ["ALOHA-2", "  aloha2  ", "Aloha 2", "aloha 2", "a_l_o-ha2"])
def test_normal_form(spark, raw):
    from stepweave.functions.keys import normalise, normalise_text

    assert normalise_text(raw) == "aloha2" == spark.range(1).select(normalise(F.lit(raw))).first()[0]


def test_large_catalog_is_quick(spark):
    own = spark.range(100_000).select(F.format_string("ep_%06d", "id").alias("episode_id"), F.concat(F.lit("task"), F.col("id") % 5).alias("task_key"), F.concat(F.lit("robot"), F.expr("id div 5 % 5")).alias("embodiment_key"), ((F.col("id") % 100) / 100).alias("overall")).cache()
    own.count()
    catalog.find(own, task="task1", embodiment="robot1", quality_min=0.8).count()
    took = []
    for robot in ("robot2", "robot3", "robot4"):
        began = time.time()
        assert catalog.find(own, task="task1", embodiment=robot, quality_min=0.8).count() > 0
        took.append(time.time() - began)
    assert min(took) < 1


def greedy(sizes, limit):
    limit = min(limit, sum(sizes.values()))
    names = sorted(sizes)
    quota = {n: limit // len(names) + (i < limit % len(names)) for i, n in enumerate(names)}
    taken = {n: min(quota[n], sizes[n]) for n in names}
    left = limit - sum(taken.values())
    for n in names:
        more = min(left, sizes[n] - taken[n])
        taken[n], left = taken[n] + more, left - more
    return {n: k for n, k in taken.items() if k}


@pytest.mark.parametrize("seed", range(4))
def test_stratified_equals_greedy(spark, seed):
    r = random.Random(seed)
    sizes = {f"t{i}": r.randint(1, 30) for i in range(r.randint(1, 6))}
    limit = r.randint(0, 70)
    own = spark.createDataFrame([(f"{t}-{i}", t) for t, n in sizes.items() for i in range(n)], "episode_id string, task string")
    got = {r["task"]: r["count"] for r in sampling.sample(own, "stratified", limit, seed=seed).groupBy("task").count().collect()}
    assert got == greedy(sizes, limit)


def test_rare_stratum_stays(spark):
    own = spark.createDataFrame([(f"{t}{i}", t) for t, n in (("fold", 41), ("stir", 17), ("wipe", 2)) for i in range(n)], "episode_id string, task string")
    got = {r["task"]: r["count"] for r in sampling.sample(own, "stratified", 25).groupBy("task").count().collect()}
    assert got == greedy({"fold": 41, "stir": 17, "wipe": 2}, 25) and got["wipe"] == 2


def test_weighted_leaves_out_null(five):
    got = sampling.sample(five, "quality_weighted", 10, seed=1)
    assert got.count() == 4 and ids(got) == ids(sampling.sample(five.repartition(3), "quality_weighted", 10, seed=1))
    with pytest.raises(ComposeError):
        sampling.sample(five, "other", 1)


def test_global_rank(spark):
    own = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = global_rank(own, ["v"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001)) and all(r["rank"] == r["v"] + 1 for r in got)


def test_global_rank_of_rows_with_a_payload(spark):
    own = spark.range(300_000).select(F.xxhash64("id").alias("v"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("text"))
    got = global_rank(own, ["v"], parts=16).agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("top"), F.countDistinct("text").alias("texts")).first()
    assert tuple(got) == (300_000, 300_000, 300_000)


def test_strata_of_many_rows_rank_only_what_is_drawn(spark):
    own = spark.range(60_000).select(F.col("id").alias("episode_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("task"))
    got = sampling.sample(own, "stratified", 90, seed=4)
    assert {r["task"]: (r["n"], r["hi"]) for r in got.groupBy("task").agg(F.count("*").alias("n"), F.max("stratum_rank").alias("hi")).collect()} == {None: (30, 30), "t1": (30, 30), "t2": (30, 30)}
    from stepweave.functions.keys import unit_interval

    for task in ("t1", "t2"):
        first = own.where(F.col("task") == task).orderBy(unit_interval(F.col("episode_id"), 4), "episode_id").limit(30)
        assert {r["episode_id"] for r in first.collect()} == {r["episode_id"] for r in got.where(F.col("task") == task).collect()}
    assert catalog.inverted_rows(own, "task").groupBy("task").count().count() == 2
