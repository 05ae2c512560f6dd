import json
import os
import time

import pytest
from pyspark.sql import functions as F

from stepweave import Ledger, Store, cli, compose, trackers
from stepweave.errors import ComposeError, IngestError, LineageError, ServeError, StorageError
from stepweave.operators import catalog, lineage, scoring, serve
from stepweave.operators.compose import reopen
from stepweave.sources import dataset, detect, messages, store


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def test_snapshots_are_by_content(ledger):
    a = ledger.snapshot(["b", "a"], {"x": 1}, "one")
    assert ledger.snapshot(["a", "b"], {"x": 1}, "two")["name"] == "one" and ledger.snapshots().count() == 1
    assert ledger.snapshot(["a"], {"x": 1}, "three")["snapshot_id"] != a["snapshot_id"]
    with pytest.raises(LineageError):
        ledger.snapshot([], {}, "none")


def test_hash_of_many_ids_is_quick():
    began = time.time()
    assert len(lineage.snapshot_hash([f"ep_{i}" for i in range(10_000)], {})) == 64
    assert time.time() - began < 1


def test_experiments(ledger):
    s, t = ledger.snapshot(["a", "b"], {}, "s"), ledger.snapshot(["b", "c"], {}, "t")
    x = ledger.experiment("x", s["snapshot_id"], config={"lr": 1, "gone": 2})
    y = ledger.experiment("y", t["snapshot_id"], config={"lr": 3, "new": 4})
    assert x["parent_id"] is None and y["parent_id"] == x["experiment_id"]
    ledger.log(x["experiment_id"], {"loss": 1.0, "only": 2.0})
    done = ledger.log(y["experiment_id"], {"loss": 0.25}, status="completed")
    assert done["completed_at"] is not None
    with pytest.raises(LineageError):
        ledger.log(x["experiment_id"], status="odd")
    d = ledger.compare("x", "y")
    assert d["metric_deltas"] == {"loss": -0.75, "only": None} and d["episodes_added"] == ["c"] and d["episodes_removed"] == ["a"]
    assert d["config_changes"] == {"added": {"new": "4"}, "removed": ["gone"], "changed": {"lr": ("1", "3")}}
    assert [r["name"] for r in ledger.lineage("y").collect()] == ["x", "y"]
    with pytest.raises(LineageError):
        ledger.compare("x", "nobody")


def test_chain_with_a_cycle_ends(spark):
    own = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "lost")], "experiment_id string, parent_id string")
    got = lineage.ancestors(own, own.where("experiment_id in ('c', 'd')").select("experiment_id")).collect()
    assert sorted((r["leaf"], r["depth"], r["experiment_id"]) for r in got) == [("c", 0, "c"), ("c", 1, "b"), ("c", 2, "a"), ("d", 0, "d")]


def write_dataset(spark, root, lists):
    os.makedirs(f"{root}/meta")
    with open(f"{root}/meta/info.json", "w") as f:
        json.dump({"fps": 50, "robot_type": "aloha", "features": {"observation.images.top": {"dtype": "video"}}}, f)
    rows = [(e, i, float(i) / 50, [float(i * d + e) for d in range(12)], [float(i + d) for d in range(3)], 1 if i else 0) for e in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "episode_index bigint, frame_index bigint, timestamp float, a array<float>, s array<float>, task_index bigint")
    if lists:
        out = df.select("episode_index", "frame_index", "timestamp", F.col("a").alias("action"), F.col("s").alias("observation.state"), "task_index")
    else:
        out = df.select("episode_index", "frame_index", "timestamp", *[F.col("a")[i].alias(f"action_{i}") for i in range(12)], *[F.col("s")[i].alias(f"observation.state_{i}") for i in range(3)], "task_index")
    out.coalesce(1).write.parquet(f"{root}/data/chunk-000")


@pytest.mark.parametrize("lists", [True, False])
def test_dataset_to_store_to_batches(spark, tmp_path, lists):
    root = str(tmp_path / "set")
    write_dataset(spark, root, lists)
    assert detect.detect(root) == "dataset"
    steps, episodes = dataset.load(spark, root)
    first = steps.where("episode_id = 1 and step = 2").first()
    assert first["action"] == [2.0 * d + 1 for d in range(12)] and first["obs"] == {"state": [2.0, 3.0, 4.0]}  # dimension 10 after 9
    assert first["t_ns"] == 39_999_999 and episodes.where("task_index = 1").count() == 2
    own = Store(spark, str(tmp_path / "store"))
    scores = scoring.score(steps, "action", ["step"]).drop("n_steps")
    saved = own.save(steps, episodes.join(scores, "episode_id").withColumn("task", F.lit("pick")))
    assert [r["episode_id"] for r in saved.orderBy("episode_num").collect()] == ["ep_0001", "ep_0002"]
    again = own.save(steps, episodes)
    assert [r["episode_id"] for r in again.orderBy("episode_num").collect()] == ["ep_0003", "ep_0004"] and own.episodes().count() == 4
    assert own.episodes().where("smoothness is not null").count() == 2  # scores are there again
    data = compose(own, task="PICK", sample="quality_weighted", limit=5, name="d")
    assert len(data) == 2 and "ep_0001" in data and data[0]["episode_id"] == data.episode_ids()[0] and data[0:1].count() == 1
    assert "quality_avg=" in repr(data) and data.steps(own).count() == 60
    batch = next(serve.loader(data.batches(own, 2)))
    assert len(batch["episode_ids"]) == 2 and len(batch["values"][0]) == 30
    assert own.export(reopen(own, "d").episodes, str(tmp_path / "out"), data.recipe).count() == 0
    empty = compose(own, task="nothing", name="e")
    assert len(reopen(own, "e")) == 0 and len(empty) == 0
    assert own.export(spark.createDataFrame([("ep_9999",)], "episode_id string"), str(tmp_path / "out2")).first()[0] == "ep_9999"
    with pytest.raises(StorageError):
        own.load("ep_9999")
    with pytest.raises(ComposeError):
        compose(own, sample="odd")
    assert trackers.params(own.episodes(), {"name": "d"})["dataset.quality_n"] == 2 and trackers.notify({}) == []


def test_command_line(spark, tmp_path, capsys):
    root, target = str(tmp_path / "set"), str(tmp_path / "store")
    write_dataset(spark, root, True)
    assert cli.main(["--json", "ingest", root, target], spark) == 0 and json.loads(capsys.readouterr().out) == {"episodes": 2}
    assert cli.main(["--json", "list", target], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main(["--json", "info", target, "ep_0002"], spark) == 0
    assert cli.main(["info", target, "ep_0009"], spark) == 1
    compose(Store(spark, target), name="all")
    assert cli.main(["export", target, "all", str(tmp_path / "out")], spark) == 0


def test_dataset_errors(spark, tmp_path):
    with pytest.raises(IngestError):
        dataset.load(spark, str(tmp_path))
    root = tmp_path / "bad"
    (root / "meta").mkdir(parents=True)
    (root / "meta" / "info.json").write_text("{")
    with pytest.raises(IngestError):
        dataset.read_info(str(root))
    (tmp_path / "x.parquet").write_bytes(b"")
    with pytest.raises(IngestError):
        detect.detect(str(tmp_path / "x.parquet"))
    said = []
    (tmp_path / "x.h5").write_bytes(b"no")
    assert detect.detect(str(tmp_path / "x.h5"), said.append) == "hdf5" and said
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "action array<double>")
    with pytest.raises(IngestError):
        dataset.validate(ragged, {"action": ["action"]})
    holes = spark.createDataFrame([([1.0],), (None,)], "action array<double>")
    with pytest.raises(IngestError):
        dataset.validate(holes, {"action": ["action"]})


def test_gated_readers_say_what_is_missing(spark):
    paths = spark.createDataFrame([("x",)], "path string")
    for read in (messages.read_mcap, messages.read_hdf5):
        with pytest.raises(IngestError, match="not installed"):
            read(spark, paths)


def test_scan_leaves_files_to_their_dataset(spark, tmp_path):
    for p in ("a/x.mcap", "a/set/meta/info.json", "a/set/data/chunk-000/f.parquet", "b/y.h5"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {r["path"].split(str(tmp_path))[1]: (r["format"], r["dataset_root"]) for r in detect.scan(spark, str(tmp_path)).collect()}
    assert got["/a/x.mcap"] == ("mcap", None) and got["/b/y.h5"] == ("hdf5", None) and got["/a/set/data/chunk-000/f.parquet"][1].endswith("/a/set")


def test_padding(spark):
    rows = [("a", i, [1.0, 2.0]) for i in range(5)] + [("b", i, [3.0, 4.0]) for i in range(10)]
    own = serve.gather(spark.createDataFrame(rows, "episode_id string, step int, v array<double>"), F.col("v"), ["step"])
    got = {r["episode_id"]: r["values"] for r in serve.pad(serve.batches(own, 2), "values", 2).collect()}
    assert len(got["a"]) == len(got["b"]) == 10 and got["a"][5:] == [[0.0, 0.0]] * 5
    with pytest.raises(Exception, match="not 3 wide"):
        serve.pad(serve.batches(own, 2), "values", 3).collect()
    with pytest.raises(ServeError):
        serve.batches(own, 0)


def test_wide_layout_orders_by_number(spark):
    own = spark.createDataFrame([(1, [float(i) for i in range(12)])], "k int, obs_x array<float>")
    wide = store.to_wide(own, {"obs_x": 12})
    assert store.from_wide(wide.select("k", *reversed(wide.columns[1:])), ["obs_x"]).first()["obs_x"] == [float(i) for i in range(12)]


def test_listing_puts_unscored_last(spark):
    own = spark.createDataFrame([("a", None, 1), ("b", 0.5, 1), ("c", 0.2, 1)], "episode_id string, overall double, duration_ns bigint").withColumns({"task_key": F.lit("t"), "embodiment_key": F.lit("e")})
    assert [r["episode_id"] for r in catalog.listing(own).collect()] == ["c", "b", "a"]


def test_sessions_stream(spark, tmp_path):
    from stepweave.streaming import incremental

    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:30:00", 3.0), ("a", "2024-01-01 03:00:00", 5.0), ("z", "2024-01-02 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "k string, s string, value double").select("k", F.to_timestamp("s").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = incremental.sessions(incremental.landing(spark, str(tmp_path / "in"), "k string, ts timestamp, value double"), "ts", "k")
    q = live.writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["k"], r["n_steps"], r["mean_value"]) for r in spark.table("sessions_out").collect())
    assert ("a", 2, 2.0) in got and ("a", 1, 5.0) in got


def test_chains_of_a_thousand(spark):
    own = spark.range(1000).select(F.col("id").cast("string").alias("experiment_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    got = lineage.ancestors(own, own.where("experiment_id in ('999', '5')").select("experiment_id"))
    assert {(r["leaf"], r["n"], r["deep"]) for r in got.groupBy("leaf").agg(F.countDistinct("experiment_id").alias("n"), F.max("depth").alias("deep")).collect()} == {("999", 1000, 999), ("5", 6, 5)}


def test_saved_ids_are_unique_and_agree(spark, tmp_path):
    """Many rows with a payload: bounds of ranges that are sampled twice would number them twice."""
    own = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("episode_id"), F.lit("t").alias("task"), F.repeat(F.lit("x"), 40).alias("source_path"))
    st = store.Store(spark, str(tmp_path / "s"))
    st.save(own.select("episode_id", F.lit(0).cast("bigint").alias("t_ns")), own)
    row = st.episodes().agg(F.countDistinct("episode_id").alias("n"), F.min("episode_num").alias("lo"), F.max("episode_num").alias("hi")).first()
    assert (row["n"], row["lo"], row["hi"]) == (200_000, 1, 200_000)
    assert st.steps().join(st.episodes(), "episode_id", "left_anti").isEmpty() and st.steps().select("episode_id").distinct().count() == 200_000
    st.save(own.limit(2).select("episode_id", F.lit(0).cast("bigint").alias("t_ns")), own.limit(2))
    assert st.episodes().where("episode_num > 200000").count() == 2 and st.load("ep_200001").count() == 1


def test_numbers_of_a_broken_save_are_not_given_again(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("a", "t", 0)], "episode_id string, task string, t_ns bigint")
    st.save(one.select("episode_id", "t_ns"), one.select("episode_id", "task"))
    spark.createDataFrame([(1, "ep_0007", 0)], "t_ns bigint, episode_id string, _bucket int").select("t_ns", "episode_id", "_bucket").write.mode("append").partitionBy("_bucket").parquet(str(tmp_path / "s" / "steps"))
    assert [r["episode_num"] for r in st.save(one.select("episode_id", "t_ns"), one.select("episode_id", "task")).collect()] == [8]
