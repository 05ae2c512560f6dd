"""One call from files to steps and episodes: recordings are aligned and cut, datasets are read, what fails is listed."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import IngestError
from ..operators import align, segment
from . import dataset, detect, messages

log = logging.getLogger("stepweave")
FORMATS = ("mcap", "hdf5", "dataset")
STEPS = "episode_id string, step int, t_ns bigint, action array<double>, obs map<string,array<double>>, source_path string, source_format string"


def align_vectors(samples: DataFrame, hz: float) -> DataFrame:
    """(recording_id, t_ns, stream, values) on the common grid of each recording: every dimension is interpolated on its own."""
    flat = samples.select("recording_id", "stream", "t_ns", F.posexplode("values").alias("_d", "value"))
    flat = flat.select("recording_id", F.struct("stream", "_d").alias("stream"), "t_ns", "value")
    own = align.align(flat, hz).select("recording_id", "t_ns", "stream.stream", "stream._d", "value")
    parts = F.array_sort(F.collect_list(F.struct("_d", "value")))  # as many as the stream has dimensions
    return own.groupBy("recording_id", "t_ns", "stream").agg(F.transform(parts, lambda x: x["value"]).alias("values"))


def cut_recordings(samples: DataFrame, markers: DataFrame | None = None, strategy: str = "auto", hz: float = Settings().rate_hz) -> DataFrame:
    """Steps (episode_id, recording_id, segment, step, t_ns, action, obs) from samples (recording_id, stream, t_ns, values).

    Streams are brought onto one grid. By the strategy, and by what streams a recording has, it is cut where its first gripper stream opens or
    closes, in the middle of pauses of joint_vel, or at markers (recording_id, marker_ns). Segments of under two steps go. The
    first stream called action or action_... is the action, an empty one if there is none; all others are observations.
    """
    samples = samples.where(F.col("values").isNotNull() & F.col("t_ns").isNotNull())
    markers = markers if markers is not None else samples.sparkSession.createDataFrame([], samples.select("recording_id", F.col("t_ns").alias("marker_ns")).schema)
    streams = samples.groupBy("recording_id", "stream").agg(F.min("t_ns").alias("first_ns"))
    grip = streams.where(F.contains("stream", F.lit("gripper"))).groupBy("recording_id").agg(F.min_by("stream", F.struct("first_ns", "stream")).alias("grip"))
    facts = segment.choose(strategy, streams, markers).join(segment.action_stream(streams), "recording_id").join(grip, "recording_id", "left")
    wide = align_vectors(samples, hz).groupBy("recording_id", "t_ns").agg(F.map_from_entries(F.collect_list(F.struct("stream", "values"))).alias("all"))
    steps = segment.number(wide, ["t_ns"]).join(facts, "recording_id")
    chosen = lambda by: steps.where(F.col("by") == by)
    resting = F.array_max(F.transform(F.element_at("all", F.lit("joint_vel")), F.abs)) < segment.STILL
    cuts = segment.transitions(chosen("gripper"), F.get(F.element_at("all", F.col("grip")), F.lit(0)) > segment.OPEN)
    cuts = cuts.union(segment.pauses(chosen("velocity"), resting).select("recording_id", F.col("middle").alias("i")))
    cuts = cuts.union(segment.markers_to_steps(chosen("markers"), markers))
    out = segment.segment(steps, cuts)
    place = segment.number(out.withColumn("_i", F.col("i")), ["_i"], "episode_id", "step")
    action = F.coalesce(F.element_at("all", F.col("action_stream")), F.array().cast("array<double>"))
    obs = F.map_filter("all", lambda k, _: ~k.eqNullSafe(F.col("action_stream")))
    return place.select("episode_id", "recording_id", "segment", F.col("step").cast("int").alias("step"), "t_ns", action.alias("action"), obs.alias("obs"))


def read(spark: SparkSession, path: str, fmt: str, strategy: str = "auto", markers: DataFrame | None = None, hz: float = Settings().rate_hz) -> DataFrame:
    """The steps of one file or dataset."""
    label = [F.lit(path).alias("source_path"), F.lit(fmt).alias("source_format")]
    if fmt == "dataset":
        steps, _ = dataset.load(spark, path)
        own = steps.withColumn("episode_id", F.concat(F.lit(f"{path}#"), F.col("episode_id").cast("string")))
    elif fmt == "mcap":
        own = cut_recordings(messages.read_mcap(spark, spark.createDataFrame([(path,)], "path string")), markers, strategy, hz)
    elif fmt == "hdf5":
        own = messages.read_hdf5(spark, spark.createDataFrame([(path,)], "path string"))
        own = own.withColumn("episode_id", F.concat(F.col("path"), F.lit("#"), F.col("demo").cast("string")))
    else:
        raise IngestError(f"format is {fmt!r}; choose one of auto, {', '.join(FORMATS)}")
    return own.select("episode_id", "step", "t_ns", "action", "obs", *label)


def ingest(spark: SparkSession, path: str, fmt: str = "auto", errors: list[dict] | None = None, stats: dict[str, int] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(steps, episodes) of a file, a dataset or a folder of them.

    In a folder files come first, in the order of their names, then datasets; what cannot be read is skipped with a warning and goes into
    errors (path, reason). Of a single path errors are raised. stats gets files_succeeded. An empty folder gives no rows.
    """
    kind = detect.detect(path, log.warning) if fmt == "auto" else fmt
    if kind == "unknown":
        raise IngestError(f"{path} is of no known format; give a dataset's folder, or one of .mcap, .hdf5, .h5")
    parts: list[DataFrame] = []
    if kind != "directory":
        parts.append(read(spark, path, kind, **how))
    else:
        found = detect.scan(spark, path).where(F.col("format").isin("mcap", "hdf5") | F.col("dataset_root").isNotNull())
        items = found.select(F.coalesce("dataset_root", "path").alias("item"), F.when(F.col("dataset_root").isNotNull(), "dataset").otherwise(F.col("format")).alias("kind")).distinct()
        for r in items.orderBy(F.col("kind") == "dataset", "item").toLocalIterator():  # one row for each file or dataset
            own = r["item"].removeprefix("file:")
            try:
                one = read(spark, own, r["kind"], **how)
                one.head(1)
                parts.append(one)
            except Exception as e:  # noqa: BLE001  the folder's other files are read
                log.warning("%s is skipped: %s", own, e)
                if errors is not None:
                    errors.append({"path": own, "reason": str(e).splitlines()[0]})
        if not parts:
            log.warning("%s has nothing that can be read", path)
    if stats is not None:
        stats["files_succeeded"] = len(parts)
    steps = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], STEPS)
    place = F.struct("step")
    episodes = steps.groupBy("episode_id").agg(F.first("source_path").alias("source_path"), F.first("source_format").alias("source_format"), F.count("*").alias("n_steps"), (F.max_by("t_ns", place) - F.min_by("t_ns", place)).alias("duration_ns"))
    return steps, episodes
