"""Step-level Parquet datasets: data/chunk-*/*.parquet, meta/info.json and videos/."""

from __future__ import annotations

import glob
import json
import os
import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import IngestError
from ..functions.keys import seconds_to_ns, step_ns


def read_info(root: str) -> dict:
    path = os.path.join(root, "meta", "info.json")
    try:
        with open(path) as f:
            info = json.load(f)
    except OSError as e:
        raise IngestError(f"{path} is missing; a dataset has to have it") from e
    except ValueError as e:
        raise IngestError(f"{path} is no JSON: {e}") from e
    if not isinstance(info, dict) or not isinstance(info.get("features"), dict):
        raise IngestError(f"{path} has no table of features")
    return {"fps": 50} | info


def value_columns(df: DataFrame, features: dict) -> dict[str, list[str]]:
    """Observations and action by short name: one list column, or numbered scalar columns in the order of their numbers. A list wins."""
    cameras = {k for k, v in features.items() if v.get("dtype") in ("video", "image")}
    lists, scalars = {}, defaultdict(list)
    for f in df.schema.fields:
        name = f.name
        if name in cameras or not (name == "action" or name.startswith(("action", "observation."))):
            continue
        short = name.removeprefix("observation.")
        if isinstance(f.dataType, ArrayType):
            lists[short] = [name]
        elif m := re.fullmatch(r"(.+)_(\d+)", short):
            scalars[m[1]].append((int(m[2]), name))
    return {k: [n for _, n in sorted(v)] for k, v in scalars.items()} | lists


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """n, n_null, and the shortest and longest list."""
    c = F.col(column)
    return df.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("n_null"), F.min(F.size(c)).alias("shortest"), F.max(F.size(c)).alias("longest"))


def validate(df: DataFrame, columns: dict[str, list[str]]) -> None:
    """Nulls and lists of several lengths raise; one pass over the columns."""
    checks = []
    for name, own in columns.items():
        checks += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"{name}|{c}|null") for c in own]
        if isinstance(df.schema[own[0]].dataType, ArrayType):
            checks += [f(F.size(f"`{own[0]}`")).alias(f"{name}|{own[0]}|{n}") for n, f in (("min", F.min), ("max", F.max))]
    if not checks:
        return
    got = df.agg(*checks).first().asDict()
    for k, v in got.items():
        name, column, what = k.split("|")
        if what == "null" and v:
            raise IngestError(f"column {column} has {v} nulls; fill them or drop those steps")
        if what == "min" and v != got[f"{name}|{column}|max"]:
            raise IngestError(f"lists in {column} have from {v} to {got[f'{name}|{column}|max']} values; all have to be of one length")


def most_common(steps: DataFrame, column: str, order: Sequence[str], episode: str = "episode_id") -> DataFrame:
    """(episode, column, n): its most frequent value; of several, the one seen first."""
    own = steps.groupBy(episode, column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(episode).orderBy(F.col("n").desc(), "_first")
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(episode, column, "n")


def video_paths(episodes: DataFrame, own: DataFrame, chunks: DataFrame, episode: str = "episode_id", chunk: str = "chunk") -> DataFrame:
    """episodes with path and fallback: the episode's own video, else its chunk's."""
    out = episodes.join(own.withColumnRenamed("path", "_own"), episode, "left").join(chunks.withColumnRenamed("path", "_chunk"), chunk, "left")
    return out.withColumn("path", F.coalesce("_own", "_chunk")).withColumn("fallback", F.col("_own").isNull() & F.col("_chunk").isNotNull()).drop("_own", "_chunk")


def videos(spark: SparkSession, root: str) -> DataFrame:
    """(key, episode_index, chunk, path) of flat (one for each episode) and nested (one for each chunk) videos. Only paths are read."""
    if not os.path.isdir(os.path.join(root, "videos")):
        return spark.createDataFrame([], "key string, episode_index bigint, chunk string, path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(os.path.join(root, "videos")).select("path")
    flat = r"/videos/(chunk-[^/]+)/(.+)_episode_(\d+)\.mp4$"
    nested = r"/videos/([^/]+)/(chunk-[^/]+)/[^/]+\.mp4$"
    one = F.regexp_extract("path", flat, 2) != ""
    key = F.when(one, F.regexp_extract("path", flat, 2)).otherwise(F.regexp_extract("path", nested, 1))
    chunk = F.when(one, F.regexp_extract("path", flat, 1)).otherwise(F.regexp_extract("path", nested, 2))
    index = F.when(one, F.regexp_extract("path", flat, 3).try_cast("bigint"))
    return files.select(F.regexp_extract(key, r"([^.]+)$", 1).alias("key"), index.alias("episode_index"), chunk.alias("chunk"), "path").where("key <> ''")


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(steps, episodes) of a dataset. Unreadable chunks are skipped; chunks whose columns differ raise."""
    info = read_info(root)
    found = sorted(glob.glob(os.path.join(root, "data", "chunk-*", "*.parquet")))
    if not found:
        raise IngestError(f"{root} has no data/chunk-*/*.parquet")
    schemas = {}
    for path in found:
        try:
            schemas[path] = spark.read.parquet(path).schema.simpleString()
        except Exception:  # noqa: BLE001  a chunk that is no Parquet is left out
            continue
    if not schemas:
        raise IngestError(f"no chunk of {root} can be read")
    if len(set(schemas.values())) > 1:
        raise IngestError(f"chunks of {root} have different columns: {sorted(set(schemas.values()))}")
    raw = spark.read.option("ignoreCorruptFiles", "true").parquet(*schemas)
    columns = value_columns(raw, info["features"])
    actions = [k for k in columns if k == "action" or k.startswith("action")]
    if "episode_index" not in raw.columns or not actions:
        raise IngestError(f"{root} needs the columns episode_index and action")
    validate(raw, columns)
    frame = F.col("frame_index") if "frame_index" in raw.columns else F.row_number().over(Window.partitionBy("episode_index").orderBy("timestamp")) - 1
    own = raw.withColumn("_step", frame.cast("int"))
    t = seconds_to_ns(F.col("timestamp")) if "timestamp" in raw.columns else step_ns(F.col("_step"), info["fps"])
    obs = [k for k in columns if k not in actions]
    pairs = [x for k in obs for x in (F.lit(k), _array(own, columns[k]))]
    obs_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<double>>")
    task = [F.col("task_index")] if "task_index" in raw.columns else []
    steps = own.select(F.col("episode_index").cast("bigint").alias("episode_id"), F.col("_step").alias("step"), t.alias("t_ns"), _array(own, columns[actions[0]]).alias("action"), obs_map.alias("obs"), *task)
    place = F.struct("step")
    episodes = steps.groupBy("episode_id").agg(F.count("*").alias("n_steps"), (F.max_by("t_ns", place) - F.min_by("t_ns", place)).alias("duration_ns"))
    episodes = episodes.withColumns({"source_path": F.lit(root), "source_format": F.lit("dataset"), "embodiment": F.lit(info.get("robot_type"))})
    if task:
        episodes = episodes.join(most_common(steps, "task_index", ["step"]).drop("n"), "episode_id")
    return steps, episodes


def _array(df: DataFrame, columns: list[str]) -> Column:
    if isinstance(df.schema[columns[0]].dataType, ArrayType):
        return F.col(f"`{columns[0]}`").cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
