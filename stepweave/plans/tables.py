"""The driver's tables in their domain roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import micros, normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as steps: a user is an episode, (value, k) its action."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("episode_id"), "event_id", (micros(F.col("ts")) * 1000).alias("t_ns"), F.col("value").alias("a0"), k.alias("a1"), "event_type")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a user is a recording, an event type a stream."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("stream"), (micros(F.col("ts")) * 1000).alias("t_ns"), "value", "event_id")


def documents_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as a catalog: language is the task, source the embodiment; half of the labelled have a score."""
    d, label = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    own = d.select("doc_id", "lang", "source", "n_chars").join(label, "doc_id", "left")
    score = F.when(F.col("quality").isNotNull(), F.round((F.col("n_chars") % 97) / F.lit(97.0), 6))
    return own.select(F.col("doc_id").alias("episode_id"), F.col("lang").alias("task"), F.col("source").alias("embodiment"), normalise(F.col("lang")).alias("task_key"), normalise(F.col("source")).alias("embodiment_key"), score.alias("overall"))
