"""Beyond batch: episodes that arrive as files, scored when they end. Gaps in event time close an episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(steps: DataFrame, ts: str, key: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n_steps, mean and deviation of value): a session of a key ends when nothing came for gap.

    The watermark bounds the state: steps later than late are dropped, and ended sessions leave the state.
    """
    own = steps.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    out = own.agg(F.count("*").alias("n_steps"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_steps", "mean_value", "std_value")
