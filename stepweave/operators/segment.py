"""Cutting recordings into episodes: state changes, pauses, markers. All gaps and islands over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IngestError

#: Above which a gripper is open, below which a joint is still, and for how long.
OPEN, STILL, PAUSE_NS = 0.02, 0.01, 100_000_000
STRATEGIES = ("auto", "none", "manual")


def number(steps: DataFrame, order: list[str], key: str = "recording_id", to: str = "i") -> DataFrame:
    return steps.withColumn(to, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def transitions(steps: DataFrame, state: Column, key: str = "recording_id", i: str = "i") -> DataFrame:
    """Steps after which the state is another: (key, i)."""
    w = Window.partitionBy(key).orderBy(i)
    out = steps.withColumn("_s", state)
    return out.withColumn("_n", F.lead("_s").over(w)).where(F.col("_n").isNotNull() & (F.col("_n") != F.col("_s"))).select(key, i)


def pauses(steps: DataFrame, still: Column, min_ns: int = PAUSE_NS, key: str = "recording_id", i: str = "i", t: str = "t_ns") -> DataFrame:
    """(key, first, last, middle): stretches of still steps that last min_ns.

    A stretch that ends before the recording does lasts up to the step after it, and that step is its last; else up to its own last.
    """
    w = Window.partitionBy(key).orderBy(i)
    out = steps.withColumns({"_z": still, "_after": F.lead(t).over(w), "_i2": F.lead(i).over(w)})
    runs = out.where("_z").withColumn("_run", F.col(i) - F.row_number().over(w))
    ends = runs.groupBy(key, "_run").agg(F.min(i).alias("first"), F.min_by(t, i).alias("_t0"), F.max_by(F.coalesce("_i2", i), i).alias("last"), F.max_by(F.coalesce("_after", t), i).alias("_t1"))
    ends = ends.where(F.col("_t1") - F.col("_t0") >= min_ns)
    return ends.select(key, "first", "last", (F.col("first") + F.floor((F.col("last") - F.col("first")) / 2)).cast("int").alias("middle"))


def markers_to_steps(steps: DataFrame, markers: DataFrame, key: str = "recording_id", i: str = "i", t: str = "t_ns", at: str = "marker_ns") -> DataFrame:
    """(key, i): for each marker the first step at or after it, else the last step; each step once."""
    both = steps.select(key, F.col(t).alias("_t"), F.col(i).alias("_i")).unionByName(markers.select(key, F.col(at).alias("_t"), F.lit(None).cast("int").alias("_i")))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    found = both.withColumns({"_next": F.min("_i").over(w), "_last": F.max("_i").over(whole)}).where("_i is null")
    return found.select(key, F.coalesce("_next", "_last").alias(i)).where(F.col(i).isNotNull()).distinct()


def cut(steps: DataFrame, boundaries: DataFrame, key: str = "recording_id", i: str = "i", least: int = 2) -> DataFrame:
    """steps with segment: a new one starts after each boundary. Segments of under least steps go."""
    marks = boundaries.select(key, i).distinct().withColumn("_b", F.lit(1))
    w = Window.partitionBy(key).orderBy(i)
    out = steps.join(marks, [key, i], "left").withColumn("segment", F.coalesce(F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(key, "segment"))).where(F.col("_n") >= least).drop("_n", "_b")


def choose(strategy: str, streams: DataFrame, markers: DataFrame, key: str = "recording_id", stream: str = "stream") -> DataFrame:
    """(key, by): what cuts each recording: gripper, velocity, markers or none. A gripper stream wins even without a change.

    A stream with gripper in its name is one; velocity is the stream joint_vel and no other. Names are taken as they are written.
    """
    if strategy not in STRATEGIES:
        raise IngestError(f"strategy is {strategy!r}; choose one of {', '.join(STRATEGIES)}")
    own = streams.groupBy(key).agg(F.max(F.contains(stream, F.lit("gripper"))).alias("_g"), F.max(F.col(stream) == "joint_vel").alias("_v"))
    own = own.join(markers.select(key).distinct().withColumn("_m", F.lit(True)), key, "left")
    marked = F.when(F.col("_m"), "markers").otherwise("none")
    if strategy == "auto":
        by = F.when(F.col("_g"), "gripper").when(F.col("_v"), "velocity").otherwise(marked)
    else:
        by = marked if strategy == "manual" else F.lit("none")
    return own.select(key, by.alias("by"))


def action_stream(streams: DataFrame, key: str = "recording_id", stream: str = "stream", order: str = "first_ns") -> DataFrame:
    """(key, action_stream): the first stream called action or action_...; null if there is none."""
    named = (F.col(stream) == "action") | F.startswith(stream, F.lit("action_"))
    return streams.groupBy(key).agg(F.min_by(F.when(named, F.col(stream)), F.when(named, F.struct(order, stream))).alias("action_stream"))


def segment(steps: DataFrame, boundaries: DataFrame, **names: str) -> DataFrame:
    """cut(), with episode ids made of recording and segment."""
    key = names.get("key", "recording_id")
    return cut(steps, boundaries, **names).withColumn("episode_id", F.concat_ws("/", F.col(key).cast("string"), F.col("segment").cast("string")))
