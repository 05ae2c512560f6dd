"""Bringing streams of different rates onto one timeline: linear interpolation and nearest sample, as unions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IngestError


def overlap(samples: DataFrame, recording: str = "recording_id", stream: str = "stream", t: str = "t_ns") -> DataFrame:
    """(recording, t0, t1, n_streams, fewest): where all streams of a recording have begun and none has ended."""
    own = samples.groupBy(recording, stream).agg(F.min(t).alias("_first"), F.max(t).alias("_last"), F.count("*").alias("_n"))
    return own.groupBy(recording).agg(F.max("_first").alias("t0"), F.min("_last").alias("t1"), F.count("*").alias("n_streams"), F.min("_n").alias("fewest"))


def grid(samples: DataFrame, step_ns: int, recording: str = "recording_id", stream: str = "stream", t: str = "t_ns") -> DataFrame:
    """(recording, t): t0, t0 + step, ... up to t1; no row where streams do not overlap."""
    if step_ns <= 0:
        raise IngestError(f"the step is {step_ns} ns; it has to be above 0")
    spans = overlap(samples, recording, stream, t).where("t1 >= t0 and fewest >= 2")
    return spans.select(recording, F.explode(F.sequence("t0", "t1", F.lit(step_ns).cast("bigint"))).alias(t))


def neighbours(samples: DataFrame, points: DataFrame, value: str, recording: str = "recording_id", stream: str = "stream", t: str = "t_ns") -> DataFrame:
    """For each grid point and stream of its recording: the samples before (pt, px) and after (nt, nx) it, itself included.

    Samples without a value or a time are left out; of samples at the same time the largest value counts. One shuffle by recording and
    stream and a sort each way; no join on ranges.
    """
    samples = samples.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    streams = samples.select(recording, stream).distinct()
    asked = points.join(streams, recording).select(recording, stream, t, F.lit(None).cast(samples.schema[value].dataType).alias(value), F.lit(1).alias("_g"))
    rows = samples.select(recording, stream, t, value, F.lit(0).alias("_g")).union(asked)
    # growing frames both ways: a frame up to the end would be gone through anew for each row
    upto = lambda *by: Window.partitionBy(recording, stream).orderBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = lambda sign: F.when(F.col("_g") == 0, F.struct((sign * F.col(t)).alias("t"), F.col(value).alias("x")))
    out = rows.withColumn("_p", F.max(own(1)).over(upto(F.col(t)))).withColumn("_n", F.max(own(-1)).over(upto(F.col(t).desc())))
    return out.where("_g = 1").select(recording, stream, t, F.col("_p.t").alias("pt"), F.col("_p.x").alias("px"), (-F.col("_n.t")).alias("nt"), F.col("_n.x").alias("nx"))


def between(t: Column, pt: Column, px: Column, nt: Column, nx: Column) -> Column:
    """Linear interpolation; a sample at the very time is taken as it is, and ends are held."""
    share = (t - pt).cast("double") / (nt - pt).cast("double")
    return F.when(pt.isNull(), nx).when(nt.isNull() | (pt == t), px).when(nt == t, nx).otherwise(px + (nx - px) * share)


def nearer(t: Column, pt: Column, px: Column, nt: Column, nx: Column) -> Column:
    """The nearest sample; of two as near, the earlier."""
    return F.when(pt.isNull(), nx).when(nt.isNull() | (t - pt <= nt - t), px).otherwise(nx)


def align(samples: DataFrame, hz: float | None = None, value: str = "value", kind: str | None = None, step_ns: int | None = None, recording: str = "recording_id", stream: str = "stream", t: str = "t_ns") -> DataFrame:
    """(recording, stream, t, value) on the grid: interpolated, or the nearest where the column kind says image.

    Needs a rate (hz) above 0 or a step. Recordings with a stream of under two samples, or whose streams do not overlap, have no rows.
    """
    if step_ns is None:
        if hz is None or hz <= 0:
            raise IngestError(f"the rate is {hz} Hz; it has to be above 0")
        step_ns = int(1e9 / hz)
    samples = samples.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    near = neighbours(samples, grid(samples, step_ns, recording, stream, t), value, recording, stream, t)
    ends = [F.col(c) for c in (t, "pt", "px", "nt", "nx")]
    if kind is None:
        return near.select(recording, stream, t, between(*ends).alias(value))
    kinds = samples.groupBy(recording, stream).agg(F.max(F.col(kind) == "image").alias("_image"))
    near = near.join(kinds, [recording, stream])
    return near.select(recording, stream, t, F.when(F.col("_image"), nearer(*ends)).otherwise(between(*ends)).alias(value))


def gaps(samples: DataFrame, threshold_ns: int = 1_000_000_000, recording: str = "recording_id", stream: str = "stream", t: str = "t_ns") -> DataFrame:
    """(recording, stream, n_gaps, max_gap): how many steps are longer than the threshold, and the longest step."""
    w = Window.partitionBy(recording, stream).orderBy(t)
    out = samples.withColumn("_gap", F.col(t) - F.lag(t).over(w))
    return out.groupBy(recording, stream).agg(F.count_if(F.col("_gap") > threshold_ns).alias("n_gaps"), F.max("_gap").alias("max_gap"))
