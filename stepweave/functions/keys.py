"""Keys and names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(value: Column) -> Column:
    """Lower case without blanks (of any kind), dashes and underscores: what task and embodiment are grouped by."""
    return F.regexp_replace(F.lower(value), r"(?U)[-\s_]+", "")


def normalise_text(value: str) -> str:
    return re.sub(r"[-\s_]+", "", value.lower())


def topic_name(topic: Column) -> Column:
    """A topic as a stream name: no leading slashes, the others become underscores."""
    return F.replace(F.ltrim(topic, F.lit("/")), F.lit("/"), F.lit("_"))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds_to_ns(seconds: Column) -> Column:
    """Float seconds to whole nanoseconds, cut off."""
    return (seconds.cast("double") * F.lit(1e9)).cast("bigint")


def step_ns(step: Column, fps: float) -> Column:
    """Made-up timestamps of a recording of fps frames a second."""
    return step.cast("bigint") * F.lit(int(1e9 / fps)).cast("bigint")


def unit_interval(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and seed only, wherever and in whatever order rows are."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def episode_name(number: Column) -> Column:
    return F.format_string("ep_%04d", number.cast("bigint"))
