"""Scores of episodes: smoothness, consistency, completeness, custom metrics and the weighted whole.

All of it is windows over one sort by episode and step, then one aggregation by the same key: one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_WEIGHTS, check_weights
from ..errors import QualityError

#: Least steps of a scored episode, seconds of a complete one, below which a deviation counts as none.
MIN_STEPS, FULL_SECONDS, FLAT = 10, 30.0, 1e-9


@dataclass(frozen=True)
class Metric:
    """A custom metric: an aggregate expression over an episode's steps, with values in [0, 1] or null."""

    name: str
    value: Callable[[], Column]
    weight: float


class Metrics:
    """Weights and custom metrics. register() returns a new one."""

    def __init__(self, base: Mapping[str, float] | None = None, custom: Sequence[Metric] = ()):
        self.base = check_weights(base or DEFAULT_WEIGHTS)
        self.custom = tuple(custom)

    def register(self, name: str, value: Callable[[], Column], weight: float) -> Metrics:
        """The metric takes its weight; what was there before is scaled by the rest. Registering a name again starts without it."""
        if name in DEFAULT_WEIGHTS:
            raise QualityError(f"{name} is built in; choose another name")
        if isinstance(weight, bool) or not 0 < weight < 1:
            raise QualityError(f"weight of {name} is {weight}; it has to be above 0 and below 1")
        return Metrics(self.base, [*(m for m in self.custom if m.name != name), Metric(name, value, float(weight))])

    @property
    def weights(self) -> dict[str, float]:
        out = dict(self.base)
        for m in self.custom:
            out = {k: round(v * (1 - m.weight), 8) for k, v in out.items()} | {m.name: m.weight}
        return out


def completeness(success: Column, first: Column, last: Column) -> Column:
    """1 or 0 if success is known; else the share of FULL_SECONDS that the episode lasts."""
    lasts = (last - first).cast("double") / F.lit(FULL_SECONDS * 1e9)
    return F.when(success.isNotNull(), success.cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lasts)))


def score(
    steps: DataFrame,
    actions: Sequence[str] | str,
    order: Sequence[str],
    t_ns: str = "t_ns",
    episode: str = "episode_id",
    success: Column | None = None,
    weights: Mapping[str, float] | None = None,
    metrics: Metrics | None = None,
    keep: Sequence[Column] = (),
    digits: int | None = None,
) -> DataFrame:
    """One row for each episode: n_steps, smoothness, consistency, completeness, overall, and a column for each custom metric.

    actions: columns of numbers, or one column of arrays of any length. Episodes of under MIN_STEPS steps or with a NaN have
    null scores; an action of no dimension too. weights, if given, hold for this call and leave custom metrics out of
    the whole. A null part makes the whole null. A custom value outside [0, 1] raises. keep: more aggregates to return.
    """
    chosen = metrics or Metrics()
    base = check_weights(weights) if weights is not None else chosen.weights
    w = Window.partitionBy(episode).orderBy(*order)
    if isinstance(actions, str):
        parts = _array_parts(steps, actions, w)
        nan, dims = F.exists(actions, lambda x: F.isnan(x)), F.size(actions)
    else:
        parts = _column_parts(steps, list(actions), w)
        nan, dims = reduce(or_, (F.isnan(F.col(a).cast("double")) for a in actions)), F.lit(len(actions))
    pair = F.col("_pm").isNotNull() & F.col("_m").isNotNull()
    m, pm = F.when(pair, F.col("_m")), F.when(pair, F.col("_pm"))
    custom = [] if weights is not None else list(chosen.custom)
    place = F.struct(*order)
    out = parts.withColumns({"_nan": nan, "_dim": dims}).groupBy(episode).agg(
        F.count("*").alias("n_steps"),
        F.sum("_j2").alias("_sq"),
        F.count("_j2").alias("_nj"),
        F.max("_dim").alias("_dims"),
        F.stddev_pop(m).alias("_sm"),
        F.stddev_pop(pm).alias("_sp"),
        F.covar_pop(m, pm).alias("_cov"),
        F.avg(F.col("_turn").cast("double")).alias("_rr"),
        F.max("_nan").alias("_bad"),
        completeness(F.max(success) if success is not None else F.lit(None).cast("boolean"), F.min_by(t_ns, place), F.max_by(t_ns, place)).alias("_full"),
        *[x.value().alias(x.name) for x in custom],
        *keep,
    )
    out = out.withColumn("_rms", F.sqrt(F.try_divide(F.col("_sq"), F.col("_dims") * F.col("_nj"))))
    valid = (F.col("n_steps") >= MIN_STEPS) & ~F.coalesce(F.col("_bad"), F.lit(False)) & (F.col("_dims") > 0)
    smooth = F.lit(1.0) / (F.lit(1.0) + F.col("_rms"))
    auto = F.when((F.col("_sm") < FLAT) | (F.col("_sp") < FLAT), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("_cov"), F.col("_sm") * F.col("_sp")), F.lit(0.0)))
    steady = F.greatest(F.lit(0.0), auto) * (F.lit(1.0) - F.col("_rr"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = out.withColumns({"smoothness": F.when(valid, clip(smooth)), "consistency": F.when(valid, clip(steady)), "completeness": F.when(valid, F.col("_full"))})
    whole = F.round(reduce(add, (F.col(k) * F.lit(base[k]) for k in DEFAULT_WEIGHTS)), 6)
    for x in custom:
        out = out.withColumn(x.name, F.when((F.col(x.name) < 0) | (F.col(x.name) > 1), F.raise_error(F.lit(f"metric {x.name} is outside [0, 1]"))).otherwise(F.col(x.name)))
        whole = F.round(whole + F.col(x.name) * F.lit(base[x.name]), 6)
    out = out.withColumn("overall", whole)
    if digits is not None:
        out = out.withColumns({k: F.round(k, digits) for k in DEFAULT_WEIGHTS})
    return out.drop("_sq", "_nj", "_rms", "_sm", "_sp", "_cov", "_rr", "_bad", "_dims", "_full")


def _column_parts(steps: DataFrame, actions: list[str], w) -> DataFrame:
    """_j2: squared third differences; _m: length of the step, _pm: of the one before; _turn: any sign change."""
    d, c = [f"_d{i}" for i in range(len(actions))], [f"_c{i}" for i in range(len(actions))]
    out = steps.withColumns({x: (F.col(a) - F.lag(a).over(w)).cast("double") for x, a in zip(d, actions, strict=True)})
    more = {y: F.col(x) - F.lag(x).over(w) for x, y in zip(d, c, strict=True)}
    more["_m"] = F.sqrt(reduce(add, (F.col(x) * F.col(x) for x in d)))
    more["_turn"] = reduce(or_, (F.signum(x) != F.signum(F.lag(x).over(w)) for x in d))
    out = out.withColumns(more)
    last = {"_pm": F.lag("_m").over(w), "_j2": reduce(add, ((F.col(y) - F.lag(y).over(w)) ** 2 for y in c))}
    return out.withColumns(last)


def _array_parts(steps: DataFrame, action: str, w) -> DataFrame:
    less = lambda c: F.zip_with(c, F.lag(c).over(w), lambda x, y: x - y)
    norm2 = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    out = steps.withColumn("_a", F.col(action).cast("array<double>")).withColumn("_d", less("_a"))
    out = out.withColumns({"_c": less("_d"), "_m": F.sqrt(norm2("_d")), "_turn": F.exists(F.zip_with("_d", F.lag("_d").over(w), lambda x, y: F.signum(x) != F.signum(y)), lambda x: x)})
    return out.withColumns({"_j2": norm2(less("_c")), "_pm": F.lag("_m").over(w)})


def feasibility(episodes: DataFrame) -> DataFrame:
    """A place holder: every episode counts as feasible."""
    return episodes.withColumn("feasibility", F.lit(1.0))


def at_least(episodes: DataFrame, min_score: float, column: str = "overall") -> DataFrame:
    """Episodes whose score is min_score or more; those without a score go."""
    if isinstance(min_score, bool) or not isinstance(min_score, int | float) or not 0 <= min_score <= 1:
        raise QualityError(f"min_score is {min_score!r}; it has to be a number from 0 to 1")
    return episodes.where(F.col(column) >= F.lit(float(min_score)))


def report(episodes: DataFrame, column: str = "overall") -> DataFrame:
    """One row: n_total, n_scored, min, max, mean, median (linear), std (of the whole population)."""
    c = F.col(column)
    return episodes.agg(F.count("*").alias("n_total"), F.count(c).alias("n_scored"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_pop(c).alias("std"))


def outliers(episodes: DataFrame, column: str = "overall", sigmas: float = 2.0) -> DataFrame:
    """Episodes farther than sigmas deviations from the mean, with sigma, the signed distance in deviations."""
    stats = episodes.agg(F.avg(column).alias("_mu"), F.stddev_pop(column).alias("_sd"))
    out = episodes.crossJoin(F.broadcast(stats)).where((F.col("_sd") > 0) & (F.abs(F.col(column) - F.col("_mu")) > sigmas * F.col("_sd")))  # stats is one row
    return out.withColumn("sigma", (F.col(column) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def tracker_stats(episodes: DataFrame, column: str = "overall") -> DataFrame:
    """What trackers log: mean, std (of a sample, 0 for one), min, max to 4 digits, and n; nulls if nothing is scored."""
    c, n = F.col(column), F.count(column)
    std = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))
    return episodes.agg(F.round(F.avg(c), 4).alias("mean"), F.round(std, 4).alias("std"), F.round(F.min(c), 4).alias("min"), F.round(F.max(c), 4).alias("max"), n.alias("n"))
