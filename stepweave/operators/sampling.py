"""Samples of a catalog: the first, the same from each stratum, or by score. Deterministic for a seed, wherever rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ComposeError
from ..functions.keys import unit_interval

STRATEGIES = ("none", "stratified", "quality_weighted")
#: Strata up to which their quotas are sent to every executor; beyond that they are joined.
STRATA = 100_000


def first_n(episodes: DataFrame, limit: int | None, order: str = "episode_id") -> DataFrame:
    out = episodes.orderBy(order)
    return out if limit is None else out.limit(limit)


def stratified(episodes: DataFrame, limit: int | None, stratum: str = "task", episode: str = "episode_id", seed: int = 0) -> DataFrame:
    """As many of each stratum (by raw name) as go into limit, one more of the first ones for the remainder; what small
    strata leave goes to the others in their order. Within a stratum the order is by hash. Adds stratum_rank.
    """
    sizes = episodes.groupBy(stratum).agg(F.count("*").alias("_size"))
    line = Window.orderBy(F.col(stratum).asc_nulls_first())
    whole = Window.partitionBy(F.lit(1))
    plan = sizes.withColumns({"_k": F.row_number().over(line) - 1, "_g": F.count("*").over(whole), "_all": F.sum("_size").over(whole)})
    cap = F.col("_all") if limit is None else F.least(F.lit(limit).cast("bigint"), F.col("_all"))
    plan = plan.withColumn("_cap", cap)
    plan = plan.withColumn("_quota", F.expr("_cap div _g") + F.when(F.col("_k") < F.col("_cap") % F.col("_g"), 1).otherwise(0))
    plan = plan.withColumn("_taken", F.least("_quota", "_size")).withColumn("_spare", F.col("_size") - F.col("_taken"))
    left = F.col("_cap") - F.sum("_taken").over(whole)
    before = F.coalesce(F.sum("_spare").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = plan.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_spare"), left - before)))
    plan = plan.select(F.col(stratum).alias("_s"), (F.col("_taken") + F.col("_extra")).alias("_n"), "_size")
    # only rows whose draw is low enough to be among the first are ranked: about as many as are asked for, not the whole stratum
    draw = unit_interval(F.col(episode), seed)
    plan = plan.withColumn("_below", (F.col("_n") + 6 * F.sqrt("_n") + 10) / F.col("_size"))
    placed = episodes.withColumn("_u", draw).join(F.broadcast(plan) if sizes.count() <= STRATA else plan, F.col(stratum).eqNullSafe(F.col("_s")))
    # a stratum in which chance leaves too few below (one in 10 ** 9) is ranked whole
    short = placed.groupBy("_s").agg(F.count_if(F.col("_u") < F.col("_below")).alias("_got"), F.max("_n").alias("_least")).where("_got < _least").select(F.col("_s").alias("_t"), F.lit(True).alias("_short"))
    placed = placed.join(short, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t") if short.head(1) else placed.withColumn("_short", F.lit(False))
    low = placed.where((F.col("_u") < F.col("_below")) | F.coalesce("_short", F.lit(False)))
    ranked = low.withColumn("stratum_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_u", episode)))
    return ranked.where(F.col("stratum_rank") <= F.col("_n")).drop("_s", "_n", "_u", "_below", "_size", "_short")


def quality_weighted(episodes: DataFrame, limit: int | None, episode: str = "episode_id", seed: int = 0) -> DataFrame:
    """The limit episodes of the highest priority (score + 1e-9) * U; those without a score go. Adds priority."""
    out = episodes.where(F.col("overall").isNotNull()).withColumn("priority", (F.col("overall") + F.lit(1e-9)) * unit_interval(F.col(episode), seed))
    out = out.orderBy(F.col("priority").desc(), episode)
    return out if limit is None else out.limit(limit)


def sample(episodes: DataFrame, strategy: str = "none", limit: int | None = None, seed: int = 0, **names: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ComposeError(f"sampling is {strategy!r}; choose one of {', '.join(STRATEGIES)}")
    if limit is not None and (isinstance(limit, bool) or limit < 0):
        raise ComposeError(f"limit is {limit!r}; it has to be a whole number of 0 or more")
    if strategy == "none":
        return first_n(episodes, limit, names.get("episode", "episode_id"))
    if strategy == "stratified":
        return stratified(episodes, limit, seed=seed, **names)
    return quality_weighted(episodes, limit, seed=seed, **{k: v for k, v in names.items() if k == "episode"})
