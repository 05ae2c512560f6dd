"""Batches for training: consecutive or shuffled, padded at the end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ServeError
from ..functions.keys import unit_interval
from .ranking import global_rank


def concat_observations(obs: Column, names: Column) -> Column:
    """The arrays of a map one after the other, in the order of the names."""
    return F.flatten(F.transform(names, lambda k: F.element_at(obs, k)))


def gather(steps: DataFrame, values: Column, order: Sequence[str], episode: str = "episode_id") -> DataFrame:
    """One row for each episode: n_steps and values, an array with one array for each step in order."""
    place = F.struct(*order).alias("o")
    own = steps.select(episode, F.struct(place, values.alias("v")).alias("r"))
    out = own.groupBy(episode).agg(F.count("*").alias("n_steps"), F.sort_array(F.collect_list("r")).alias("r"))
    return out.select(episode, "n_steps", F.transform("r", lambda x: x["v"]).alias("values"))


def batches(episodes: DataFrame, size: int = 32, shuffle_seed: int | None = None, episode: str = "episode_id") -> DataFrame:
    """Adds batch: size episodes each by id, or in an order by hash.

    Places come from counts by range: episodes are sorted range by range, and each range begins where those before it end.
    """
    if size < 1:
        raise ServeError(f"the batch size is {size}; it has to be 1 or more")
    key = F.col(episode) if shuffle_seed is None else unit_interval(F.col(episode), shuffle_seed)
    ids = global_rank(episodes.select(episode, key.alias("_key")), ["_key", episode], "_place")
    return episodes.join(ids.select(episode, F.floor((F.col("_place") - 1) / size).alias("batch")), episode)


def pad(batched: DataFrame, values: str, width: int, batch: str = "batch") -> DataFrame:
    """values of each episode lengthened with zeros to its batch's longest. Steps that are not width numbers wide raise, naming the episode."""
    longest = batched.groupBy(batch).agg(F.max("n_steps").alias("_longest"))
    zeros = F.array_repeat(F.lit(0.0), width)
    wrong = F.exists(values, lambda x: F.size(x) != width)
    more = F.concat(F.col(values), F.array_repeat(zeros, (F.col("_longest") - F.col("n_steps")).cast("int")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit(f"an episode has steps that are not {width} wide: "), F.col("episode_id").cast("string"))).cast("array<array<double>>")).otherwise(more)
    return batched.join(longest, batch).withColumn(values, checked).drop("_longest")


def loader(batched: DataFrame, values: str = "values", batch: str = "batch") -> Iterator[dict]:
    """Batches one after the other: ids and padded values; as tensors if PyTorch is installed. One batch is here at a time."""
    try:
        import torch
    except ImportError:
        torch = None
    rows, current = [], None

    def give(own: list) -> dict:
        data = [r[values] for r in own]
        return {"batch": current, "episode_ids": [r["episode_id"] for r in own], values: torch.tensor(data) if torch else data}

    for r in batched.orderBy(batch, "episode_id").toLocalIterator():
        if rows and r[batch] != current:
            yield give(rows)
            rows = []
        current = r[batch]
        rows.append(r)
    if rows:
        yield give(rows)
