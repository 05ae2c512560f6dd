"""The catalog of episodes: summary rows, indexes by key and by score, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ComposeError
from ..functions.keys import normalise, normalise_text
from .ranking import global_rank


def summarise(steps: DataFrame, order: Sequence[str], t: str = "t_ns", episode: str = "episode_id", keep: Sequence[Column] = ()) -> DataFrame:
    """n_steps, first and last time and duration of each episode; an episode of one step lasts 0."""
    place = F.struct(*order)
    out = steps.groupBy(episode).agg(F.count("*").alias("n_steps"), F.min_by(t, place).alias("t_start_ns"), F.max_by(t, place).alias("t_end_ns"), *keep)
    return out.withColumn("duration_ns", F.col("t_end_ns") - F.col("t_start_ns"))


def with_keys(episodes: DataFrame, task: str = "task", embodiment: str = "embodiment") -> DataFrame:
    return episodes.withColumns({"task_key": normalise(F.col(task)), "embodiment_key": normalise(F.col(embodiment))})


def _any_of(column: str, wanted: str | Sequence[str] | None) -> Column:
    if wanted is None:
        return F.lit(True)
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    return F.col(column).isin([normalise_text(x) for x in names]) if names else F.lit(False)


def _bound(name: str, value: float | None) -> None:
    if value is not None and (isinstance(value, bool) or not 0 <= value <= 1):
        raise ComposeError(f"{name} is {value!r}; it has to be a number from 0 to 1")


def matches(task: str | Sequence[str] | None = None, embodiment: str | Sequence[str] | None = None, quality_min: float | None = None, quality_max: float | None = None) -> Column:
    """One predicate on the catalog. Names are brought to their normal form; an empty list matches nothing, None all.

    Both ends of the range of scores belong to it; a null score is out as soon as there is a bound.
    """
    _bound("quality_min", quality_min)
    _bound("quality_max", quality_max)
    if quality_min is not None and quality_max is not None and quality_min > quality_max:
        raise ComposeError(f"quality_min {quality_min} is above quality_max {quality_max}; swap them")
    out = _any_of("task_key", task) & _any_of("embodiment_key", embodiment)
    if quality_min is not None:
        out = out & (F.col("overall") >= F.lit(float(quality_min)))
    if quality_max is not None:
        out = out & (F.col("overall") <= F.lit(float(quality_max)))
    return out


def find(episodes: DataFrame, **wanted) -> DataFrame:
    """Episodes that match, by id. Nothing is loaded: semi join what it returns with the steps."""
    return episodes.where(matches(**wanted)).orderBy("episode_id")


def inverted_rows(episodes: DataFrame, key: str, episode: str = "episode_id") -> DataFrame:
    """(key, episode), each once: which episodes have a key, one row each however many there are. Written by key, a lookup reads its rows only."""
    return episodes.where(F.col(key).isNotNull()).select(key, episode).distinct()


def inverted(episodes: DataFrame, key: str, episode: str = "episode_id") -> DataFrame:
    """(key, n, episode_ids): inverted_rows() as one list for each key, for catalogs whose lists fit in a row."""
    return episodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(episode).alias("n"), F.array_sort(F.collect_set(episode)).alias("episode_ids"))


def quality_index(episodes: DataFrame, episode: str = "episode_id") -> DataFrame:
    """(place, overall, episode): by rising score, those without a score last."""
    ranked = global_rank(episodes.select("overall", episode), [F.col("overall").asc_nulls_last(), F.col(episode)], "place")
    return ranked.select("place", "overall", episode)


def listing(episodes: DataFrame) -> DataFrame:
    own = episodes.select("episode_id", "task_key", "embodiment_key", (F.col("duration_ns") / F.lit(1e9)).alias("duration_s"), "overall")
    return own.orderBy(F.col("overall").asc_nulls_last(), "episode_id")


def info(episodes: DataFrame, episode_id) -> DataFrame:
    return episodes.where(F.col("episode_id") == F.lit(episode_id))


def rollup(episodes: DataFrame) -> DataFrame:
    """An addition: episodes and mean score by task and embodiment, with subtotals."""
    return episodes.rollup("task_key", "embodiment_key").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("mean_overall"))


def read_filtered(steps: DataFrame, chosen: DataFrame, episode: str = "episode_id") -> DataFrame:
    """The steps of the chosen episodes."""
    return steps.join(chosen.select(episode), episode, "left_semi")
