"""Datasets: a filtered and sampled list of episodes with the recipe it came from."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ComposeError
from ..sources.store import Store, write_text
from . import catalog, sampling, serve
from .ranking import global_rank


@dataclass(frozen=True)
class Dataset:
    """Episodes in the order of rank (1, 2, ...), lazily; the steps are joined in when they are asked for."""

    episodes: DataFrame
    name: str
    recipe: dict

    def __len__(self) -> int:
        return self.episodes.count()

    def __contains__(self, episode_id: str) -> bool:
        return bool(self.episodes.where(F.col("episode_id") == episode_id).head(1))

    def __iter__(self) -> Iterator:
        return self.episodes.orderBy("rank").toLocalIterator()

    def __getitem__(self, at: int | slice):
        if isinstance(at, slice):
            first, last, step = at.indices(len(self))
            places = range(first, last, step)
            rows = self.episodes.where((F.col("rank") > min(places, default=0)) & (F.col("rank") <= max(places, default=-1) + 1))
            return rows.where((F.col("rank") - 1 - first) % abs(step) == 0).orderBy(F.col("rank") if step > 0 else F.col("rank").desc())
        found = self.episodes.where(F.col("rank") == (at + 1 if at >= 0 else len(self) + at + 1)).head(1)
        if not found:
            raise IndexError(at)
        return found[0]

    def steps(self, store: Store) -> DataFrame:
        return catalog.read_filtered(store.steps(), self.episodes)

    def episode_ids(self) -> list[str]:
        """As many as were sampled."""
        return [r["episode_id"] for r in self.episodes.orderBy("rank").select("episode_id").toLocalIterator()]

    def batches(self, store: Store, size: int = 32, shuffle_seed: int | None = None) -> DataFrame:
        own = serve.gather(self.steps(store), F.col("action"), ["t_ns", "step"])
        width = own.select(F.max(F.size(F.get("values", F.lit(0))))).first()[0] or 0
        return serve.pad(serve.batches(own, size, shuffle_seed), "values", width)

    def __repr__(self) -> str:
        row = self.episodes.agg(F.count("*").alias("n"), F.round(F.avg("overall"), 2).alias("q")).first()
        return f"Dataset({self.name!r}, episodes={row['n']}, quality_avg={'N/A' if row['q'] is None else row['q']})"


def compose(
    store: Store,
    task: str | Sequence[str] | None = None,
    embodiment: str | Sequence[str] | None = None,
    quality_min: float | None = None,
    quality_max: float | None = None,
    sample: str = "none",
    limit: int | None = None,
    seed: int = 0,
    name: str | None = None,
) -> Dataset:
    """Filters the catalog, samples it and writes the recipe. Arguments are checked before anything is read."""
    if sample not in sampling.STRATEGIES:
        raise ComposeError(f"sampling is {sample!r}; choose one of {', '.join(sampling.STRATEGIES)}")
    found = store.episodes().where(catalog.matches(task, embodiment, quality_min, quality_max))
    taken = sampling.sample(found, sample, limit, seed=seed)
    order = [F.col("priority").desc(), F.col("episode_num")] if "priority" in taken.columns else [F.col("episode_num")]
    taken = global_rank(taken, order)
    name = name or f"dataset-{uuid.uuid4().hex[:8]}"
    counts = found.agg(F.count("*").alias("n")).first()["n"]
    recipe = {
        "name": name,
        "task": task if isinstance(task, str | None) else list(task),
        "embodiment": embodiment if isinstance(embodiment, str | None) else list(embodiment),
        "quality_min": quality_min,
        "quality_max": quality_max,
        "sampling": sample,
        "limit": limit,
        "seed": seed,
        "n_source": counts,
        "created_at": datetime.now(UTC).isoformat(),
    }
    write_text(store.spark, f"{store.path}/datasets/{name}/recipe.json", json.dumps(recipe, sort_keys=True))
    found.select("episode_id").write.mode("overwrite").parquet(f"{store.path}/datasets/{name}/source_ids")
    taken.select("rank", "episode_id").write.mode("overwrite").parquet(f"{store.path}/datasets/{name}/sampled_ids")
    return Dataset(taken, name, recipe)


def reopen(store: Store, name: str) -> Dataset:
    """A dataset by name; one that sampled nothing is empty, not the whole source."""
    from ..sources.store import read_text

    recipe = json.loads(read_text(store.spark, f"{store.path}/datasets/{name}/recipe.json"))
    ids = store.spark.read.parquet(f"{store.path}/datasets/{name}/sampled_ids")
    return Dataset(store.episodes().join(ids, "episode_id"), name, recipe)
