"""The store: steps in the wide or the array layout, a catalog table, recipes, export."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..functions.keys import episode_name
from ..operators.catalog import read_filtered, with_keys
from ..operators.ranking import global_rank
from ..work import stored

#: Episodes whose steps share a folder.
BUCKET = 1000
#: Fixed value: bytes from which a store is called large.
LARGE_BYTES = 50 << 30


def to_wide(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Array columns as one float column for each dimension: name_0, name_1, ..."""
    rest = [c for c in df.columns if c not in widths]
    return df.select(*rest, *[F.get(c, F.lit(i)).cast("float").alias(f"{c}_{i}") for c, n in widths.items() for i in range(n)])


def from_wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Back to arrays; dimensions in the order of their numbers."""
    found = {n: sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{re.escape(n)}_(\d+)", c))) for n in names}
    used = {c for own in found.values() for _, c in own}
    return df.select(*[c for c in df.columns if c not in used], *[F.array(*[F.col(c) for _, c in own]).alias(n) for n, own in found.items()])


def number_after(rows: DataFrame, base: int, order: str) -> DataFrame:
    """Adds episode_num: base + 1, base + 2, ... by order."""
    return global_rank(rows, [order], "episode_num").withColumn("episode_num", F.col("episode_num") + F.lit(base))


def _number(episode_id: Column) -> Column:
    return F.regexp_extract(episode_id, r"(\d+)$", 1).try_cast("bigint")


def size_of(files: DataFrame, large: int = LARGE_BYTES) -> DataFrame:
    """total_bytes of files (length), and whether that is over large."""
    return files.agg(F.sum("length").alias("total_bytes")).withColumn("large", F.col("total_bytes") > large)


class Store:
    """steps/ and episodes/ below a folder. Every save appends, with new numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def episodes(self) -> DataFrame:
        if not self._there("episodes"):
            return self.spark.createDataFrame([], "episode_num bigint, episode_id string, source_path string, task string, embodiment string, success boolean, n_steps bigint, duration_ns bigint, smoothness double, consistency double, completeness double, overall double, task_key string, embodiment_key string")
        return self.spark.read.parquet(f"{self.path}/episodes")

    def steps(self) -> DataFrame:
        if not self._there("steps"):
            raise StorageError(f"{self.path} has no steps; save episodes first")
        return self.spark.read.parquet(f"{self.path}/steps").drop("_bucket")

    def _last(self) -> int:
        """The largest number given so far, also by a save that did not come to its end."""
        last = self.episodes().agg(F.max("episode_num")).first()[0] or 0
        if self._there("steps"):
            steps = self.spark.read.parquet(f"{self.path}/steps")
            if "_bucket" in steps.columns and (top := steps.agg(F.max("_bucket")).first()[0]) is not None:
                last = max(last, steps.where(F.col("_bucket") == top).agg(F.max(_number(F.col("episode_id")))).first()[0] or 0)
        return last

    def save(self, steps: DataFrame, episodes: DataFrame) -> DataFrame:
        """Appends; returns the new catalog rows. steps and episodes share episode_id, which is replaced by the store's own.

        All scores of the catalog row are kept, so that they are there again when the store is read.
        """
        base = self._last()
        if episodes.groupBy("episode_id").count().where("count > 1").head(1):
            raise StorageError("an episode id is there twice; make ids unique before saving")
        rows = number_after(episodes.withColumnRenamed("episode_id", "_old"), base, "_old")
        rows = rows.withColumn("episode_id", episode_name(F.col("episode_num")))
        for c, kind in (("source_path", "string"), ("task", "string"), ("embodiment", "string"), ("success", "boolean"), ("n_steps", "bigint"), ("duration_ns", "bigint"), ("smoothness", "double"), ("consistency", "double"), ("completeness", "double"), ("overall", "double")):
            rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
        rows = stored(with_keys(rows), "episodes")  # steps and catalog have to get the same numbers
        ids = rows.select("_old", "episode_id", F.floor(F.col("episode_num") / BUCKET).cast("int").alias("_bucket"))
        named = steps.withColumnRenamed("episode_id", "_old").join(ids, "_old").drop("_old")
        columns = self.episodes().columns
        named.repartition("_bucket", F.pmod(F.xxhash64("episode_id"), F.lit(8))).write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/steps")
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/episodes")
        return self.episodes().where(F.col("episode_num") > base)

    def load(self, episode_id: str) -> DataFrame:
        steps, number = self.steps(), re.fullmatch(r"ep_(\d+)", episode_id)
        if number and "_bucket" in (own := self.spark.read.parquet(f"{self.path}/steps")).columns:
            steps = own.where(F.col("_bucket") == int(number[1]) // BUCKET).drop("_bucket")
        out = steps.where(F.col("episode_id") == episode_id)
        if not out.head(1):
            raise StorageError(f"no episode {episode_id} in {self.path}")
        return out

    def export(self, chosen: DataFrame, target: str, recipe: Mapping | None = None) -> DataFrame:
        """Copies steps and catalog rows of the chosen ids; returns the ids that are not there."""
        read_filtered(self.steps(), chosen).write.mode("overwrite").parquet(f"{target}/steps")
        read_filtered(self.episodes(), chosen).write.mode("overwrite").parquet(f"{target}/episodes")
        if recipe is not None:
            write_text(self.spark, f"{target}/recipe.json", json.dumps(recipe, sort_keys=True))
        return chosen.select("episode_id").join(self.episodes(), "episode_id", "left_anti")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
