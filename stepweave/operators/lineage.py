"""Provenance: content-addressed snapshots, experiments, differences, chains of parents."""

from __future__ import annotations

import hashlib
import json
import subprocess
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LineageError
from ..work import stored

SNAPSHOTS = "snapshot_id string, name string, project string, episode_ids array<string>, recipe string, created_at timestamp, metadata map<string,string>"
EXPERIMENTS = "experiment_id string, name string, project string, dataset_snapshot string, parent_id string, hypothesis string, assumptions array<string>, tags array<string>, metrics map<string,double>, config map<string,string>, status string, git_commit string, notes string, created_at timestamp, completed_at timestamp"
STATUSES = ("running", "completed", "failed")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def snapshot_hash(episode_ids: Sequence[str], recipe: Mapping) -> str:
    return hashlib.sha256(canonical({"episode_ids": sorted(episode_ids), "recipe": recipe}).encode()).hexdigest()


def git_commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


class Ledger:
    """Snapshots and experiments, as two tables under a folder. Records are appended; the latest version of an id holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, key: str, at: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version bigint").parquet(f"{self.path}/{name}")
        fields = [c for c in rows.columns if c not in (key, "version")]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "version").alias("r"))
        return last.select(key, "r.*").select(*[c for c in rows.columns if c != "version"])

    def _append(self, name: str, schema: str, row: dict) -> None:
        version = datetime.now(UTC)
        row = row | {"version": int(version.timestamp() * 1e6)}
        self.spark.createDataFrame([row], f"{schema}, version bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOTS, "snapshot_id", "created_at")

    def experiments(self) -> DataFrame:
        return self._read("experiments", EXPERIMENTS, "experiment_id", "created_at")

    def snapshot(self, episode_ids: Sequence[str], recipe: Mapping, name: str, project: str = "default") -> dict:
        """The same ids and recipe give the record that is already there, with its old name."""
        if not episode_ids:
            raise LineageError("a snapshot of no episodes says nothing; choose episodes first")
        key = snapshot_hash(episode_ids, recipe)
        found = self.snapshots().where(F.col("snapshot_id") == key).head(1)
        if found:
            return found[0].asDict()
        row = {"snapshot_id": key, "name": name, "project": project, "episode_ids": sorted(episode_ids), "recipe": canonical(recipe), "created_at": datetime.now(UTC), "metadata": {"n_episodes": str(len(episode_ids))}}
        self._append("snapshots", SNAPSHOTS, row)
        return row

    def experiment(self, name: str, snapshot_id: str, project: str = "default", hypothesis: str = "", assumptions: Sequence[str] = (), tags: Sequence[str] = (), config: Mapping | None = None) -> dict:
        """Running; its parent is the project's latest experiment."""
        parent = latest(self.experiments().where(F.col("project") == project), "project").head(1)
        row = {
            "experiment_id": uuid.uuid4().hex[:12],
            "name": name,
            "project": project,
            "dataset_snapshot": snapshot_id,
            "parent_id": parent[0]["experiment_id"] if parent else None,
            "hypothesis": hypothesis,
            "assumptions": list(assumptions),
            "tags": list(tags),
            "metrics": {},
            "config": {k: canonical(v) for k, v in (config or {}).items()},
            "status": "running",
            "git_commit": git_commit(),
            "notes": "",
            "created_at": datetime.now(UTC),
            "completed_at": None,
        }
        self._append("experiments", EXPERIMENTS, row)
        return row

    def log(self, experiment_id: str, metrics: Mapping[str, float] | None = None, config: Mapping | None = None, status: str | None = None, notes: str | None = None) -> dict:
        """Merges metrics and config, the new values winning; only completed sets completed_at."""
        if status is not None and status not in STATUSES:
            raise LineageError(f"status is {status!r}; choose one of {', '.join(STATUSES)}")
        found = self.experiments().where(F.col("experiment_id") == experiment_id).head(1)
        if not found:
            raise LineageError(f"no experiment {experiment_id}; create it first")
        row = found[0].asDict()
        row["metrics"] = (row["metrics"] or {}) | {k: float(v) for k, v in (metrics or {}).items()}
        row["config"] = (row["config"] or {}) | {k: canonical(v) for k, v in (config or {}).items()}
        row["status"], row["notes"] = status or row["status"], notes if notes is not None else row["notes"]
        if status == "completed":
            row["completed_at"] = datetime.now(UTC)
        self._append("experiments", EXPERIMENTS, row)
        return row

    def resolve(self, name: str, project: str | None = None) -> dict:
        """By name; several projects that have the name have to be told apart."""
        found = self.experiments().where(F.col("name") == name)
        found = found if project is None else found.where(F.col("project") == project)
        rows = found.orderBy(F.col("created_at").desc()).collect()
        if not rows:
            raise LineageError(f"no experiment is called {name}")
        if len({r["project"] for r in rows}) > 1:
            raise LineageError(f"several projects have an experiment {name}: {', '.join(sorted({r['project'] for r in rows}))}; name the project")
        return rows[0].asDict()

    def compare(self, a: str, b: str, project: str | None = None) -> dict:
        """Metric differences, config changes, episodes added and removed between two experiments."""
        x, y = self.resolve(a, project), self.resolve(b, project)
        own, other = x["metrics"] or {}, y["metrics"] or {}
        deltas = {k: other[k] - own[k] if k in own and k in other else None for k in sorted({*own, *other})}
        c, d = x["config"] or {}, y["config"] or {}
        changes = {"added": {k: d[k] for k in sorted(d.keys() - c.keys())}, "removed": sorted(c.keys() - d.keys()), "changed": {k: (c[k], d[k]) for k in sorted(c.keys() & d.keys()) if c[k] != d[k]}}
        shots = {r["snapshot_id"]: set(r["episode_ids"]) for r in self.snapshots().where(F.col("snapshot_id").isin(x["dataset_snapshot"], y["dataset_snapshot"])).collect()}
        if x["dataset_snapshot"] == y["dataset_snapshot"]:
            added, removed = [], []
        elif len(shots) < 2:
            raise LineageError("a snapshot of these experiments is missing")
        else:
            p, q = shots[x["dataset_snapshot"]], shots[y["dataset_snapshot"]]
            added, removed = sorted(q - p), sorted(p - q)
        return {"a": x["experiment_id"], "b": y["experiment_id"], "metric_deltas": deltas, "config_changes": changes, "episodes_added": added, "episodes_removed": removed, "hypotheses": (x["hypothesis"], y["hypothesis"])}

    def lineage(self, name: str) -> DataFrame:
        """From the root to the latest experiment of this name, each with its snapshot's number of episodes (0 if it is missing)."""
        experiments = self.experiments()
        leaf = experiments.where(F.col("name") == name).orderBy(F.col("created_at").desc(), "experiment_id").limit(1)
        chain = ancestors(experiments, leaf.select("experiment_id"))
        shots = self.snapshots().select(F.col("snapshot_id").alias("dataset_snapshot"), F.size("episode_ids").alias("n_episodes"))
        return chain.join(experiments, "experiment_id").join(shots, "dataset_snapshot", "left").withColumn("n_episodes", F.coalesce("n_episodes", F.lit(0))).orderBy(F.col("depth").desc())


def latest(experiments: DataFrame, by: str) -> DataFrame:
    """(by, experiment_id) of the latest of each; of equal times, the larger id."""
    return experiments.groupBy(by).agg(F.max_by("experiment_id", F.struct("created_at", "experiment_id")).alias("experiment_id"))


def ancestors(experiments: DataFrame, leaves: DataFrame, key: str = "experiment_id", parent: str = "parent_id") -> DataFrame:
    """(leaf, key, depth): each leaf at depth 0 and what it descends from. A missing parent ends a chain, and so does a cycle.

    Pointers are doubled: after k rounds all ancestors up to depth 2 ** k are there, so the joins number the logarithm of the depth,
    which has no limit. Each round's tables are written.
    """
    nodes = experiments.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    jump = stored(nodes.join(nodes.select(F.col("id").alias("up")), "up").select("id", "up"), "jumps")
    found = stored(nodes.select("id").join(leaves.select(F.col(key).alias("id")).distinct(), "id").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("depth")), "found")
    step = 1
    while True:
        further = found.join(jump, "id").groupBy("leaf", F.col("up").alias("id")).agg(F.min(F.col("depth") + step).alias("depth"))
        further = stored(further.join(found.select("leaf", "id"), ["leaf", "id"], "left_anti"), "further")
        if not further.head(1):
            return found.select("leaf", F.col("id").alias(key), F.col("depth").cast("int").alias("depth"))
        found = stored(found.unionByName(further), "found")
        over = jump.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jump = stored(jump.join(over, "up").select("id", F.col("top").alias("up")), "jumps")
        step *= 2


def added_removed(a: DataFrame, b: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, change): in b only is added, in a only is removed."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return y.exceptAll(x).withColumn("change", F.lit("added")).union(x.exceptAll(y).withColumn("change", F.lit("removed")))


def metric_deltas(a: DataFrame, b: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """(key, a, b, delta): of all keys of either; null where one has none or no number."""
    x = a.select(key, F.col(value).cast("string").try_cast("double").alias("a"))
    y = b.select(key, F.col(value).cast("string").try_cast("double").alias("b"))
    return x.join(y, key, "full_outer").withColumn("delta", F.col("b") - F.col("a"))


def config_changes(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, old, new, change) of the keys that are added, removed or changed."""
    x = a.select(key, F.col(value).alias("old"), F.lit(True).alias("_x"))
    y = b.select(key, F.col(value).alias("new"), F.lit(True).alias("_y"))
    both = x.join(y, key, "full_outer")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").drop("_x", "_y")
