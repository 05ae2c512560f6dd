"""Command line: ingest, list, info, export. Exit code 1 if something is missing or cannot be read."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import StepweaveError
from .operators import catalog, compose, scoring
from .sources import dataset, detect
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stepweave")
    out.add_argument("--json", action="store_true")
    sub = out.add_subparsers(dest="command", required=True)
    for name, args in {"ingest": ["path", "store"], "list": ["store"], "info": ["store", "episode_id"], "export": ["store", "name", "target"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    return out


def ingest(spark: SparkSession, path: str, store: Store) -> dict:
    kind = detect.detect(path)
    if kind != "dataset":
        raise StepweaveError(f"{path} is of format {kind}; the command line reads datasets with meta/info.json")
    steps, episodes = dataset.load(spark, path)
    scores = scoring.score(steps, "action", ["t_ns", "step"]).drop("n_steps")
    saved = store.save(steps, episodes.join(scores, "episode_id"))
    return {"episodes": saved.count()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stepweave").getOrCreate()
    try:
        store = Store(spark, args.store)
        if args.command == "ingest":
            result = ingest(spark, args.path, store)
        elif args.command == "list":
            result = [r.asDict() for r in catalog.listing(store.episodes()).toLocalIterator()]
        elif args.command == "info":
            found = store.episodes().where(F.col("episode_id") == args.episode_id).head(1)
            if not found:
                raise StepweaveError(f"no episode {args.episode_id}")
            result = found[0].asDict()
        else:
            chosen = compose.reopen(store, args.name)
            missing = [r["episode_id"] for r in store.export(chosen.episodes, args.target, chosen.recipe).toLocalIterator()]
            result = {"missing": missing}
            print(json.dumps(result) if args.json else result)
            return int(bool(missing))
    except StepweaveError as e:
        print(json.dumps({"error": str(e)}) if args.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(result, default=str) if args.json else result)
    return 0


if __name__ == "__main__":
    sys.exit(main())
