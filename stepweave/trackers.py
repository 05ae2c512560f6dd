"""What is told to experiment trackers, if one is installed and has an active run; never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.scoring import tracker_stats


def params(episodes: DataFrame, recipe: dict) -> dict:
    stats = tracker_stats(episodes).first().asDict()
    return {f"dataset.{k}": v for k, v in recipe.items() if v is not None} | {f"dataset.quality_{k}": v for k, v in stats.items()}


def notify(values: dict, warn=print) -> list[str]:
    """Names of the trackers that were told."""
    told = []
    for name, tell in (("wandb", _wandb), ("mlflow", _mlflow)):
        try:
            if tell(values):
                told.append(name)
        except ImportError:
            continue
        except Exception as e:  # noqa: BLE001  a tracker must not end a training run
            warn(f"{name} was not told: {e}")
    return told


def _wandb(values: dict) -> bool:
    import wandb

    if wandb.run is None:
        return False
    wandb.config.update(values)
    return True


def _mlflow(values: dict) -> bool:
    import mlflow

    if mlflow.active_run() is None:
        return False
    mlflow.log_params(values)
    return True
