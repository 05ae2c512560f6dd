"""Settings: a frozen record that is passed to what uses it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from .errors import QualityError

#: Weights of the built-in metrics.
DEFAULT_WEIGHTS = {"smoothness": 0.40, "consistency": 0.35, "completeness": 0.25}


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """All three built-in metrics have to be there; all weights together make 1 within 0.001."""
    missing = [k for k in DEFAULT_WEIGHTS if k not in weights]
    if missing:
        raise QualityError(f"weights lack {', '.join(missing)}; give all of {', '.join(DEFAULT_WEIGHTS)}")
    bad = [k for k, v in weights.items() if isinstance(v, bool) or not isinstance(v, int | float) or v < 0]
    if bad:
        raise QualityError(f"weights of {', '.join(bad)} are no numbers of 0 or more")
    if abs(sum(weights.values()) - 1.0) > 0.001:
        raise QualityError(f"weights make {sum(weights.values()):.4f}; they have to make 1")
    return {k: float(v) for k, v in weights.items()}


@dataclass(frozen=True)
class Settings:
    quiet: bool = field(default_factory=lambda: os.environ.get("STEPWEAVE_QUIET") == "1")
    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    rate_hz: float = 50.0
    gap_ns: int = 1_000_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "weights", check_weights(self.weights))

    def with_weights(self, weights: Mapping[str, float]) -> Settings:
        return replace(self, weights=weights)
