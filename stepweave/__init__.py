"""An episodic data engine on PySpark: ingest, align, cut, score, filter, sample, trace and serve recordings."""

from .config import Settings
from .errors import StepweaveError
from .operators.compose import Dataset, compose
from .operators.lineage import Ledger
from .operators.scoring import Metrics, score
from .sources.store import Store

__all__ = ["Dataset", "Ledger", "Metrics", "Settings", "StepweaveError", "Store", "compose", "score"]
