"""Errors: each says what is wrong, and what to do about it."""


class StepweaveError(Exception):
    """Base of all errors of this library."""


class IngestError(StepweaveError):
    """A recording or dataset cannot be read."""


class StorageError(StepweaveError):
    """A stored episode is missing, twice there or broken."""


class QualityError(StepweaveError):
    """Scores, weights or metrics are out of their ranges."""


class ComposeError(StepweaveError):
    """A dataset cannot be put together as asked for."""


class LineageError(StepweaveError):
    """A snapshot or experiment is missing, empty or ambiguous."""


class ServeError(StepweaveError):
    """Batches cannot be made."""


class ImmutableError(StepweaveError):
    """A frozen record was to be changed."""


def need(module: str, what: str):
    """The module, or an error that says what it is needed for."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise IngestError(f"{what} needs the package {module}, which is not installed; install it or use another format") from e
