"""One exception tree. ``code`` tells apart errors of one family; ``context`` carries what was involved."""

from __future__ import annotations

from typing import Any


class KymoError(Exception):
    def __init__(self, code: str, message: str, **context: Any):
        super().__init__(message)
        self.code, self.context = code, context


class ConfigurationError(KymoError):
    """A parameter document, sweep, path file or lookup in them."""


class StateError(KymoError):
    """A row's fields, types or time."""


class PayloadInsertError(StateError):
    """A value that a field doesn't take; ``value`` is handed back."""

    def __init__(self, code: str, message: str, value: Any, **context: Any):
        super().__init__(code, message, **context)
        self.value = value


class SeriesError(KymoError):
    """Rows that may not follow the series; ``rejected`` is handed back unchanged."""

    def __init__(self, code: str, message: str, rejected: Any = None, **context: Any):
        super().__init__(code, message, **context)
        self.rejected = rejected


class RecordingError(KymoError):
    """Base of what a recording's reader or writer raises."""


class MetadataError(RecordingError):
    """The metadata document breaks a rule of the format."""


class RecordingNotCompleteError(MetadataError):
    """The recording is running or failed."""


class UnknownStreamError(RecordingError, KeyError):
    """No stream of that name."""


class IntegrityError(RecordingError):
    """A chunk is missing or isn't what its descriptor says."""


class RecordError(RecordingError):
    """A record line breaks its stream's contract."""


class DecoderError(RecordingError):
    """A field decoder is missing or failed."""


class StorageError(RecordingError):
    """Writing, continuing or recovering a recording."""


class RuntimePlanError(KymoError):
    """Phases, tasks, labels and their execution."""


class ProvenanceError(KymoError):
    """RNG records, artifacts and execution scopes."""
