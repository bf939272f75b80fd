"""Provenance on disk: RNG records in metadata, content-addressed inputs, and folders of executions."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from kymo.errors import ProvenanceError
from kymo.sources.writer import sync_folder, utc_now, write_synced

RNG_KEY = "rng_records"
_sequence = itertools.count()


@dataclass(frozen=True)
class RngRecord:
    """How numbers were drawn; ``parameters`` are the application's own."""

    namespace: str
    method: str
    version: str
    key_encoding: str
    key: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("namespace", "method", "version", "key_encoding", "key"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip():
                raise ProvenanceError("empty_field", f"{name} is blank", field=name)

    def to_json(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in ("namespace", "method", "version", "key_encoding", "key")}
        return own | ({"parameters": self.parameters} if self.parameters else {})

    def insert_into(self, metadata: dict[str, Any]) -> None:
        """Add to user metadata; a namespace is never replaced."""
        records = metadata.setdefault(RNG_KEY, {})
        if not isinstance(records, dict):
            raise ProvenanceError("metadata_shape", f"{RNG_KEY} is no object")
        if self.namespace in records:
            raise ProvenanceError("duplicate_namespace", f"{self.namespace} is recorded already")
        records[self.namespace] = self.to_json()

    @classmethod
    def find(cls, metadata: dict[str, Any], namespace: str) -> RngRecord | None:
        records = metadata.get(RNG_KEY, {})
        if not isinstance(records, dict):
            raise ProvenanceError("metadata_shape", f"{RNG_KEY} is no object")
        if namespace not in records:
            return None
        try:
            own = cls(**records[namespace])
        except TypeError as e:
            raise ProvenanceError("invalid_record", f"{namespace}: {e}") from e
        if own.namespace != namespace:
            raise ProvenanceError("namespace_mismatch", f"{namespace} holds a record of {own.namespace}")
        return own


def _safe(name: str, what: str = "name") -> str:
    if not isinstance(name, str) or not name.strip() or name in (".", "..") or re.search(r"[/\\\0]", name):
        raise ProvenanceError("unsafe_name", f"{name!r} is no safe {what}")
    return name


class ExecutionScope:
    """A folder for one execution's recordings and inputs."""

    def __init__(self, directory: Path, created_at_utc: str | None = None):
        self.directory, self.created_at_utc = directory, created_at_utc

    @classmethod
    def open_or_create(cls, root: str | Path) -> ExecutionScope:
        Path(root).mkdir(parents=True, exist_ok=True)
        return cls(Path(root))

    @classmethod
    def create_generated(cls, root: str | Path) -> ExecutionScope:
        now = utc_now()
        stamp = re.sub(r"[-:]", "", now[:19]) + "Z"
        Path(root).mkdir(parents=True, exist_ok=True)
        for _ in range(1024):
            folder = Path(root) / f"execution-{stamp}-{os.getpid()}-{next(_sequence)}"
            try:
                folder.mkdir()
                return cls(folder, now)
            except FileExistsError:
                continue
        raise ProvenanceError("names_exhausted", f"no free name below {root}")

    @classmethod
    def create_named(cls, root: str | Path, name: str) -> ExecutionScope:
        folder = Path(root) / _safe(name)
        Path(root).mkdir(parents=True, exist_ok=True)
        try:
            folder.mkdir()
        except FileExistsError:
            raise ProvenanceError("scope_exists", f"{folder} is there already") from None
        return cls(folder, utc_now())

    @classmethod
    def open_existing(cls, directory: str | Path) -> ExecutionScope:
        if not Path(directory).is_dir():
            raise ProvenanceError("missing_scope", f"{directory} is no folder")
        return cls(Path(directory))

    def task_recording_directory(self, ordinal: int) -> Path:
        return self.directory / f"task-{ordinal:06d}"

    def named_task_recording_directory(self, name: str) -> Path:
        for part in name.split("/"):
            _safe(part, "relative name")
        return self.directory / name


@dataclass(frozen=True)
class Artifact:
    sha256: str
    path: str


def persist_artifact(scope: ExecutionScope, stem: str, extension: str, data: bytes) -> tuple[Artifact, bool]:
    """Publish bytes under their digest: the artifact, and whether it was created rather than found."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", stem) or not re.fullmatch(r"[A-Za-z0-9]+", extension):
        raise ProvenanceError("unsafe_name", "stem and extension must be safe parts of a file name")
    digest = hashlib.sha256(data).hexdigest()
    folder = scope.directory / "inputs"
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{stem}-{digest}.{extension}"
    own = Artifact(digest, f"inputs/{target.name}")
    staged = folder / f".{uuid.uuid4().hex}.tmp"
    write_synced(staged, data)
    try:
        os.link(staged, target)
        created = True
    except FileExistsError:
        created = False
        if target.read_bytes() != data:
            raise ProvenanceError("artifact_conflict", f"{target} holds other bytes") from None
    finally:
        staged.unlink()
    sync_folder(folder)
    return own, created


def load_artifact(directory: str | Path, artifact: Artifact) -> bytes:
    """The bytes, once the path is inside the execution's folder and the digest is right."""
    if not re.fullmatch(r"[0-9a-f]{64}", artifact.sha256) or any(p in ("", ".", "..") for p in artifact.path.split("/")):
        raise ProvenanceError("invalid_descriptor", "the artifact's path or digest is malformed")
    root = Path(directory).resolve()
    try:
        path = (root / artifact.path).resolve(strict=True)
        if not path.is_relative_to(root):
            raise ProvenanceError("invalid_descriptor", f"{artifact.path} leads outside")
        data = path.read_bytes()
    except OSError as e:
        raise ProvenanceError("unreadable_artifact", str(e)) from e
    if hashlib.sha256(data).hexdigest() != artifact.sha256:
        raise ProvenanceError("digest_mismatch", f"{path} holds other bytes")
    return data
