"""Recordings as a sink: a folder that one writer owns, with chunk files per stream and one metadata document.

The metadata is the authority: a chunk is there once its descriptor is committed. Chunks are staged under other names,
synced, then described, then renamed, so a crash leaves nothing that ``reconcile`` can't settle.

Two ways in: ``observe_state`` takes one state after another on the driver, as a simulation makes them; ``record`` takes a
whole DataFrame, whose chunks executors write side by side while the driver only commits their descriptors.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import time
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.errors import RecordError, StorageError
from kymo.functions.strict_json import pretty
from kymo.operators import chunks as chunk_ops
from kymo.operators import streams as stream_ops
from kymo.operators.state import State, StateSchema
from kymo.operators.streams import Storage, StreamConfig
from kymo.shipping import ship
from kymo.sources import metadata
from kymo.sources.reader import checked_lines, dump, parsed_record, verified_bytes


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


def sync_folder(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_synced(path: Path, data: bytes) -> None:
    with path.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def replace_synced(path: Path, data: bytes) -> None:
    """The file has the old bytes or the new ones, never a part."""
    staged = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    write_synced(staged, data)
    os.replace(staged, path)
    sync_folder(path.parent)


def descriptor(ordinal: int, data: bytes, iterations: Sequence[int]) -> dict[str, Any]:
    return {
        "ordinal": ordinal,
        "file": metadata.chunk_name(ordinal),
        "records": len(iterations),
        "bytes": len(data),
        "checksum": "sha256:" + hashlib.sha256(data).hexdigest(),
        "first_iteration": iterations[0],
        "last_iteration": iterations[-1],
    }


class _Stream:
    """A stream's open chunk on the driver."""

    def __init__(self, config: dict[str, Any], schema: StateSchema):
        self.config = config
        self.fields = [f["name"] for f in config["fields"]]
        self.interval = config["sampling_interval"]["iterations"]
        self.target = config["storage"]["layout"].get("target_bytes")
        self.queue = config["storage"]["storage_queue_bytes"]
        self.lines: list[bytes] = []
        self.iterations: list[int] = []
        self.size = 0
        self.last = config["chunks"][-1]["last_iteration"] if config["chunks"] else None

    def encode(self, state: State) -> bytes:
        if any(not state.contains_payload(f) for f in self.fields):
            raise StorageError("missing_payload", f"a field of {self.config['name']} is empty")
        record = {"iteration": state.iteration} | ({} if state.physical_time is None else {"physical_time": state.physical_time})
        try:
            return (dump(record | {"values": [state.payload(f) for f in self.fields]}) + "\n").encode()
        except (TypeError, ValueError) as e:
            raise StorageError("encode_payload", f"{self.config['name']}: {e}") from e


class RecordingBuilder:
    """Everything about a recording that doesn't change; nothing touches the disk before create or continue."""

    def __init__(self, root: str | Path, schema: StateSchema, format_name: str = metadata.FORMAT):
        self.root, self.schema, self.format_name = Path(root), schema, format_name
        self.time: dict[str, Any] = {"iteration_name": "iteration"}
        self.user_metadata: dict[str, Any] = {}
        self.shared: Storage | None = None
        self.streams: list[StreamConfig] = []

    def with_time_axis(self, iteration_name: str, iteration_unit: str | None = None, physical_time_name: str | None = None, physical_time_unit: str | None = None) -> RecordingBuilder:
        named = {"iteration_name": iteration_name, "iteration_unit": iteration_unit, "physical_time_name": physical_time_name, "physical_time_unit": physical_time_unit}
        self.time = {k: v for k, v in named.items() if v is not None}
        return self

    def with_user_metadata(self, more: dict[str, Any]) -> RecordingBuilder:
        self.user_metadata |= more
        return self

    def with_task_parameters(self, task: Any) -> RecordingBuilder:
        self.user_metadata |= task.to_json() | {"task_ordinal": task.ordinal}
        return self

    def with_shared_storage(self, storage: Storage) -> RecordingBuilder:
        self.shared = storage
        return self

    def add_stream(self, stream: StreamConfig) -> RecordingBuilder:
        self.streams.append(stream)
        return self

    def document(self) -> dict[str, Any]:
        found = []
        for s in self.streams:
            storage = s.storage or self.shared
            if storage is None:
                raise StorageError("missing_storage", f"{s.name} has no storage and there is none to share")
            if s.interval < 1:
                raise StorageError("invalid_interval", "a sampling interval is a positive integer")
            fields = [{"name": f.name} | ({"description": f.description} if f.description else {}) for f in map(self.schema.field, stream_ops.projected(self.schema, s.fields))]
            found.append({"name": s.name, "directory": s.directory or f"streams/{s.name}", "sampling_interval": {"iterations": s.interval}, "fields": fields, "storage": storage.to_json(), "chunks": []})
        timing = {"created_at_utc": utc_now(), "active_duration_ns": 0, "continuation_count": 0}
        return metadata.validated(
            {"format": self.format_name, "version": metadata.VERSION, "status": {"state": "running"}, "timing": timing, "records": {"encoding": "json", "framing": "json_lines"}, "time": self.time, "user_metadata": self.user_metadata, "streams": found}
        )

    def create(self) -> RecordingWriter:
        """A new folder; an existing one is refused, and nothing is made before all is valid."""
        document = self.document()
        try:
            self.root.mkdir(parents=True)
        except FileExistsError:
            raise StorageError("recording_exists", f"{self.root} is there already") from None
        for s in document["streams"]:
            (self.root / s["directory"]).mkdir(parents=True)
        writer = RecordingWriter(self, document)
        writer.commit()
        return writer

    def _continued(self) -> RecordingWriter:
        found, own = metadata.read(self.root, self.format_name), self.document()
        if found["status"]["state"] != "running":
            raise StorageError("not_running", f"the recording is {found['status']['state']}")
        fixed = lambda d: {k: v for k, v in d.items() if k not in ("timing", "terminal_metadata", "streams")} | {"streams": [{k: v for k, v in s.items() if k != "chunks"} for s in d["streams"]]}
        if fixed(found) != fixed(own):
            raise StorageError("continuation_mismatch", "the recording was made with other settings")
        writer = RecordingWriter(self, found)
        try:
            reconcile(self.root, found)
        except BaseException:
            writer.close()
            raise
        found["timing"]["continuation_count"] += 1
        return writer

    def continue_existing(self) -> RecordingWriter:
        """Append behind what is there; no rewind."""
        writer = self._continued()
        writer.commit()
        return writer

    def continue_from_checkpoint(self, stream: str | None = None) -> tuple[RecordingWriter, State]:
        """Rewind all streams to the newest complete state (of ``stream``, if named) and give it back."""
        writer = self._continued()
        try:
            chosen = newest_checkpoint(writer.document, self.schema, stream)
            last = chosen["chunks"][-1]
            data = verified_bytes(self.root / chosen["directory"] / last["file"], last["bytes"], last["checksum"])
            line = checked_lines(data, last["records"], last["first_iteration"], last["last_iteration"], len(chosen["fields"]))[-1][1]
            iteration, moment, values = parsed_record(line, len(chosen["fields"]))
            state = State(self.schema, iteration, moment)
            for f, v in zip(chosen["fields"], values, strict=True):
                state.insert_payload(f["name"], v)
            rewind(self.root, writer.document, iteration, writer.commit)
        except BaseException:
            writer.close()
            raise
        return RecordingWriter(self, writer.document, writer.lease), state

    def open_or_resume(self) -> tuple[RecordingWriter, State | None]:
        """A new recording where there is none; else its continuation, which needs a checkpoint."""
        return self.continue_from_checkpoint() if self.root.exists() else (self.create(), None)


class RecordingWriter:
    def __init__(self, builder: RecordingBuilder, document: dict[str, Any], lease: int | None = None):
        self.root, self.schema, self.document = builder.root, builder.schema, document
        self.lease = self._take() if lease is None else lease
        self.streams = [_Stream(s, self.schema) for s in document["streams"]]
        self.began = time.monotonic_ns()

    def _take(self) -> int:
        """The folder's lock, held until close: one writer at a time."""
        fd = os.open(self.root, os.O_RDONLY)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            os.close(fd)
            raise StorageError("writer_active", f"another writer has {self.root}") from None
        return fd

    def close(self) -> None:
        if self.lease >= 0:
            os.close(self.lease)
            self.lease = -1

    def __enter__(self) -> RecordingWriter:
        return self

    def __exit__(self, *_: Any) -> None:
        if self.lease >= 0:  # what was taken in is kept; the recording stays running
            for s in self.streams:
                self._seal(s)
            self.close()

    @property
    def recording_directory(self) -> Path:
        return self.root

    def stream_names(self) -> list[str]:
        return [s.config["name"] for s in self.streams]

    def commit(self) -> None:
        kept = {k: v for k, v in self.document.items() if v or k not in ("user_metadata", "terminal_metadata")}
        metadata.validated(dict(kept))
        replace_synced(self.root / metadata.FILE, pretty(kept))

    def _running(self) -> None:
        if self.lease < 0 or self.document["status"]["state"] != "running":
            raise StorageError("writer_closed", "the writer is closed")

    def observe_state(self, state: State) -> None:
        """Every stream that is due takes the state; the iteration it took last is passed over. An error at one stream
        leaves what those before it took."""
        self._running()
        for s in self.streams:
            if state.iteration % s.interval == 0:
                self._append(s, state)

    def _append(self, s: _Stream, state: State) -> None:
        if state.iteration == s.last:
            return
        if s.last is not None and state.iteration < s.last:
            raise StorageError("out_of_order_iteration", f"{s.config['name']} has {s.last} already", previous=s.last)
        line = s.encode(state)
        if len(line) > s.queue:
            raise StorageError("record_too_large", f"a record of {len(line)} bytes can't be queued in {s.queue}")
        if s.target is not None and s.size and s.size + len(line) > s.target:
            self._seal(s)
        s.lines.append(line)
        s.iterations.append(state.iteration)
        s.size += len(line)
        s.last = state.iteration
        if s.target is None or s.size >= s.target:
            self._seal(s)

    def _seal(self, s: _Stream) -> None:
        if not s.lines:
            return
        data = b"".join(s.lines)
        own = descriptor(len(s.config["chunks"]), data, s.iterations)
        folder = self.root / s.config["directory"]
        staged = folder / (own["file"] + ".tmp")
        write_synced(staged, data)
        sync_folder(folder)
        s.config["chunks"].append(own)
        self.commit()
        os.rename(staged, folder / own["file"])
        sync_folder(folder)
        s.lines, s.iterations, s.size = [], [], 0

    def flush_stream(self, name: str) -> None:
        """Seal the open chunk, however short; nothing where it is empty."""
        self._running()
        found = [s for s in self.streams if s.config["name"] == name]
        if not found:
            raise StorageError("unknown_stream", f"no stream {name!r}")
        self._seal(found[0])

    def record(self, states: DataFrame, kinds: dict[str, str] | None = None, final: bool = False, late: str = "pass") -> None:
        """All rows of a DataFrame (iteration, physical_time and fields), streams one after another.

        With ``late`` "raise" rows must come after what a stream has, as for ``observe_state``: its last iteration is passed
        over, and an earlier one is an error that carries the rejected rows, before anything of the call is written. "pass"
        is for rows that may have been taken already: those up to the last are passed over. Executors write chunks under
        names of their own attempt; a failed or repeated task leaves only files that no descriptor names, and those are
        removed.
        """
        self._running()
        if late not in ("raise", "pass"):
            raise ValueError("late is raise or pass")
        ship(states.sparkSession)
        sampled = [stream_ops.sampled(states, s.interval, final=final) for s in self.streams]
        for s, own in zip(self.streams, sampled, strict=True):
            if late == "raise" and s.last is not None:
                least = own.agg(F.min("iteration")).first()[0]
                if least is not None and int(least) < s.last:
                    raise StorageError("out_of_order_iteration", f"{s.config['name']} has {s.last} already", previous=s.last, stream=s.config["name"], rejected=own.filter(F.col("iteration") < s.last))
        for s, own in zip(self.streams, sampled, strict=True):
            self._seal(s)
            due = own.filter(F.col("iteration") > (-1 if s.last is None else s.last))
            records = stream_ops.encoded(due, s.fields, kinds=kinds)
            large = stream_ops.oversized(records, s.queue).select("iteration", "bytes").head(1)
            if large:
                raise StorageError("record_too_large", f"a record of {large[0]['bytes']} bytes can't be queued in {s.queue}")
            chunked = chunk_ops.individual(records, []) if s.target is None else chunk_ops.rolled_over(records, [], s.target)
            folder, attempt, base = str(self.root / s.config["directory"]), uuid.uuid4().hex, len(s.config["chunks"])

            def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values("iteration")
                if not rows["iteration"].is_unique:
                    return pd.DataFrame([dict.fromkeys(("staged", "ordinal", "file", "records", "bytes", "checksum", "first_iteration", "last_iteration"), "")])
                data = ("\n".join(rows["line"]) + "\n").encode()
                name = f".{attempt}-{uuid.uuid4().hex}.tmp"  # noqa: B023
                write_synced(Path(folder) / name, data)  # noqa: B023
                own = descriptor(base + int(key[0]), data, [int(i) for i in rows["iteration"]])  # noqa: B023
                return pd.DataFrame([{"staged": name, **{k: str(v) for k, v in own.items()}}])

            found = chunked.groupBy("ordinal").applyInPandas(write, "staged string, ordinal string, file string, records string, bytes string, checksum string, first_iteration string, last_iteration string").collect()
            if any(not row["staged"] for row in found):
                for left in Path(folder).glob(f".{attempt}-*.tmp"):
                    left.unlink()
                raise StorageError("out_of_order_iteration", f"an iteration of {s.config['name']} comes twice", stream=s.config["name"])
            for row in sorted(found, key=lambda r: int(r["ordinal"])):
                own = {k: row[k] if k in ("file", "checksum") else int(row[k]) for k in ("ordinal", "file", "records", "bytes", "checksum", "first_iteration", "last_iteration")}
                os.rename(Path(folder) / row["staged"], Path(folder) / (own["file"] + ".tmp"))
                s.config["chunks"].append(own)
                s.last = own["last_iteration"]
            if found:
                sync_folder(Path(folder))
                self.commit()
                for row in found:
                    os.rename(Path(folder) / (row["file"] + ".tmp"), Path(folder) / row["file"])
                sync_folder(Path(folder))
            for left in Path(folder).glob(f".{attempt}-*.tmp"):
                left.unlink()

    def _end(self, status: dict[str, Any], terminal: dict[str, Any] | None) -> list[dict[str, Any]]:
        self._running()
        for s in self.streams:
            self._seal(s)
        timing = self.document["timing"]
        timing["finalized_at_utc"] = utc_now()
        timing["active_duration_ns"] += time.monotonic_ns() - self.began
        self.document |= {"status": status, "terminal_metadata": dict(terminal or {})}
        self.commit()
        self.close()
        return summaries(self.document)

    def complete(self, terminal_metadata: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        return self._end({"state": "complete"}, terminal_metadata)

    def complete_with_final_state(self, state: State, terminal_metadata: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """Every stream has the final state once, whatever its interval."""
        self._running()
        for s in self.streams:
            self._append(s, state)
        return self.complete(terminal_metadata)

    def fail(self, message: str, terminal_metadata: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        if not message.strip():
            raise StorageError("blank_failure", "a failure needs a message")
        return self._end({"state": "failed", "message": message}, terminal_metadata)


def newest_checkpoint(document: dict[str, Any], schema: StateSchema, stream: str | None = None) -> dict[str, Any]:
    """The stream of whole states (of that name, if one is given) that came furthest, the last declared on ties."""
    whole = [(f.name, f.description) for f in schema.fields]
    good = [s for s in document["streams"] if [(f["name"], f.get("description")) for f in s["fields"]] == whole and s["chunks"] and stream in (None, s["name"])]
    if not good:
        raise StorageError("no_checkpoint", "no stream holds complete states")
    return max(enumerate(good), key=lambda x: (x[1]["chunks"][-1]["last_iteration"], x[0]))[1]


def summaries(document: dict[str, Any]) -> list[dict[str, Any]]:
    """Per stream, in order of declaration: chunk_count, records, bytes, first_iteration, last_iteration."""
    out = []
    for s in document["streams"]:
        c = s["chunks"]
        records, size = sum(x["records"] for x in c), sum(x["bytes"] for x in c)
        if max(records, size) > metadata.U64_MAX:
            raise StorageError("summary_overflow", f"sums of {s['name']} are too large")
        out.append({"stream": s["name"], "chunk_count": len(c), "records": records, "bytes": size, "first_iteration": c[0]["first_iteration"] if c else None, "last_iteration": c[-1]["last_iteration"] if c else None})
    return out


def _matches(path: Path, own: dict[str, Any]) -> bool:
    if not path.exists():
        return False
    data = path.read_bytes()
    return len(data) == own["bytes"] and "sha256:" + hashlib.sha256(data).hexdigest() == own["checksum"]


def reconcile(root: Path, document: dict[str, Any]) -> None:
    """Bring the files to what the metadata says: staged or sealed files beyond it go, a described chunk that wasn't yet
    renamed is, and files of other names are a conflict."""
    for s in document["streams"]:
        folder = root / s["directory"]
        known = {c["file"]: c for c in s["chunks"]}
        beyond = []
        for path in sorted(folder.iterdir()):
            base = path.name.removesuffix(".tmp")
            if path.name.startswith(".") and path.name.endswith(".tmp") or base not in known and base.startswith("chunk-") and base.endswith(".jsonl"):
                beyond.append(path)
            elif base not in known:
                raise StorageError("foreign_file", f"{path} belongs to no chunk")
        if len([p for p in beyond if p.name.startswith("chunk-") and p.name.endswith(".tmp")]) > 1:
            raise StorageError("several_open_chunks", f"{s['name']} has several open chunks")
        for path in beyond:
            path.unlink()
        for name, own in known.items():
            sealed, staged = folder / name, folder / (name + ".tmp")
            if not staged.exists():
                continue
            if _matches(sealed, own):
                staged.unlink()
            elif _matches(staged, own):
                os.replace(staged, sealed)
            else:
                raise StorageError("chunk_conflict", f"neither file of {name} is what its descriptor says")
        sync_folder(folder)


def rewind(root: Path, document: dict[str, Any], checkpoint: int, commit) -> None:
    """Drop every record after ``checkpoint``: only the chunk across it is opened, verified and cut to its first lines."""
    staged: list[tuple[Path, Path]] = []
    gone: list[Path] = []
    for s in document["streams"]:
        folder = root / s["directory"]
        kept = []
        for c in s["chunks"]:
            if c["last_iteration"] <= checkpoint:
                kept.append(c)
                continue
            gone.append(folder / c["file"])
            if c["first_iteration"] > checkpoint:
                continue
            data = verified_bytes(folder / c["file"], c["bytes"], c["checksum"])
            lines = [x for x in checked_lines(data, c["records"], c["first_iteration"], c["last_iteration"], len(s["fields"])) if x[0] <= checkpoint]
            if not lines:
                raise RecordError("rewind", "the chunk has no record up to the checkpoint")
            data = "".join(line + "\n" for _, line in lines).encode()
            kept.append(descriptor(c["ordinal"], data, [i for i, _ in lines]))
            write_synced(folder / (c["file"] + ".tmp"), data)
            staged.append((folder / (c["file"] + ".tmp"), folder / c["file"]))
        s["chunks"] = kept
    commit()
    for a, b in staged:
        os.replace(a, b)
        gone.remove(b)
    for path in gone:
        path.unlink(missing_ok=True)
