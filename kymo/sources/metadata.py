"""The metadata document of a recording: rules of the format, and the document as small tables.

The format's name is a parameter of those who exchange recordings with other programs; its version is fixed.
"""

from __future__ import annotations

import re
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kymo.errors import MetadataError, RecordingNotCompleteError
from kymo.functions.strict_json import parse_strict

FORMAT = "kymo-recording-jsonl"
VERSION = 7
FILE = "metadata.json"
U64_MAX = 2**64 - 1

_UTC = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z")
_SUM = re.compile(r"sha256:[0-9a-f]{64}")


def _fail(message: str, code: str = "invalid_metadata") -> None:
    raise MetadataError(code, message)


def _keys(value: Any, needed: str, allowed: str = "", where: str = "metadata") -> dict[str, Any]:
    if not isinstance(value, dict):
        _fail(f"{where} must be an object")
    need = set(needed.split())
    if not need <= set(value) <= need | set(allowed.split()):
        _fail(f"{where} has keys {sorted(value)}")
    return value


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        _fail(f"{where} must be a non-blank string")
    return value


def _count(value: Any, where: str, least: int = 0) -> int:
    if type(value) is not int or not least <= value <= U64_MAX:
        _fail(f"{where} must be a whole number from {least}")
    return value


def safe_relative(value: Any, where: str) -> str:
    if any(part in ("", ".", "..") for part in re.split(r"[/\\]", _text(value, where))) or re.match(r"[A-Za-z]:", value):
        _fail(f"{where} must be a safe relative path", "unsafe_path")
    return value


def _moment(value: Any, where: str) -> None:
    good = _UTC.fullmatch(_text(value, where))
    try:
        good = good and datetime.fromisoformat(value[:19])
    except ValueError:
        good = None
    if not good:
        _fail(f"{where} must be a UTC time")


def chunk_name(ordinal: int) -> str:
    return f"chunk-{ordinal:06d}.jsonl"


def validated(document: Any, format_name: str | None = None) -> dict[str, Any]:
    """The document with its optional parts filled in. ``format_name``: the one to insist on; any name otherwise."""
    top = dict(_keys(document, "format version status timing records time streams", "user_metadata terminal_metadata"))
    if _text(top["format"], "format") != (format_name or top["format"]):
        _fail(f"format must be {format_name}", "wrong_format")
    if _count(top["version"], "version") != VERSION:
        _fail(f"version {top['version']} isn't supported; {VERSION} is", "unsupported_version")
    state = top["status"].get("state") if isinstance(top["status"], dict) else None
    if state not in ("running", "complete", "failed"):
        _fail(f"unknown status {state!r}")
    _keys(top["status"], "state message" if state == "failed" else "state", where="status")
    if state == "failed":
        _text(top["status"]["message"], "status.message")
    if top["records"] != {"encoding": "json", "framing": "json_lines"}:
        _fail("records must be json in json_lines")
    time = _keys(top["time"], "iteration_name", "iteration_unit physical_time_name physical_time_unit", "time")
    for key, value in time.items():
        if value is not None or key == "iteration_name":
            _text(value, f"time.{key}")
    if time.get("physical_time_unit") is not None and time.get("physical_time_name") is None:
        _fail("a unit of physical time needs its name")
    timing = _keys(top["timing"], "created_at_utc active_duration_ns continuation_count", "finalized_at_utc", "timing")
    _moment(timing["created_at_utc"], "timing.created_at_utc")
    ended = timing.get("finalized_at_utc")
    if ended is not None:
        _moment(ended, "timing.finalized_at_utc")
    if (ended is None) != (state == "running"):
        _fail("exactly terminal recordings have finalized_at_utc")
    _count(timing["active_duration_ns"], "timing.active_duration_ns")
    _count(timing["continuation_count"], "timing.continuation_count")
    for key in ("user_metadata", "terminal_metadata"):
        if not isinstance(top.setdefault(key, {}), dict):
            _fail(f"{key} must be an object")
    if state == "running" and top["terminal_metadata"]:
        _fail("a running recording has no terminal_metadata")
    if not isinstance(top["streams"], list) or not top["streams"]:
        _fail("there must be streams")
    top["streams"] = [_stream(s) for s in top["streams"]]
    for what in ("name", "directory"):
        seen = [s[what] for s in top["streams"]]
        if len(set(seen)) != len(seen):
            _fail(f"a stream's {what} is repeated", f"duplicate_stream_{what}")
    return top


def _stream(value: Any) -> dict[str, Any]:
    own = dict(_keys(value, "name directory sampling_interval fields storage", "chunks", "stream"))
    name = _text(own["name"], "stream name")
    safe_relative(own["directory"], f"directory of {name}")
    if type(own["sampling_interval"]) is int:  # read; the tagged form is written
        own["sampling_interval"] = {"iterations": own["sampling_interval"]}
    _count(_keys(own["sampling_interval"], "iterations", where=f"interval of {name}")["iterations"], f"interval of {name}", 1)
    storage = _keys(own["storage"], "layout storage_queue_bytes", where=f"storage of {name}")
    _count(storage["storage_queue_bytes"], f"queue of {name}", 1)
    kind = storage["layout"].get("kind") if isinstance(storage["layout"], dict) else None
    if kind == "chunked":
        _count(_keys(storage["layout"], "kind target_bytes", where=f"layout of {name}")["target_bytes"], f"target of {name}", 1)
    elif kind != "individual_files" or set(storage["layout"]) != {"kind"}:
        _fail(f"unknown layout of {name}")
    names = []
    if not isinstance(own["fields"], list):
        _fail(f"fields of {name} must be a list")
    for f in own["fields"]:
        names.append(_text(_keys(f, "name", "description", f"field of {name}")["name"], f"field of {name}"))
        if f.get("description") is not None:
            _text(f["description"], f"description in {name}")
    if len(set(names)) != len(names):
        _fail(f"{name} repeats a field")
    own["chunks"] = own.get("chunks") or []
    last = -1
    for k, chunk in enumerate(own["chunks"]):
        c = _keys(chunk, "ordinal file records bytes checksum first_iteration last_iteration", where=f"chunk {k} of {name}")
        if c["ordinal"] != k or type(c["ordinal"]) is not int:
            _fail(f"chunk ordinals of {name} have a gap", "chunk_ordinal")
        if c["file"] != chunk_name(k):
            _fail(f"chunk {k} of {name} must be {chunk_name(k)}", "chunk_file")
        if _count(c["records"], "records", 1) != 1 and kind == "individual_files":
            _fail(f"chunk {k} of {name} must hold one record")
        _count(c["bytes"], "bytes", 1)
        first, end = _count(c["first_iteration"], "first_iteration"), _count(c["last_iteration"], "last_iteration")
        if first > end or first <= last:
            _fail(f"iterations of {name}'s chunks are out of order", "chunk_range")
        last = end
        if not isinstance(c["checksum"], str) or not _SUM.fullmatch(c["checksum"]):
            _fail(f"chunk {k} of {name} has no valid checksum")
    return own


def read(root: str | Path, format_name: str | None = None) -> dict[str, Any]:
    path = Path(root) / FILE
    try:
        data = path.read_bytes()
    except OSError as e:
        raise MetadataError("unreadable_metadata", f"{path}: {e}") from e
    return validated(parse_strict(data, MetadataError, str(path)), format_name)


def complete(root: str | Path, format_name: str | None = None) -> dict[str, Any]:
    found = read(root, format_name)
    if found["status"]["state"] != "complete":
        raise RecordingNotCompleteError("not_complete", f"the recording at {root} is {found['status']['state']}")
    return found


CHUNKS = "stream string, ordinal bigint, file string, records bigint, bytes bigint, checksum string, first_iteration decimal(20,0), last_iteration decimal(20,0)"
STREAMS = "stream string, directory string, interval bigint, fields array<struct<name:string,description:string>>, layout string, target_bytes bigint, storage_queue_bytes bigint"


def chunk_rows(document: dict[str, Any]) -> list[tuple]:
    from decimal import Decimal

    return [
        (s["name"], c["ordinal"], f"{s['directory']}/{c['file']}", c["records"], c["bytes"], c["checksum"], Decimal(c["first_iteration"]), Decimal(c["last_iteration"]))
        for s in document["streams"]
        for c in s["chunks"]
    ]


def chunk_catalog(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    """Descriptors of all chunks; counts, bytes and ranges come from here without opening a chunk."""
    return spark.createDataFrame(chunk_rows(document), CHUNKS)


def stream_catalog(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    rows = [
        (s["name"], s["directory"], s["sampling_interval"]["iterations"], [(f["name"], f.get("description")) for f in s["fields"]], s["storage"]["layout"]["kind"], s["storage"]["layout"].get("target_bytes"), s["storage"]["storage_queue_bytes"])
        for s in document["streams"]
    ]
    return spark.createDataFrame(rows, STREAMS)
