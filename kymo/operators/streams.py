"""Streams: named projections of states, sampled by iteration, with the final state added on completion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.errors import StorageError
from kymo.functions.columns import due, json_text, record_line
from kymo.operators.series import latest_state
from kymo.operators.state import StateSchema


@dataclass(frozen=True)
class Storage:
    """``target_bytes`` of a chunk, None for a file per record; ``queue_bytes`` bounds one record's line."""

    target_bytes: int | None
    queue_bytes: int

    def to_json(self) -> dict[str, Any]:
        layout = {"kind": "individual_files"} if self.target_bytes is None else {"kind": "chunked", "target_bytes": self.target_bytes}
        return {"layout": layout, "storage_queue_bytes": self.queue_bytes}

    @classmethod
    def parse(cls, value: Any) -> Storage:
        if not isinstance(value, dict) or set(value) != {"layout", "storage_queue_bytes"} or not isinstance(value["layout"], dict):
            raise StorageError("invalid_stream_config", "storage has a layout and storage_queue_bytes")
        layout = value["layout"]
        if layout.get("kind") == "chunked" and set(layout) == {"kind", "target_bytes"}:
            out = cls(layout["target_bytes"], value["storage_queue_bytes"])
        elif layout == {"kind": "individual_files"}:
            out = cls(None, value["storage_queue_bytes"])
        else:
            raise StorageError("invalid_stream_config", "unknown storage layout")
        for n in (out.target_bytes, out.queue_bytes):
            if n is not None and (type(n) is not int or n < 1):
                raise StorageError("invalid_stream_config", "sizes are positive integers")
        return out


@dataclass(frozen=True)
class StreamConfig:
    name: str
    fields: tuple[str, ...]
    interval: int
    directory: str | None = None
    storage: Storage | None = None

    @classmethod
    def parse(cls, value: Any) -> StreamConfig:
        """A stream from JSON: ``sampling_interval`` is a number or {"iterations": number}; unknown keys are errors."""
        known = {"name", "fields", "sampling_interval", "directory", "storage"}
        if not isinstance(value, dict) or not {"name", "fields", "sampling_interval"} <= set(value) <= known:
            raise StorageError("invalid_stream_config", "a stream has name, fields and sampling_interval")
        interval = value["sampling_interval"]
        if isinstance(interval, dict) and set(interval) == {"iterations"}:
            interval = interval["iterations"]
        if type(interval) is not int or interval < 1:
            raise StorageError("invalid_interval", "a sampling interval is a positive integer")
        storage = Storage.parse(value["storage"]) if value.get("storage") is not None else None
        return cls(value["name"], tuple(value["fields"]), interval, value.get("directory"), storage)


def projected(schema: StateSchema, wanted: Sequence[str]) -> list[str]:
    """The wanted fields in the schema's order; unknown and repeated ones are errors."""
    names = [w.strip() for w in wanted]
    if len(set(names)) != len(names):
        raise StorageError("duplicate_stream_field", "a stream names a field twice")
    for n in names:
        if n not in schema:
            raise StorageError("unknown_stream_field", f"no field {n!r}", field=n)
    return [f.name for f in schema.fields if f.name in names]


def sampled(states: DataFrame, interval: int, keys: Sequence[str] = (), final: bool = False, iteration: str = "iteration") -> DataFrame:
    """Due rows; with ``final`` also the last row of each key, whatever the interval, and once.

    Due rows are a pushed-down filter; last rows are one aggregation, combined before its shuffle. So the states
    themselves are never shuffled or sorted as a whole, and a hot key is no hot task.
    """
    on = due(F.col(iteration), interval)
    if not final:
        return states.filter(on)
    last = latest_state(states, keys, iteration).filter(~on).select(*states.columns)
    return states.filter(on).unionByName(last.filter(F.col(iteration).isNotNull()))


def encoded(states: DataFrame, fields: Sequence[str], keys: Sequence[str] = (), kinds: dict[str, str] | None = None) -> DataFrame:
    """(keys, iteration, line, bytes): each row as its record line; ``bytes`` counts the line feed."""
    kind = lambda f: (kinds or {}).get(f) or states.schema[f].dataType.simpleString()
    time = F.col("physical_time") if "physical_time" in states.columns else None
    line = record_line(F.col("iteration"), time, [json_text(F.col(f"`{f}`"), kind(f)) for f in fields])
    return states.select(*keys, "iteration", line.alias("line")).withColumn("bytes", F.octet_length("line") + 1)


def oversized(records: DataFrame, limit: int) -> DataFrame:
    """Records whose line can't be queued."""
    return records.filter(F.col("bytes") > limit)
