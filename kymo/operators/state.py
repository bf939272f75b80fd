"""Rows: a schema of named fields, and states as driver objects or DataFrame columns.

Field types aren't in the schema. The first value put into a field binds its type; it stays when the value goes and in
blank siblings of the state.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.errors import PayloadInsertError, StateError
from kymo.functions.columns import U64_MAX, advanced_iteration, advanced_time
from kymo.functions.strict_json import parse_strict, pretty


@dataclass(frozen=True)
class Field:
    name: str
    description: str | None = None


class StateSchema:
    """Ordered fields with trimmed, unique, non-empty names; no fields at all is legal."""

    def __init__(self, fields: list[Field]):
        cleaned = [Field(f.name.strip(), f.description) for f in fields]
        names = [f.name for f in cleaned]
        if any(not n for n in names):
            raise StateError("blank_field", "a field name is blank")
        if len(set(names)) != len(names):
            raise StateError("duplicate_field", "a field name is repeated")
        self.fields = tuple(cleaned)

    @classmethod
    def load(cls, data: bytes | str) -> StateSchema:
        top = parse_strict(data, StateError, "state schema")
        if not isinstance(top, dict) or set(top) != {"fields"} or not isinstance(top["fields"], list):
            raise StateError("invalid_schema", "a state schema is an object of fields")
        found = []
        for f in top["fields"]:
            if not isinstance(f, dict) or not {"name"} <= set(f) <= {"name", "description"} or not isinstance(f["name"], str) or not isinstance(f.get("description"), str | None):
                raise StateError("invalid_schema", f"{f!r} is no field")
            found.append(Field(f["name"], f.get("description")))
        return cls(found)

    def to_json_template(self) -> bytes:
        return pretty({"fields": [{"name": f.name} | ({"description": f.description} if f.description is not None else {}) for f in self.fields]})

    @classmethod
    def of(cls, df: DataFrame) -> StateSchema:
        return cls([Field(f.name, f.metadata.get("comment")) for f in df.schema if f.name not in ("iteration", "physical_time")])

    def struct(self, kinds: dict[str, str] | None = None) -> T.StructType:
        """The DataFrame schema of states: ``kinds`` has DDL types by field, ``string`` (JSON text) where it has none."""
        out = T.StructType([T.StructField("iteration", T.DecimalType(20, 0), False), T.StructField("physical_time", T.DoubleType())])
        for f in self.fields:
            kind = T._parse_datatype_string((kinds or {}).get(f.name, "string"))
            out.add(T.StructField(f.name, kind, True, {"comment": f.description} if f.description else {}))
        return out

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __len__(self) -> int:
        return len(self.fields)

    def __contains__(self, name: str) -> bool:
        return name.strip() in self.names()

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name.strip():
                return f
        raise StateError("unknown_field", f"no field {name!r}", field=name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, StateSchema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def create_empty_state(self) -> State:
        return State(self)


def checked_time(value: float | None) -> float | None:
    if value is not None and not math.isfinite(value):
        raise StateError("non_finite_physical_time", f"physical time {value} isn't finite")
    return value


class State:
    """One row being worked on by the application."""

    def __init__(self, schema: StateSchema, iteration: int = 0, physical_time: float | None = None):
        self.schema = schema
        self._values: dict[str, Any] = {}
        self._types: dict[str, type] = {}
        self.replace_simulation_time(iteration, physical_time)

    def replace_simulation_time(self, iteration: int, physical_time: float | None = None) -> None:
        if not 0 <= iteration <= U64_MAX:
            raise StateError("iteration_range", f"iteration {iteration} is no unsigned 64-bit number")
        self.physical_time, self.iteration = checked_time(physical_time), iteration

    def advance_simulation_time(self, delta: float | None = None) -> None:
        """One iteration on; on an error the state stays as it is."""
        if self.iteration == U64_MAX:
            raise StateError("iteration_overflow", "no iteration follows")
        time = self.physical_time
        if delta is not None:
            if time is None:
                raise StateError("missing_physical_time", "there is no physical time to advance")
            if not math.isfinite(delta) or not math.isfinite(time + delta):
                raise StateError("non_finite_physical_time", "the advanced time isn't finite")
            time += delta
        self.iteration, self.physical_time = self.iteration + 1, time

    def insert_payload(self, name: str, value: Any) -> Any:
        """Set or replace; the displaced value. A value of another type than the field's is handed back in the error."""
        name = self.schema.field(name).name
        bound = self._types.get(name)
        if bound is not None and type(value) is not bound:
            raise PayloadInsertError("type_mismatch", f"{name} holds {bound.__name__}, not {type(value).__name__}", value, field=name)
        self._types[name] = type(value)
        old = self._values.get(name)
        self._values[name] = value
        return old

    def payload(self, name: str, kind: type | None = None) -> Any:
        name = self.schema.field(name).name
        if kind is not None and name in self._types and self._types[name] is not kind:
            raise StateError("type_mismatch", f"{name} holds {self._types[name].__name__}, not {kind.__name__}", field=name)
        if name not in self._values:
            raise StateError("missing_payload", f"{name} is empty", field=name)
        return self._values[name]

    def payloads(self, *wanted: tuple[str, type]) -> tuple[Any, ...]:
        """Several fields at once; a repeated one is an error, and all are checked before any is given."""
        names = [self.schema.field(n).name for n, _ in wanted]
        if len(set(names)) != len(names):
            raise StateError("repeated_field", "a field is asked for twice")
        return tuple(self.payload(n, t) for n, t in wanted)

    def payload_has_type(self, name: str, kind: type) -> bool:
        return self._types.get(self.schema.field(name).name) is kind

    def contains_payload(self, name: str) -> bool:
        return self.schema.field(name).name in self._values

    def take_payload(self, name: str) -> Any:
        value = self.payload(name)
        del self._values[self.schema.field(name).name]
        return value

    def clear_payload(self, name: str) -> bool:
        return self._values.pop(self.schema.field(name).name, _NOTHING) is not _NOTHING

    def clear_all_payloads(self) -> None:
        self._values.clear()

    def clone(self) -> State:
        out = self.clone_structure_without_payloads()
        out._values = copy.deepcopy(self._values)
        return out

    def clone_structure_without_payloads(self) -> State:
        out = State(self.schema, self.iteration, self.physical_time)
        out._types = dict(self._types)
        return out

    @property
    def declared_field_count(self) -> int:
        return len(self.schema)

    @property
    def populated_field_count(self) -> int:
        return len(self._values)

    @property
    def has_no_payloads(self) -> bool:
        return not self._values

    @property
    def has_no_declared_fields(self) -> bool:
        return not len(self.schema)


_NOTHING = object()


def advance(df: DataFrame, delta: Column | None = None) -> DataFrame:
    """All rows one iteration on; an overflow or a time that can't advance fails the query."""
    return df.withColumns({"iteration": advanced_iteration(F.col("iteration")), "physical_time": advanced_time(F.col("physical_time"), delta)})


def put_payload(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a field in all rows; its type must be the one it has."""
    if name not in df.columns:
        raise StateError("unknown_field", f"no field {name!r}", field=name)
    out = df.withColumn(name, value)
    if out.schema[name].dataType != df.schema[name].dataType:
        raise PayloadInsertError("type_mismatch", f"{name} is {df.schema[name].dataType.simpleString()}", value, field=name)
    return out


def cleared(df: DataFrame, *names: str) -> DataFrame:
    """Fields emptied; their types stay."""
    return df.withColumns({n: F.lit(None).cast(df.schema[n].dataType) for n in names})


def populated(df: DataFrame) -> DataFrame:
    """``df`` with declared and populated, the counts of its fields and of those with a value."""
    names = [c for c in df.columns if c not in ("iteration", "physical_time")]
    count = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names), F.lit(0))
    return df.withColumns({"declared": F.lit(len(names)), "populated": count})
