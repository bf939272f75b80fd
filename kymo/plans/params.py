"""Parameter spaces: fixed leaves and a sweep, expanded into a table of task configurations.

The driver reads three small files. The table itself is ``spark.range`` with arithmetic on the ordinal, so that millions
of tasks cost neither a shuffle nor a list on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.errors import ConfigurationError
from kymo.functions.strict_json import compact, conflict, flatten, parse_strict, pointer_of, pointer_segments, pretty, rebuild, same_json
from kymo.shipping import ship

Path_ = tuple[str, ...]
U64 = 2**64


def _object(value: Any, where: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ConfigurationError("not_an_object", f"{where} must be an object")
    return value


@dataclass(frozen=True)
class Axis:
    """One dimension of a sweep: its candidates as leaves by path. All have the first one's paths, in its order."""

    key: str
    candidates: tuple[dict[Path_, Any], ...]
    values: tuple[Any, ...]

    @property
    def paths(self) -> tuple[Path_, ...]:
        return tuple(self.candidates[0])


def _axis(path: Path_, values: Any) -> Axis:
    key = pointer_of(path)
    if not isinstance(values, list) or not values:
        raise ConfigurationError("empty_axis", f"axis {key} needs a non-empty list of values", axis=key)
    found = []
    for value in values:
        leaves = {(*path, *p): v for p, v in flatten(value).items()} if isinstance(value, dict) and value else {path: value}
        if found and leaves.keys() != found[0].keys():
            raise ConfigurationError("inconsistent_candidates", f"candidates of {key} have different keys", axis=key)
        found.append({p: leaves[p] for p in (found[0] if found else leaves)})
    return Axis(key, tuple(found), tuple(values))


def _axes(node: dict[str, Any], path: Path_ = ()) -> Iterator[Axis]:
    for name, value in node.items():
        if not name.strip():
            raise ConfigurationError("blank_segment", "a sweep path has a blank segment")
        inner = _object(value, f"axis {pointer_of((*path, name))}")
        if not inner:
            raise ConfigurationError("empty_axis", f"axis {pointer_of((*path, name))} is empty")
        if "values" in inner:
            if len(inner) > 1:
                raise ConfigurationError("unknown_key", f"axis {pointer_of((*path, name))} has more than values")
            yield _axis((*path, name), inner["values"])
        else:
            yield from _axes(inner, (*path, name))


@dataclass(frozen=True)
class Sweep:
    """``axes`` in declaration order, the last fastest; correlated cases are one axis whose leaves have keys of their own."""

    axes: tuple[Axis, ...]
    cases: bool = False

    @classmethod
    def parse(cls, document: Any) -> Sweep:
        top = _object(document, "sweep")
        if set(top) == {"mode", "axes"} and top["mode"] == "cartesian":
            axes = tuple(_axes(_object(top["axes"], "axes")))
            for i, a in enumerate(axes):
                for b in axes[i + 1 :]:
                    if any(conflict(p, q) for p in a.paths for q in b.paths):
                        raise ConfigurationError("axis_overlap", f"axes {a.key} and {b.key} set the same parameter")
            found = cls(axes)
        elif set(top) == {"mode", "cases"} and top["mode"] == "cases":
            cases = top["cases"]
            if not isinstance(cases, list) or not cases:
                raise ConfigurationError("empty_cases", "cases must be a non-empty list")
            leaves = [flatten(_object(c, "case")) for c in cases]
            if any(x.keys() != leaves[0].keys() for x in leaves):
                raise ConfigurationError("inconsistent_cases", "cases have different keys")
            found = cls((Axis("", tuple({p: x[p] for p in leaves[0]} for x in leaves), tuple(cases)),), cases=True)
        else:
            raise ConfigurationError("invalid_sweep", "a sweep has mode and axes, or mode and cases, and nothing else")
        if found.task_count >= U64:
            raise ConfigurationError("task_count_overflow", "too many tasks")
        return found

    @property
    def task_count(self) -> int:
        n = 1
        for a in self.axes:
            n *= len(a.candidates)
        return n

    @property
    def keys(self) -> tuple[str, ...]:
        """What a match may name: axes, or a case's leaves."""
        return tuple(pointer_of(p) for p in self.axes[0].paths) if self.cases else tuple(a.key for a in self.axes)

    def strides(self) -> list[int]:
        out, n = [], 1
        for a in reversed(self.axes):
            out.append(n)
            n *= len(a.candidates)
        return out[::-1]


@dataclass(frozen=True)
class Task:
    """One configuration: its ordinal and leaves, the fixed ones first."""

    ordinal: int
    leaves: dict[Path_, Any]
    paths: ProjectPaths | None = None

    def _find(self, key: str) -> tuple[bool, Any]:
        path = pointer_segments(key)
        if path is None:
            return False, None
        if path in self.leaves:
            return True, self.leaves[path]
        below = {p[len(path) :]: v for p, v in self.leaves.items() if p[: len(path)] == path}
        return bool(below), rebuild(below)

    def contains(self, key: str) -> bool:
        return self._find(key)[0]

    def value(self, key: str) -> Any:
        """A leaf, or the rebuilt document below a path; None where there is none."""
        return self._find(key)[1]

    def require_value(self, key: str) -> Any:
        there, value = self._find(key)
        if not there:
            raise ConfigurationError("missing_parameter", f"no parameter {key}", key=key)
        return value

    def decode_value(self, key: str, kind: type) -> Any:
        """The value if it is of the Python type; integers count as floats, booleans never as numbers."""
        value = self.require_value(key)
        if kind is float and type(value) is int:
            return float(value)
        if type(value) is not kind:
            raise ConfigurationError("wrong_type", f"{key} is {type(value).__name__}, not {kind.__name__}", key=key)
        return value

    def decode_values(self, *wanted: tuple[str, type]) -> tuple[Any, ...]:
        return tuple(self.decode_value(k, t) for k, t in wanted)

    def keys(self) -> list[str]:
        return [pointer_of(p) for p in self.leaves]

    def items(self) -> list[tuple[str, Any]]:
        return [(pointer_of(p), v) for p, v in self.leaves.items()]

    def __len__(self) -> int:
        return len(self.leaves)

    def to_json(self) -> dict[str, Any]:
        return rebuild(self.leaves)

    def resolved_json(self) -> dict[str, Any]:
        return {"parameters": self.to_json(), "paths": dict(self.paths.entries) if self.paths else {}}

    def write_resolved_json(self, path: str | os.PathLike) -> None:
        """Write once; the same bytes again are fine, others are a conflict."""
        data, to = pretty(self.resolved_json()), Path(path)
        try:
            with to.open("xb") as f:
                f.write(data)
        except FileExistsError:
            if to.read_bytes() != data:
                raise ConfigurationError("export_conflict", f"{to} holds another configuration") from None


@dataclass(frozen=True)
class ProjectPaths:
    """Names to paths, in order; relative ones count from ``root``. Nothing is looked up on disk."""

    root: Path
    entries: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, document: Any, root: Path) -> ProjectPaths:
        for key, value in _object(document, "paths").items():
            if not key.strip() or not isinstance(value, str) or not value.strip():
                raise ConfigurationError("invalid_path", f"path {key!r} must be a non-blank string")
        return cls(root, dict(document))

    def path(self, key: str) -> str | None:
        return self.entries.get(key)

    def require_path(self, key: str) -> str:
        if key not in self.entries:
            raise ConfigurationError("missing_path", f"no path {key}", key=key)
        return self.entries[key]

    def resolve_path(self, key: str) -> Path:
        return Path(os.path.normpath(self.root / self.require_path(key)))

    def keys(self) -> list[str]:
        return list(self.entries)


class ParameterSpace:
    """Fixed leaves and a sweep that never set the same parameter."""

    def __init__(self, fixed: dict[str, Any], sweep: Sweep, paths: ProjectPaths | None = None):
        self.fixed, self.sweep, self.paths = flatten(_object(fixed, "fixed")), sweep, paths
        for p in self.fixed:
            if any(not part.strip() for part in p):
                raise ConfigurationError("blank_segment", "a fixed parameter has a blank name")
            for a in sweep.axes:
                if any(conflict(p, q) for q in a.paths):
                    raise ConfigurationError("fixed_sweep_overlap", f"{pointer_of(p)} is both fixed and swept")

    @classmethod
    def load(cls, root: str | os.PathLike) -> ParameterSpace:
        """``config/fixed.json``, ``config/sweep.json``, then ``config/paths.json`` below ``root``; the first error wins."""
        root = Path(root)

        def read(name: str) -> Any:
            try:
                data = (root / "config" / name).read_bytes()
            except OSError as e:
                raise ConfigurationError("unreadable", f"{name}: {e}") from e
            return parse_strict(data, where=name)

        space = cls(read("fixed.json"), Sweep.parse(read("sweep.json")))
        space.paths = ProjectPaths.parse(read("paths.json"), root)
        return space

    @staticmethod
    def write_source_config(root: str | os.PathLike, to: str | os.PathLike) -> None:
        """Byte-exact copies of the three files; never over the project's own folder, never over other bytes."""
        source, target = (Path(root) / "config").resolve(), Path(to).resolve()
        if source == target:
            raise ConfigurationError("export_conflict", "the copy would replace the project's config")
        target.mkdir(parents=True, exist_ok=True)
        for name in ("fixed.json", "sweep.json", "paths.json"):
            data = (source / name).read_bytes()
            if (target / name).exists() and (target / name).read_bytes() != data:
                raise ConfigurationError("export_conflict", f"{name} holds other bytes")
            (target / name).write_bytes(data)

    @property
    def task_count(self) -> int:
        return self.sweep.task_count

    def fixed_keys(self) -> list[str]:
        return [pointer_of(p) for p in self.fixed]

    def sweep_keys(self) -> list[str]:
        return list(self.sweep.keys)

    def facts(self) -> dict[str, int]:
        n, m = len(self.fixed), len(self.sweep.keys)
        return {"fixed_parameter_count": n, "sweep_parameter_count": m, "parameter_count": n + m, "task_count": self.task_count}

    def contains_parameter(self, key: str) -> bool:
        return self.task(0).contains(key)

    def task(self, ordinal: int) -> Task:
        if not 0 <= ordinal < self.task_count:
            raise ConfigurationError("ordinal_out_of_range", f"ordinal {ordinal} of {self.task_count} tasks", count=self.task_count)
        leaves = dict(self.fixed)
        for axis, stride in zip(self.sweep.axes, self.sweep.strides(), strict=True):
            leaves |= axis.candidates[ordinal // stride % len(axis.candidates)]
        return Task(ordinal, leaves, self.paths)

    def tasks(self) -> Iterator[Task]:
        return map(self.task, range(self.task_count))

    def _axis_of(self, key: str) -> tuple[Axis, int, list[Any]]:
        if key not in self.sweep.keys:
            raise ConfigurationError("not_selectable", f"{key} is no key of the sweep", key=key)
        if self.sweep.cases:
            axis = self.sweep.axes[0]
            return axis, 1, [c[pointer_segments(key)] for c in axis.candidates]
        k = self.sweep.keys.index(key)
        return self.sweep.axes[k], self.sweep.strides()[k], list(self.sweep.axes[k].values)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per task: ordinal, a column per leaf (its pointer, as JSON text) and ``document`` (the whole, as JSON)."""
        n = self.task_count
        if n > 2**63 - 1:
            raise ConfigurationError("task_count_overflow", "more tasks than a range holds")
        base = spark.range(n).withColumnRenamed("id", "ordinal")
        columns = {p: F.lit(compact(v)) for p, v in self.fixed.items()}
        for axis, stride in zip(self.sweep.axes, self.sweep.strides(), strict=True):
            place = F.expr(f"(ordinal div {stride}) % {len(axis.candidates)}")
            for p in axis.paths:
                columns[p] = F.element_at(F.array(*(F.lit(compact(c[p])) for c in axis.candidates)), place.cast("int") + 1)
        flat = base.select("ordinal", *(c.alias(pointer_of(p)) for p, c in columns.items()))
        return flat.withColumn("document", _document(rebuild({p: F.col(f"`{pointer_of(p)}`") for p in columns})))

    def leaves(self, spark: SparkSession) -> DataFrame:
        """(ordinal, pos, pointer, value): the long form."""
        frame = self.frame(spark)
        names = [c for c in frame.columns if c not in ("ordinal", "document")]
        rows = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(c).alias("pointer"), F.col(f"`{c}`").alias("value")) for k, c in enumerate(names)))
        return frame.select("ordinal", F.inline(rows))

    def matching(self, spark: SparkSession, key: str, value: Any) -> DataFrame:
        """Tasks whose sweep value equals ``value`` as JSON: 300 and 300.0 differ. Other axes are free."""
        axis, stride, values = self._axis_of(key)
        good = [k for k, v in enumerate(values) if same_json(v, value)]
        place = F.expr(f"(ordinal div {stride}) % {len(axis.candidates)}")
        return self.frame(spark).filter(place.isin(good) if good else F.lit(False))

    def unique_matching(self, key: str, value: Any) -> Task:
        axis, stride, values = self._axis_of(key)
        good = {k for k, v in enumerate(values) if same_json(v, value)}
        found = len(good) * (self.task_count // len(axis.candidates))
        if found != 1:
            code = "ambiguous_match" if found else "no_match"
            raise ConfigurationError(code, f"{found} tasks have {key} = {compact(value)}", count=found)
        return self.task(next(iter(good)) * stride)


def document_leaves(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, pointer, value): the leaves of a JSON document in each row, by the rules of parameter files. Values are JSON
    text, but strings are themselves; a document that breaks the rules fails the query, a null one has no leaves."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pointers, values = [], [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                for path, value in flatten(_object(parse_strict(text.as_py()), column)).items() if text.is_valid else ():
                    rows.append(k)
                    pointers.append(pointer_of(path))
                    values.append(value if isinstance(value, str) else compact(value))
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pointers, pa.string()), pa.array(values, pa.string())], names=[*keys, "pointer", "value"])

    kinds = "".join(f"`{k}` {documents.schema[k].dataType.simpleString()}, " for k in keys)
    return documents.select(*keys, column).mapInArrow(run, kinds + "pointer string, value string")


def _document(node: dict[str, Any]) -> Column:
    """JSON text of a nested document whose leaves are columns of JSON text."""
    parts: list[Column] = [F.lit("{")]
    for k, (name, value) in enumerate(node.items()):
        parts += [F.lit(("," if k else "") + compact(name) + ":"), _document(value) if isinstance(value, dict) else value]
    return F.concat(*parts, F.lit("}"))
