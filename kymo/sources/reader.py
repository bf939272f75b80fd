"""Verified reads of recordings: chunks are checked whole before any record of theirs is decoded.

``RecordingReader.lines`` is a Python data source with one partition per chunk, which prunes chunks by bounds on
``iteration`` from their descriptors. Decoding runs in the JVM, and fields that a query doesn't use aren't decoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kymo.errors import DecoderError, IntegrityError, RecordError, RecordingError, UnknownStreamError
from kymo.functions.strict_json import parse_strict
from kymo.operators.state import Field, StateSchema
from kymo.shipping import ship
from kymo.sources import metadata

LINES = "stream string, ordinal bigint, pos bigint, iteration decimal(20,0), line string"
Decoders = dict[str, Callable[[Any], Any]] | list[tuple[str, Callable[[Any], Any]]]


def verified_bytes(path: str | Path, size: int, checksum: str) -> bytes:
    """The chunk's bytes once size, checksum and framing are right."""
    try:
        data = Path(path).read_bytes()
    except OSError as e:
        raise IntegrityError("missing_chunk", f"{path}: {e}") from e
    if len(data) != size:
        raise IntegrityError("size_mismatch", f"{path} has {len(data)} bytes, not {size}")
    if "sha256:" + hashlib.sha256(data).hexdigest() != checksum:
        raise IntegrityError("checksum_mismatch", f"{path} has another checksum")
    if not data.endswith(b"\n"):
        raise RecordError("unterminated_record", f"{path} doesn't end with a line feed")
    return data


def parsed_record(line: bytes | str, width: int) -> tuple[int, float | None, list[Any]]:
    """(iteration, physical time, values) of one line."""
    record = parse_strict(line, RecordError, "record")
    if not isinstance(record, dict) or not {"iteration", "values"} <= set(record) <= {"iteration", "values", "physical_time"}:
        raise RecordError("record_keys", "a record has iteration, values and perhaps physical_time")
    if type(record["iteration"]) is not int or not 0 <= record["iteration"] <= metadata.U64_MAX:
        raise RecordError("record_iteration", "an iteration is an unsigned 64-bit number")
    time = record.get("physical_time")
    if time is not None and (isinstance(time, bool) or not isinstance(time, int | float)):
        raise RecordError("record_time", "a physical time is a finite number")
    if not isinstance(record["values"], list) or len(record["values"]) != width:
        raise RecordError("record_width", f"a record has {width} values")
    return record["iteration"], None if time is None else float(time), record["values"]


def checked_lines(data: bytes, records: int, first: int, last: int, width: int) -> list[tuple[int, str]]:
    """(iteration, line) of a chunk's records, which rise strictly and are as many, from and to what the descriptor says."""
    out: list[tuple[int, str]] = []
    for line in data[:-1].split(b"\n"):
        if not line:
            raise RecordError("empty_record", "a chunk has an empty line")
        iteration = parsed_record(line, width)[0]
        if out and iteration <= out[-1][0]:
            raise RecordError("record_order", f"iteration {iteration} doesn't rise")
        out.append((iteration, line.decode()))
    if (len(out), out[0][0], out[-1][0]) != (records, first, last):
        raise IntegrityError("descriptor_mismatch", "records differ from the chunk's descriptor")
    return out


class _Chunk(InputPartition):
    def __init__(self, stream: str, ordinal: int, path: str, records: int, size: int, checksum: str, first: int, last: int, width: int):
        self.stream, self.ordinal, self.path, self.records, self.size, self.checksum, self.first, self.last, self.width = stream, ordinal, path, records, size, checksum, first, last, width


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        document = metadata.complete(options["path"], options.get("format"))
        wanted = options.get("stream")
        if wanted is not None and wanted not in [s["name"] for s in document["streams"]]:
            raise UnknownStreamError("unknown_stream", f"no stream {wanted!r}")
        self.chunks = [
            _Chunk(s["name"], c["ordinal"], f"{options['path']}/{s['directory']}/{c['file']}", c["records"], c["bytes"], c["checksum"], c["first_iteration"], c["last_iteration"], len(s["fields"]))
            for s in document["streams"]
            if wanted in (None, s["name"])
            for c in s["chunks"]
        ]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the iteration and values of the stream choose chunks; Spark still tests every row."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "iteration":
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.chunks = [c for c in self.chunks if c.last > f.value or c.last == f.value and not isinstance(f, GreaterThan)]
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.chunks = [c for c in self.chunks if c.first < f.value or c.first == f.value and not isinstance(f, LessThan)]
            elif name == "stream" and isinstance(f, EqualTo | In):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.chunks = [c for c in self.chunks if c.stream in values]
            yield f

    def partitions(self) -> list[_Chunk]:
        return self.chunks

    def read(self, partition: _Chunk | None) -> Iterator[pa.RecordBatch]:
        """The chunk as one Arrow batch: it is verified whole before any of its rows is given."""
        if partition is None:  # no chunk is left to read
            return
        data = verified_bytes(partition.path, partition.size, partition.checksum)
        lines = checked_lines(data, partition.records, partition.first, partition.last, partition.width)
        n = len(lines)
        columns = [pa.array([partition.stream] * n, pa.string()), pa.array([partition.ordinal] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([Decimal(i) for i, _ in lines], pa.decimal128(20, 0)), pa.array([x for _, x in lines], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["stream", "ordinal", "pos", "iteration", "line"])


class RecordingSource(DataSource):
    """``spark.read.format("kymo_recording").option("path", root)``; options ``stream`` and ``format``."""

    @classmethod
    def name(cls) -> str:
        return "kymo_recording"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader({k: v for k, v in self.options.items()} | {"path": self.options["path"]})


class RecordingReader:
    """One completed recording in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | Path, format_name: str | None = None):
        self.spark, self.root = spark, str(root)
        self.document = metadata.complete(root, format_name)
        self.format_name = format_name
        self._streams = {s["name"]: s for s in self.document["streams"]}

    def _stream(self, name: str) -> dict[str, Any]:
        if name not in self._streams:
            raise UnknownStreamError("unknown_stream", f"no stream {name!r}", stream=name)
        return self._streams[name]

    def stream_names(self) -> list[str]:
        return list(self._streams)

    @property
    def user_metadata(self) -> dict[str, Any]:
        return self.document["user_metadata"]

    @property
    def terminal_metadata(self) -> dict[str, Any]:
        return self.document["terminal_metadata"]

    @property
    def timing(self) -> dict[str, Any]:
        return self.document["timing"]

    @property
    def version(self) -> int:
        return self.document["version"]

    def stream_schema(self, name: str) -> StateSchema:
        return StateSchema([Field(f["name"], f.get("description")) for f in self._stream(name)["fields"]])

    def stream_record_count(self, name: str) -> int:
        return sum(c["records"] for c in self._stream(name)["chunks"])

    def stream_encoded_bytes(self, name: str) -> int:
        return sum(c["bytes"] for c in self._stream(name)["chunks"])

    def chunks(self) -> DataFrame:
        return metadata.chunk_catalog(self.spark, self.document)

    def streams(self) -> DataFrame:
        return metadata.stream_catalog(self.spark, self.document)

    def lines(self, stream: str | None = None) -> DataFrame:
        ship(self.spark)
        self.spark.dataSource.register(RecordingSource)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        source = self.spark.read.format("kymo_recording").option("path", self.root)
        if stream is not None:
            self._stream(stream)
            source = source.option("stream", stream)
        if self.format_name:
            source = source.option("format", self.format_name)
        return source.load()

    def _covered(self, name: str, decoders: dict[str, Any] | None) -> None:
        fields = self.stream_schema(name).names()
        for key in decoders or {}:
            if not key.strip():
                raise DecoderError("blank_decoder", "a decoder has a blank field")
        missing = [f for f in fields if decoders is not None and f not in decoders]
        if missing:
            raise DecoderError("missing_decoder", f"no decoder for {missing} of {name}", fields=missing)

    def read_stream(self, name: str, kinds: dict[str, str | Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
        """States of a stream: stream, ordinal, pos, iteration, physical_time and its fields. Where a field has one of these
        names, the column that isn't the field has underscores before its name, as many as it takes.

        ``kinds``: a DDL type for each field (or a pandas UDF from JSON text); without it fields are variants. Any fault in
        a chunk that the query needs fails the whole query.
        """
        fields = self.stream_schema(name).names()
        self._covered(name, kinds)
        return record_fields(self.lines(name).drop("iteration"), fields, kinds)

    def read_all_streams(self, kinds: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
        return {n: self.read_stream(n, (kinds or {}).get(n)) for n in self.stream_names()}

    def iterate(self, name: str, decoders: Decoders | None = None) -> Iterator[tuple[int, float | None, dict[str, Any]]]:
        """Rows one verified chunk after another, on the driver; ``decoders`` make a field's value of its JSON value."""
        stream, by_field = self._stream(name), self._decoders(name, decoders)
        for c in stream["chunks"]:
            yield from self._chunk_rows(stream, c, by_field)

    def latest_state(self, name: str, decoders: Decoders | None = None) -> tuple[int, float | None, dict[str, Any]] | None:
        """The last row; only the newest chunk is opened. None for a stream without records."""
        stream, by_field = self._stream(name), self._decoders(name, decoders)
        return list(self._chunk_rows(stream, stream["chunks"][-1], by_field))[-1] if stream["chunks"] else None

    def _decoders(self, name: str, decoders: Decoders | None) -> dict[str, Callable[[Any], Any]]:
        """By field; pairs may not name a field twice, and all fields are covered before any chunk is opened."""
        if decoders is None:
            return {}
        pairs = list(decoders.items() if isinstance(decoders, dict) else decoders)
        if len({f.strip() for f, _ in pairs}) != len(pairs):
            raise DecoderError("duplicate_decoder", f"a field of {name} has two decoders")
        self._covered(name, dict(pairs))
        return dict(pairs)

    def _chunk_rows(self, stream: dict[str, Any], chunk: dict[str, Any], decoders: dict[str, Callable[[Any], Any]]) -> Iterator[tuple[int, float | None, dict[str, Any]]]:
        names = [f["name"] for f in stream["fields"]]
        data = verified_bytes(f"{self.root}/{stream['directory']}/{chunk['file']}", chunk["bytes"], chunk["checksum"])
        for _, line in checked_lines(data, chunk["records"], chunk["first_iteration"], chunk["last_iteration"], len(names)):
            iteration, time, values = parsed_record(line, len(names))
            yield iteration, time, {f: _made(decoders[f], f, v) if f in decoders else v for f, v in zip(names, values, strict=True)}


def record_fields(lines: DataFrame, fields: list[str], kinds: dict[str, str | Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
    """Decoded records of ``line``: the other columns of ``lines``, iteration, physical_time and ``fields``, by ``beside`` names."""
    record = F.from_json("line", "iteration decimal(20,0), physical_time double, values array<variant>", {"mode": "FAILFAST", "allowNonNumericNumbers": "false"})
    rest = [c for c in lines.columns if c != "line"]
    rows = lines.select(*rest, record.alias("r"))
    fixed = [*(F.col(c).alias(beside(c, fields)) for c in rest), *(F.col(f"r.{c}").alias(beside(c, fields)) for c in ("iteration", "physical_time"))]
    return rows.select(*fixed, *(decoded(F.get(F.col("r.values"), F.lit(k)), (kinds or {}).get(f)).alias(f) for k, f in enumerate(fields)))


def _made(decoder: Callable[[Any], Any], field: str, value: Any) -> Any:
    try:
        return decoder(value)
    except Exception as e:
        raise DecoderError("decoder_failed", f"the decoder of {field} failed: {e}", field=field) from e


def beside(name: str, fields: list[str]) -> str:
    """``name`` of a column that stands beside ``fields``; names differ in more than their case."""
    taken = {f.lower() for f in fields}
    while name in taken:
        name = "_" + name
    return name


def decoded(value: Column, kind: str | Callable[[pd.Series], pd.Series] | None) -> Column:
    if kind is None:
        return value
    if isinstance(kind, str):
        return F.variant_get(value, "$", kind)
    return kind(F.to_json(value))


def faults(spark: SparkSession, root: str | Path, document: dict[str, Any]) -> DataFrame:
    """(stream, ordinal, fault) for chunks that aren't what their descriptors say, as a query over their bytes."""
    catalog = metadata.chunk_catalog(spark, document)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "chunk-*.jsonl").load(str(root))
    prefix = "file:" + str(Path(root).resolve())
    own = files.select(F.regexp_replace("path", "^" + re.escape(prefix) + "/", "").alias("file"), "length", "content")
    joined = catalog.join(own, "file", "left")
    lines = F.split(F.decode("content", "utf-8"), "\n", -1)
    fault = (
        F.when(F.col("content").isNull(), "missing_chunk")
        .when(F.col("length") != F.col("bytes"), "size_mismatch")
        .when(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("checksum"), "checksum_mismatch")
        .when(F.element_at(lines, -1) != "", "unterminated_record")
        .when(F.size(lines) - 1 != F.col("records"), "descriptor_mismatch")
    )
    return joined.select("stream", "ordinal", fault.alias("fault")).filter("fault IS NOT NULL")


def disordered(lines: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose iteration doesn't rise along their stream."""
    w = Window.partitionBy("stream").orderBy("ordinal", "pos")
    return lines.withColumn("before", F.lag("iteration").over(w)).filter("iteration <= before")


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
