"""Queries over the test tables, one for each operator that SQL can express, and their DuckDB SQL.

``events`` is the state stream: a stream per user, iteration = event_id, physical time = seconds since 2024-01-01.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.errors import StorageError
from kymo.functions import columns
from kymo.operators import chunks, series, state, streams
from kymo.plans.params import ParameterSpace, Sweep, document_leaves
from kymo.plans.provenance import ExecutionScope, load_artifact, persist_artifact
from kymo.plans.runtime import Phase, Plan, Selector, activity_tasks, progress_summary, progress_tasks
from kymo.sources.reader import RecordingReader, faults, record_fields
from kymo.sources.writer import RecordingBuilder, newest_checkpoint
from kymo.streaming.sink import capture

START = "2024-01-01 00:00:00"
KEYS = ["user_id"]
TARGET = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("iteration"), columns.seconds_since(F.col("ts"), START).alias("physical_time"), "value", "event_type", "props")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a record line of value and event_type."""
    own = states(spark, sf_dir).drop("physical_time")
    return streams.encoded(own, ["value", "event_type"], KEYS)


def space() -> ParameterSpace:
    fixed = {"interest": 0.04, "grid_shape": [3, 9], "pricing": {"rule": "tiered", "slack": 1e-6}}
    sweep = {"mode": "cartesian", "axes": {"discount": {"values": [0.05, 0.07]}, "quantity": {"values": [17, 24, 36]}}}
    return ParameterSpace(fixed, Sweep.parse(sweep))


def cases() -> ParameterSpace:
    found = [{"discount": 0.01, "interest": 1.5}, {"interest": 2.5, "discount": 0.02}, {"discount": 0.09, "interest": 3.5}]
    return ParameterSpace({"carrier": "rail"}, Sweep.parse({"mode": "cases", "cases": found}))


def _number(column: str, kind: str) -> Column:
    return F.col(f"`{column}`").cast(kind)


def sample_interval_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sampled(states(spark, sf_dir).drop("props"), 10, KEYS, final=True)


def sample_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sampled(states(spark, sf_dir), 7).select("user_id", "iteration", "value")


def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(spark, sf_dir)
    schema = state.StateSchema([state.Field(n) for n in ("value", "event_type", "props")])
    return own.select("user_id", "iteration", *streams.projected(schema, ["event_type", "value"]))


def record_encode_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("iteration", "bytes", F.sha2(F.concat("line", F.lit("\n")), 256).alias("sha"))


def record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines decoded as the reader decodes them, with bits of doubles intact."""
    fields = record_fields(records(spark, sf_dir).select("line"), ["value", "event_type"], {"value": "double", "event_type": "string"})
    return fields.select(F.col("iteration").cast("bigint").alias("iteration"), "value", "event_type")


def oversized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.oversized(records(spark, sf_dir), 45).select("user_id", "iteration", "bytes")


def chunk_descriptors_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.descriptors(chunks.rolled_over(records(spark, sf_dir), KEYS, TARGET), KEYS).drop("checksum")


def chunk_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.descriptors(chunks.rolled_over(records(spark, sf_dir), KEYS, TARGET), KEYS)
    return found.select("user_id", "ordinal", "file", "checksum")


def chunk_descriptors_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.descriptors(chunks.individual(records(spark, sf_dir), KEYS), KEYS)


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.stream_summary(chunks.descriptors(chunks.rolled_over(records(spark, sf_dir), KEYS, TARGET), KEYS, checksum=False), KEYS)


def rewind_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks.rolled_over(records(spark, sf_dir), KEYS, TARGET)
    return chunks.rewound(chunks.descriptors(own, KEYS, checksum=False), own, KEYS, 600)


def checkpoint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream that a continuation starts from: the highest last iteration, the last declared on ties."""
    own = stream_summary(spark, sf_dir).withColumn("tie", F.floor(F.col("last_iteration") / 100) * 100)
    by_name = {str(r["user_id"]): r for r in own.orderBy("user_id").collect()}  # a row per stream, as metadata holds them
    fields = [{"name": f.name} | ({"description": f.description} if f.description else {}) for f in EVENT_SCHEMA.fields]
    declared = [{"name": n, "fields": fields, "chunks": [{"last_iteration": r["tie"]}]} for n, r in by_name.items()]
    chosen = by_name[newest_checkpoint({"streams": declared}, EVENT_SCHEMA)["name"]]
    return spark.createDataFrame([(chosen["user_id"], chosen["last_iteration"], chosen["tie"])], "user_id bigint, last_iteration bigint, tie bigint")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_state(states(spark, sf_dir).drop("props"), KEYS)


def first_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.first_state(states(spark, sf_dir).drop("props"), KEYS)


def state_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.state_at(states(spark, sf_dir).drop("props"), 3, KEYS)


def series_replace_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.replace_at(states(spark, sf_dir).select("user_id", "iteration", "value"), 2, "value", F.lit(-1.0), KEYS)


def series_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.without_last(states(spark, sf_dir).select("user_id", "iteration", "value"), KEYS)


def series_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(spark, sf_dir).select("user_id", "iteration", "value")
    return series.append(own.filter("iteration < 500"), own.filter("iteration >= 500"), KEYS)


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(spark, sf_dir).select("user_id", "iteration", "value")
    return series.order_violations(own, KEYS, ["value", "iteration"])


def physical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("iteration", columns.checked_time(F.col("physical_time")).alias("physical_time"))


def time_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = state.advance(states(spark, sf_dir).select("iteration", "physical_time"), F.lit(0.5))
    return own.select(F.col("iteration").cast("bigint").alias("iteration"), "physical_time")


def populated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = states(spark, sf_dir).select("iteration", F.when(F.col("iteration") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("iteration") % 2 == 0, F.col("props")).alias("props"))
    return state.populated(own).select("iteration", "declared", "populated")


def sweep_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = space().frame(spark)
    return own.select("ordinal", _number("/discount", "double").alias("discount"), _number("/quantity", "bigint").alias("quantity"))


def sweep_over_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes from tables: each nation by each part size, the size fastest, as arithmetic on a range."""
    nations = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]
    sizes = [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]
    found = ParameterSpace({}, Sweep.parse({"mode": "cartesian", "axes": {"nation": {"values": nations}, "size": {"values": sizes}}}))
    return found.frame(spark).select("ordinal", F.from_json(F.concat(F.lit('{"v":'), F.col("`/nation`"), F.lit("}")), "v string")["v"].alias("nation"), _number("/size", "int").alias("size"))


def sweep_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cases().frame(spark)
    return own.select("ordinal", _number("/discount", "double").alias("discount"), _number("/interest", "double").alias("increment"))


def sweep_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = space().matching(spark, "/discount", 0.07)
    return own.select("ordinal", _number("/quantity", "bigint").alias("quantity"))


def sweep_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = cases().unique_matching("/discount", 0.02)
    return spark.createDataFrame([(task.ordinal, task.decode_value("/interest", float))], "ordinal bigint, increment double")


def fixed_join_sweep_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("document")
    pick = lambda path, kind: F.get_json_object(doc, path).cast(kind)
    return space().frame(spark).select("ordinal", pick("$.discount", "double").alias("discount"), pick("$.quantity", "bigint").alias("quantity"), pick("$.pricing.rule", "string").alias("method"), pick("$.grid_shape[1]", "int").alias("height"))


def parameter_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space().leaves(spark).select("ordinal", "pos", "pointer")


def param_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the JSON payload of every event, by strict parsing and flattening."""
    return document_leaves(states(spark, sf_dir).select("iteration", "props"), "props", "iteration")


def param_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fixed and swept pointers that set the same parameter."""
    spread = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string").withColumn(f"{c}_path", columns.segments(F.col(c)))
    left = spread(["/pricing", "/pricing/rule", "/quantity", "/a~1b/c", "/grid/shape"], "fixed")
    right = spread(["/pricing/rule", "/quantity", "/a~1b", "/grid/shapes", "/mu"], "swept")
    return left.join(right, columns.paths_conflict(F.col("fixed_path"), F.col("swept_path"))).select("fixed", "swept")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of task statuses by phase: orders as tasks, their priority as phase."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), status.alias("status"))
    return progress_summary(own).select("phase", "total", "pending", "running", "completed", "success")


PHASES = ((2, 1), (3, 2), (4, 2), (5, 3), (5, 4), (6, 1), (7, 6))


def _phases(needs: dict[int, tuple[int, ...]]) -> Plan:
    return Plan([Phase(p, f"phase {p}", activity_tasks(ParameterSpace({}, Sweep.parse({"mode": "cartesian", "axes": {}})), f"kind{p}", None), d) for p, d in needs.items()])


def phase_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _phases({p: tuple(d for q, d in PHASES if q == p) for p in range(1, 8)})
    return spark.createDataFrame([(p,) for p in plan.closure([5])], "phase int")


def phase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as phases, each of which needs the one before, declared backwards and found in order."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy(F.desc("r_regionkey")).collect()
    plan = _phases({r["r_regionkey"]: (r["r_regionkey"] - 1,) if r["r_regionkey"] else () for r in rows})
    name = {r["r_regionkey"]: r["r_name"] for r in rows}
    return spark.createDataFrame([(k, p, name[p]) for k, p in enumerate(plan.order([p.id for p in plan.phases]))], "place bigint, phase int, name string")


def release_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start offsets of tasks: dense ranks among those that aren't reused, times the delay."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()
    phases = []
    for region in sorted({r["n_regionkey"] for r in rows}):
        nations = [r["n_nationkey"] for r in rows if r["n_regionkey"] == region]
        found = progress_tasks(ParameterSpace({}, Sweep.parse({"mode": "cartesian", "axes": {"nation": {"values": nations}}})), "nation", 1, lambda c: None)
        for t in found:
            t.work = None if t.configuration.value("/nation") % 3 == 0 else t.work
        phases.append(Phase(region, f"region {region}", found, delay_per_task=0.25))
    out = []
    for document, p in zip(Plan(phases).to_json()["phases"], phases, strict=True):
        out += [(p.id, t.configuration.value("/nation"), t.reused, d["delay_rank"], d["release_offset_ns"]) for t, d in zip(p.tasks, document["tasks"], strict=True)]
    return spark.createDataFrame(out, "phase int, task int, reused boolean, delay_rank bigint, release_offset_ns bigint")


def varying_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels name: the parameters whose values differ among the tasks, with the number of their values."""
    phase = Phase(1, "simulate", activity_tasks(space(), "run", None))
    labels = spark.createDataFrame([(t.label,) for t in phase.tasks], "label string").select(F.explode(F.split(F.regexp_extract("label", r"\[(.*)\]", 1), ", ")).alias("part"))
    parts = F.split("part", "=")
    return labels.groupBy(F.concat(F.lit("/"), parts[0]).alias("pointer")).agg(F.count_distinct(parts[1]).alias("kinds"))


def task_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("kind"))
    return Selector("1-URGENT", "F", (("/odd", True),)).rows(own.withColumn("/odd", F.col("task") % 2 == 1)).drop("/odd")


def hopf_step(spark: SparkSession, sf_dir: str, steps: int = 90) -> DataFrame:
    """An application's evolution step: both slopes from the point before the step, one series per value of mu."""
    omega, dt = 1.0, 0.01

    def evolve(group: pd.DataFrame) -> pd.DataFrame:
        mu = float(group["mu"].iloc[0])
        x, y, rows = 1.0, 0.0, []
        for i in range(steps + 1):
            rows.append((mu, i, round(x, 9), round(y, 9)))
            r = x * x + y * y
            x, y = x + dt * (mu * x - omega * y - r * x), y + dt * (omega * x + mu * y - r * y)
        return pd.DataFrame(rows, columns=["mu", "iteration", "x", "y"])

    own = ParameterSpace({}, Sweep.parse({"mode": "cartesian", "axes": {"mu": {"values": [-0.25, 0.25, 1.0]}}})).frame(spark)
    return own.select(_number("/mu", "double").alias("mu")).groupBy("mu").applyInPandas(evolve, "mu double, iteration bigint, x double, y double")


def recordings_root(spark: SparkSession) -> Path:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir`` where that is a mounted folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and re.match(r"(file:)?/", shared):
        base = Path(shared.removeprefix("file://").removeprefix("file:"))
        base.mkdir(parents=True, exist_ok=True)
        return Path(tempfile.mkdtemp(prefix="recordings-", dir=base))
    return Path(tempfile.mkdtemp(prefix="recordings-"))


EVENT_SCHEMA = state.StateSchema([state.Field("value", "Measured value"), state.Field("event_type")])
EVENT_KINDS = {"value": "double", "event_type": "string"}


def event_builder(root: Path) -> RecordingBuilder:
    """Two streams over all events as one series: values of every tenth, whole states of every hundredth."""
    built = RecordingBuilder(root / "events", EVENT_SCHEMA).with_shared_storage(streams.Storage(16_384, 65_536)).with_time_axis("event", None, "time", "s")
    return built.add_stream(streams.StreamConfig("values", ("value",), 10)).add_stream(streams.StreamConfig("whole", ("event_type", "value"), 100))


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("iteration", "physical_time", "value", "event_type")


def _recorded(spark: SparkSession, sf_dir: str, final: bool = True) -> RecordingReader:
    root = recordings_root(spark)
    with event_builder(root).create() as writer:
        writer.record(_event_rows(spark, sf_dir), final=final)
        writer.complete()
    return RecordingReader(spark, root / "events")


def recording_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded by executors, verified and decoded again."""
    rows = _recorded(spark, sf_dir).read_stream("whole", EVENT_KINDS)
    return rows.select(F.col("iteration").cast("bigint").alias("iteration"), "physical_time", "value", "event_type")


def recording_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on the iteration choose chunks by their descriptors."""
    rows = _recorded(spark, sf_dir).lines("values").filter((F.col("iteration") >= 300) & (F.col("iteration") < 700))
    return rows.select("stream", F.col("iteration").cast("bigint").alias("iteration"))


def recording_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ranges from descriptors alone."""
    found = _recorded(spark, sf_dir).chunks().groupBy("stream").agg(F.sum("records").alias("records"), F.min("first_iteration").cast("bigint").alias("first_iteration"), F.max("last_iteration").cast("bigint").alias("last_iteration"))
    return found.select("stream", "records", "first_iteration", "last_iteration")


def recording_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest chunk's last record of each stream."""
    reader = _recorded(spark, sf_dir)
    rows = [(n, *reader.latest_state(n)[:2], reader.latest_state(n)[2]["value"]) for n in reader.stream_names()]
    return spark.createDataFrame(rows, "stream string, iteration bigint, physical_time double, value double")


def recording_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that aren't what their descriptors say, after one was lengthened and one changed."""
    reader = _recorded(spark, sf_dir)
    folder = Path(reader.root) / "streams"
    with (folder / "values" / "chunk-000000.jsonl").open("ab") as f:
        f.write(b"{}")
    whole = folder / "whole" / "chunk-000000.jsonl"
    whole.write_bytes(whole.read_bytes().replace(b"1", b"2", 1))
    return faults(spark, reader.root, reader.document)


def recording_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording that was left running goes on from its newest whole state; later records are rewound and made again."""
    root = recordings_root(spark)
    rows = _event_rows(spark, sf_dir)
    with event_builder(root).create() as writer:
        writer.record(rows.filter("iteration <= 555"))
    writer, restored = event_builder(root).continue_from_checkpoint()
    with writer:
        writer.record(rows.filter((F.col("iteration") > restored.iteration) & (F.col("iteration") <= 800)))
        writer.complete()
    found = RecordingReader(spark, root / "events").read_stream("values", {"value": "double"})
    return found.select(F.col("iteration").cast("bigint").alias("iteration"), "value", F.lit(restored.iteration).cast("bigint").alias("restored"))


def recording_resume_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recording_resume, over the whole table: broken off past the middle, resumed, and recorded to the end."""
    root = recordings_root(spark)
    rows = _event_rows(spark, sf_dir)
    half = rows.agg(F.max("iteration")).first()[0] // 2
    with event_builder(root).create() as writer:
        writer.record(rows.filter(F.col("iteration") <= half))
    writer, restored = event_builder(root).continue_from_checkpoint()
    with writer:
        writer.record(rows.filter(F.col("iteration") > restored.iteration), late="raise")
        writer.complete()
    found = RecordingReader(spark, root / "events").read_stream("values", {"value": "double"})
    return found.select(F.col("iteration").cast("bigint").alias("iteration"), "value", F.lit(restored.iteration).cast("bigint").alias("restored"))


def recording_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half is recorded, then all rows are offered: the error hands back what comes too late, and nothing is written."""
    root = recordings_root(spark)
    rows = _event_rows(spark, sf_dir)
    half = rows.agg(F.max("iteration")).first()[0] // 2
    with event_builder(root).create() as writer:
        writer.record(rows.filter(F.col("iteration") > half))
        before = writer.document["streams"][0]["chunks"][-1]["last_iteration"]
        try:
            writer.record(rows, late="raise")
        except StorageError as e:
            rejected = e.context["rejected"]
            return rejected.select("iteration", F.lit(e.code).alias("code"), F.lit(before == writer.document["streams"][0]["chunks"][-1]["last_iteration"]).alias("untouched"))
    raise AssertionError("late rows were taken")


NATION_SCHEMA = state.StateSchema([state.Field("name", "Nation"), state.Field("region")])
NATION_STREAM = {"name": "nations", "fields": ["region", "name"], "sampling_interval": {"iterations": 1}, "storage": {"layout": {"kind": "chunked", "target_bytes": 1 << 20}, "storage_queue_bytes": 4096}}


def _nation_builder(root: Path) -> RecordingBuilder:
    return RecordingBuilder(root / "nations", NATION_SCHEMA).add_stream(streams.StreamConfig.parse(NATION_STREAM))


def _nation_states(spark: SparkSession, sf_dir: str) -> Iterator[state.State]:
    """One state worked on from nation to nation, as an application's own loop does."""
    own = NATION_SCHEMA.create_empty_state()
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        own.replace_simulation_time(r["n_nationkey"], r["n_nationkey"] / 4)
        own.insert_payload("name", r["n_name"])
        own.insert_payload("region", r["n_regionkey"])
        yield own


def _nation_rows(reader: RecordingReader) -> DataFrame:
    found = reader.read_stream("nations", {"name": "string", "region": "int"})
    return found.select(F.col("iteration").cast("bigint").alias("iteration"), "physical_time", "name", "region")


def observed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States taken one by one on the driver, with a stream configured by a JSON document."""
    root = recordings_root(spark)
    with _nation_builder(root).create() as writer:
        for own in _nation_states(spark, sf_dir):
            writer.observe_state(own)
        writer.complete_with_final_state(own)
    return _nation_rows(RecordingReader(spark, root / "nations"))


def recording_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks sealed by hand after every tenth state."""
    root = recordings_root(spark)
    with _nation_builder(root).create() as writer:
        for own in _nation_states(spark, sf_dir):
            writer.observe_state(own)
            if own.iteration % 10 == 9:
                writer.flush_stream("nations")
        writer.complete()
    found = RecordingReader(spark, root / "nations").chunks()
    return found.select("ordinal", F.element_at(F.split("file", "/"), -1).alias("file"), "records", F.col("first_iteration").cast("bigint").alias("first_iteration"), F.col("last_iteration").cast("bigint").alias("last_iteration"))


def recording_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that stopped, with an unpublished file left behind: opened again it goes on from the newest state."""
    root = recordings_root(spark)
    half = table(spark, sf_dir, "nation").count() // 2
    writer, nothing = _nation_builder(root).open_or_resume()
    with writer:
        for own in _nation_states(spark, sf_dir):
            if own.iteration < half:
                writer.observe_state(own)
    (root / "nations" / "streams" / "nations" / "chunk-000009.jsonl.tmp").write_bytes(b"{")
    writer, restored = _nation_builder(root).open_or_resume()
    with writer:
        for own in _nation_states(spark, sf_dir):
            if own.iteration > restored.iteration:
                writer.observe_state(own)
        writer.complete()
    reader = RecordingReader(spark, root / "nations")
    return _nation_rows(reader).select("iteration", "name", F.lit(restored.iteration).alias("restored"), F.lit(reader.timing["continuation_count"]).alias("continuations"), F.lit(nothing is None).alias("was_new"))


def recording_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored state, chunk after chunk on the driver, through decoders of the application's."""
    reader = _recorded(spark, sf_dir)
    rows = [(int(i), v["value"], v["event_type"]) for i, _, v in reader.iterate("whole", [("value", lambda x: x * 2), ("event_type", str.upper)])]
    return spark.createDataFrame(rows, "iteration bigint, twice double, event_type string")


def table_space(spark: SparkSession, sf_dir: str) -> ParameterSpace:
    """Region names as fixed parameters; nations by part sizes as the sweep."""
    regions = {r["r_name"].lower(): r["r_regionkey"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()}
    nations = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]
    sizes = [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]
    return ParameterSpace({"regions": regions}, Sweep.parse({"mode": "cartesian", "axes": {"nation": {"values": nations}, "size": {"values": sizes}}}))


def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task by its ordinal, its values decoded by type."""
    found = table_space(spark, sf_dir)
    rows = [(t.ordinal, *t.decode_values(("/nation", str), ("/size", int)), len(t)) for t in map(found.task, range(found.task_count))]
    return spark.createDataFrame(rows, "ordinal bigint, nation string, size bigint, parameters int")


def sweep_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table_space(spark, sf_dir).facts()
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} bigint" for k in facts))


def sweep_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each nation, by matching its name."""
    found = table_space(spark, sf_dir)
    own = [found.matching(spark, "/nation", n).select("ordinal", F.lit(n).alias("nation")) for n in found.sweep.axes[0].values]
    return reduce(DataFrame.unionByName, own)


def sweep_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task as a written document, read back by Spark."""
    found, root = table_space(spark, sf_dir), recordings_root(spark)
    for task in found.tasks():
        task.write_resolved_json(root / f"task-{task.ordinal:06d}.json")
    read = spark.read.json(f"file://{root}/*.json", multiLine=True)
    return read.select("parameters.nation", "parameters.size", F.col("parameters.regions.asia").alias("asia"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's row as an input kept under its digest; those of one region are the same bytes and one file."""
    scope = ExecutionScope.create_named(recordings_root(spark), "run")
    rows = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        own, created = persist_artifact(scope, "region", "txt", str(r["n_regionkey"]).encode())
        rows.append((r["n_nationkey"], own.sha256, created, load_artifact(scope.directory, own).decode()))
    return spark.createDataFrame(rows, "nation int, sha256 string, created boolean, content string")


def series_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lengths(states(spark, sf_dir), KEYS)


def series_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered series under a name for SQL."""
    name = series.view(series.ordered(states(spark, sf_dir).select("user_id", "iteration", "value"), KEYS), "kymo_series")
    return spark.sql(f"SELECT user_id, iteration, value FROM {name}")


def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a recording, in micro-batches."""
    root = recordings_root(spark)
    table_schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(table_schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    live = source.select(F.col("event_id").alias("iteration"), columns.seconds_since(F.col("ts"), START).alias("physical_time"), "value", "event_type")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with event_builder(root).create() as writer:
        query = capture(live, writer, str(root / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        writer.complete()
    return RecordingReader(spark, root / "events").read_stream("whole", EVENT_KINDS).select(F.col("iteration").cast("bigint").alias("iteration"), "value", "event_type")


def plan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table of a plan: one phase of simulations, one that reuses their checks."""
    plan = Plan([Phase(1, "simulate", progress_tasks(space(), "run", 3, lambda c: None), delay_per_task=0.5), Phase(2, "check", activity_tasks(space(), "check", None), (1,))])
    return plan.tasks(spark).select("phase", "task", F.col("ordinal"), "status", "delay_rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        sample_interval_final, sample_interval, stream_projection, record_encode_sha, record_decode, oversized_records, chunk_descriptors_rollover, chunk_checksum,
        chunk_descriptors_individual, stream_summary, rewind_prefix, checkpoint_choice, latest_state, first_state, state_at_position, series_replace_at, series_pop,
        series_append, order_violations, physical_time, time_advance, populated_fields, sweep_cartesian, sweep_over_tables, sweep_cases, sweep_match, sweep_unique,
        fixed_join_sweep_json, parameter_leaves, param_leaves, param_conflicts, status_summary, phase_closure, release_offsets, varying_keys, task_select, plan_tasks,
        phase_order, sweep_points, sweep_facts, sweep_matched, sweep_exported, artifacts, series_lengths, series_view, observed_states, recording_flushed, recording_reopened,
        recording_decoders, recording_out_of_order, recording_resume_all,
        recording_roundtrip, recording_pruned_scan, recording_catalog, recording_latest, recording_faults, recording_resume, stream_capture,
    )
    return {f.__name__: f for f in found} | {"hopf_trajectory": hopf_step}


_STATES = "s AS (SELECT user_id, event_id AS iteration, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0 AS physical_time, value, event_type, props FROM events)"
_LINES = """l AS (SELECT user_id, event_id AS iteration, '{"iteration":' || event_id || ',"values":[' || CAST(value AS VARCHAR) || ',"' || event_type || '"]}' AS line FROM events),
r AS (SELECT *, octet_length(encode(line)) + 1 AS bytes FROM l)"""
_CHUNKS = f"""{_LINES},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iteration) AS k FROM r),
f AS (SELECT user_id, k, iteration, bytes, line, 0 AS ordinal, bytes AS held FROM n WHERE k = 1
      UNION ALL
      SELECT n.user_id, n.k, n.iteration, n.bytes, n.line,
             CASE WHEN f.held >= {TARGET} OR f.held + n.bytes > {TARGET} THEN f.ordinal + 1 ELSE f.ordinal END,
             CASE WHEN f.held >= {TARGET} OR f.held + n.bytes > {TARGET} THEN n.bytes ELSE f.held + n.bytes END
      FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)"""
_DESCRIBE = "user_id, ordinal, 'chunk-' || lpad(CAST(ordinal AS VARCHAR), 6, '0') || '.jsonl' AS file, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, min(iteration) AS first_iteration, max(iteration) AS last_iteration"
_SHA = "'sha256:' || sha256(string_agg(line || chr(10), '' ORDER BY iteration)) AS checksum"
_SUMMARY = f"""{_CHUNKS}, d AS (SELECT {_DESCRIBE} FROM f GROUP BY user_id, ordinal),
m AS (SELECT user_id, count(*) AS chunk_count, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, min(first_iteration) AS first_iteration, max(last_iteration) AS last_iteration FROM d GROUP BY user_id)"""
_SPACE = "t AS (SELECT (a.i * 3 + b.i) AS ordinal, a.v AS discount, b.v AS quantity FROM (VALUES (0, 0.05::DOUBLE), (1, 0.07::DOUBLE)) a(i, v), (VALUES (0, 17::BIGINT), (1, 24::BIGINT), (2, 36::BIGINT)) b(i, v))"
_CASES = "c AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE, 1.5::DOUBLE), (1, 0.02::DOUBLE, 2.5::DOUBLE), (2, 0.09::DOUBLE, 3.5::DOUBLE)) AS c(ordinal, discount, increment))"

_TABLE_SPACE = "WITH a AS (SELECT n_name AS nation, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), b AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS j FROM (SELECT DISTINCT p_size AS size FROM part)), t AS (SELECT i * (SELECT count(*) FROM b) + j AS ordinal, nation, size FROM a CROSS JOIN b)"


def oracle_sql() -> dict[str, str]:
    last = "row_number() OVER (PARTITION BY user_id ORDER BY iteration)"
    return {
        "sample_interval_final": f"WITH {_STATES} SELECT user_id, iteration, physical_time, value, event_type FROM s QUALIFY iteration % 10 = 0 OR iteration = max(iteration) OVER (PARTITION BY user_id)",
        "sample_interval": f"WITH {_STATES} SELECT user_id, iteration, value FROM s WHERE iteration % 7 = 0",
        "stream_projection": f"WITH {_STATES} SELECT user_id, iteration, value, event_type FROM s",
        "record_encode_sha": f"WITH {_LINES} SELECT iteration, bytes, sha256(line || chr(10)) AS sha FROM r",
        "record_decode": "SELECT event_id AS iteration, value, event_type FROM events",
        "oversized_records": f"WITH {_LINES} SELECT user_id, iteration, bytes FROM r WHERE bytes > 45",
        "chunk_descriptors_rollover": f"WITH RECURSIVE {_CHUNKS} SELECT {_DESCRIBE} FROM f GROUP BY user_id, ordinal",
        "chunk_checksum": f"WITH RECURSIVE {_CHUNKS} SELECT user_id, ordinal, 'chunk-' || lpad(CAST(ordinal AS VARCHAR), 6, '0') || '.jsonl' AS file, {_SHA} FROM f GROUP BY user_id, ordinal",
        "chunk_descriptors_individual": f"WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iteration) - 1 AS ordinal FROM r) SELECT {_DESCRIBE}, {_SHA} FROM f GROUP BY user_id, ordinal",
        "stream_summary": f"WITH RECURSIVE {_SUMMARY} SELECT * FROM m",
        "rewind_prefix": f"WITH RECURSIVE {_CHUNKS} SELECT {_DESCRIBE} FROM f WHERE iteration <= 600 GROUP BY user_id, ordinal",
        "checkpoint_choice": f"WITH RECURSIVE {_SUMMARY} SELECT user_id, last_iteration, CAST(floor(last_iteration / 100) * 100 AS BIGINT) AS tie FROM m ORDER BY tie DESC, user_id DESC LIMIT 1",
        "latest_state": f"WITH {_STATES} SELECT user_id, iteration, physical_time, value, event_type FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY iteration DESC) = 1",
        "first_state": f"WITH {_STATES} SELECT user_id, iteration, physical_time, value, event_type FROM s QUALIFY {last} = 1",
        "state_at_position": f"WITH {_STATES} SELECT user_id, iteration, physical_time, value, event_type, {last} - 1 AS position FROM s QUALIFY {last} = 4",
        "series_replace_at": f"WITH {_STATES} SELECT user_id, iteration, CASE WHEN {last} = 3 THEN -1.0 ELSE value END AS value FROM s",
        "series_pop": f"WITH {_STATES} SELECT user_id, iteration, value FROM s QUALIFY iteration < max(iteration) OVER (PARTITION BY user_id)",
        "series_append": f"WITH {_STATES} SELECT user_id, iteration, value FROM s",
        "order_violations": f"WITH {_STATES} SELECT user_id, iteration, value, lag(iteration) OVER (PARTITION BY user_id ORDER BY value, iteration) AS previous_iteration FROM s QUALIFY iteration <= previous_iteration",
        "physical_time": f"WITH {_STATES} SELECT iteration, physical_time FROM s",
        "time_advance": f"WITH {_STATES} SELECT iteration + 1 AS iteration, physical_time + 0.5 AS physical_time FROM s",
        "populated_fields": f"WITH {_STATES} SELECT iteration, 2 AS declared, CAST(iteration % 3 <> 0 AND value IS NOT NULL AS INT) + CAST(iteration % 2 = 0 AND props IS NOT NULL AS INT) AS populated FROM s",
        "sweep_cartesian": f"WITH {_SPACE} SELECT ordinal, discount, quantity FROM t",
        "sweep_over_tables": "WITH a AS (SELECT n_name AS nation, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), b AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS j FROM (SELECT DISTINCT p_size AS size FROM part)) SELECT i * (SELECT count(*) FROM b) + j AS ordinal, nation, size FROM a CROSS JOIN b",
        "sweep_cases": f"WITH {_CASES} SELECT * FROM c",
        "sweep_match": f"WITH {_SPACE} SELECT ordinal, quantity FROM t WHERE discount = 0.07",
        "sweep_unique": f"WITH {_CASES} SELECT ordinal, increment FROM c WHERE discount = 0.02",
        "fixed_join_sweep_json": f"WITH {_SPACE} SELECT ordinal, discount, quantity, 'tiered' AS method, 9 AS height FROM t",
        "parameter_leaves": f"WITH {_SPACE} SELECT ordinal, pos, pointer FROM t, (VALUES (0, '/interest'), (1, '/grid_shape'), (2, '/pricing/rule'), (3, '/pricing/slack'), (4, '/discount'), (5, '/quantity')) AS p(pos, pointer)",
        "param_leaves": "WITH k AS (SELECT event_id AS iteration, props, unnest(json_keys(props)) AS name FROM events) SELECT iteration, '/' || replace(replace(name, '~', '~0'), '/', '~1') AS pointer, json_extract_string(props, '$.\"' || name || '\"') AS value FROM k",
        "param_conflicts": "WITH f AS (SELECT unnest(['/pricing', '/pricing/rule', '/quantity', '/a~1b/c', '/grid/shape']) AS fixed), s AS (SELECT unnest(['/pricing/rule', '/quantity', '/a~1b', '/grid/shapes', '/mu']) AS swept) SELECT fixed, swept FROM f, s WHERE fixed = swept OR starts_with(fixed, swept || '/') OR starts_with(swept, fixed || '/')",
        "status_summary": "WITH t AS (SELECT o_orderpriority AS phase, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'pending' END AS status FROM orders) SELECT phase, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed') = count(*) AS success FROM t GROUP BY phase",
        "phase_closure": "WITH RECURSIVE d(phase, dependency) AS (VALUES (2, 1), (3, 2), (4, 2), (5, 3), (5, 4), (6, 1), (7, 6)), need(phase) AS (SELECT 5 UNION SELECT d.dependency FROM need n JOIN d ON d.phase = n.phase) SELECT phase FROM need",
        "release_offsets": "WITH t AS (SELECT n_regionkey AS phase, n_nationkey AS task, n_nationkey % 3 = 0 AS reused FROM nation), r AS (SELECT *, CASE WHEN NOT reused THEN row_number() OVER (PARTITION BY phase, reused ORDER BY task) - 1 END AS delay_rank FROM t) SELECT *, delay_rank * 250000000 AS release_offset_ns FROM r",
        "varying_keys": f"WITH {_SPACE} SELECT '/discount' AS pointer, count(DISTINCT discount) AS kinds FROM t UNION ALL SELECT '/quantity', count(DISTINCT quantity) FROM t",
        "task_select": "SELECT o_orderkey AS task, o_orderpriority AS phase, o_orderstatus AS kind FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_orderkey % 2 = 1",
        "plan_tasks": "SELECT 1 AS phase, 'run:' || i AS task, i AS ordinal, 'pending' AS status, i AS delay_rank FROM range(6) r(i) UNION ALL SELECT 2, 'check:' || i, i, 'reused', NULL FROM range(6) r(i)",
        "recording_roundtrip": f"WITH {_STATES} SELECT iteration, physical_time, value, event_type FROM s QUALIFY iteration % 100 = 0 OR iteration = max(iteration) OVER ()",
        "recording_pruned_scan": f"WITH {_STATES} SELECT 'values' AS stream, iteration FROM s WHERE iteration % 10 = 0 AND iteration >= 300 AND iteration < 700",
        "recording_catalog": f"WITH {_STATES}, t AS (SELECT 'values' AS stream, 10 AS n UNION ALL SELECT 'whole', 100), m AS (SELECT stream, iteration FROM s, t WHERE iteration % n = 0 OR iteration = (SELECT max(iteration) FROM s)) SELECT stream, count(*) AS records, min(iteration) AS first_iteration, max(iteration) AS last_iteration FROM m GROUP BY stream",
        "recording_latest": f"WITH {_STATES} SELECT t.stream, iteration, physical_time, value FROM s, (VALUES ('values'), ('whole')) t(stream) WHERE iteration = (SELECT max(iteration) FROM s)",
        "recording_faults": "SELECT 'values' AS stream, 0 AS ordinal, 'size_mismatch' AS fault UNION ALL SELECT 'whole', 0, 'checksum_mismatch'",
        "recording_resume": f"WITH {_STATES} SELECT iteration, value, 500 AS restored FROM s WHERE iteration % 10 = 0 AND iteration <= 800",
        "recording_resume_all": f"WITH {_STATES}, m AS (SELECT max(iteration) // 2 AS half FROM s) SELECT iteration, value, (SELECT max(iteration) FROM s, m WHERE iteration <= half AND iteration % 100 = 0) AS restored FROM s WHERE iteration % 10 = 0",
        "recording_out_of_order": f"WITH {_STATES}, m AS (SELECT max(iteration) AS last FROM s WHERE iteration % 10 = 0) SELECT iteration, 'out_of_order_iteration' AS code, true AS untouched FROM s, m WHERE iteration % 10 = 0 AND iteration < last",
        "observed_states": "SELECT n_nationkey AS iteration, n_nationkey / 4.0 AS physical_time, n_name AS name, n_regionkey AS region FROM nation",
        "recording_flushed": "SELECT n_nationkey // 10 AS ordinal, 'chunk-' || lpad(CAST(n_nationkey // 10 AS VARCHAR), 6, '0') || '.jsonl' AS file, count(*) AS records, min(n_nationkey) AS first_iteration, max(n_nationkey) AS last_iteration FROM nation GROUP BY n_nationkey // 10",
        "recording_reopened": "SELECT n_nationkey AS iteration, n_name AS name, (SELECT count(*) // 2 - 1 FROM nation) AS restored, 1 AS continuations, true AS was_new FROM nation",
        "recording_decoders": f"WITH {_STATES} SELECT iteration, value * 2 AS twice, upper(event_type) AS event_type FROM s QUALIFY iteration % 100 = 0 OR iteration = max(iteration) OVER ()",
        "phase_order": "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS place, r_regionkey AS phase, r_name AS name FROM region",
        "sweep_points": f"{_TABLE_SPACE} SELECT ordinal, nation, size, (SELECT count(*) FROM region) + 2 AS parameters FROM t",
        "sweep_facts": "SELECT r AS fixed_parameter_count, 2 AS sweep_parameter_count, r + 2 AS parameter_count, (SELECT count(*) FROM nation) * (SELECT count(DISTINCT p_size) FROM part) AS task_count FROM (SELECT count(*) AS r FROM region)",
        "sweep_matched": f"{_TABLE_SPACE} SELECT ordinal, nation FROM t",
        "sweep_exported": f"{_TABLE_SPACE} SELECT nation, size, (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AS asia FROM t",
        "artifacts": "SELECT n_nationkey AS nation, sha256(CAST(n_regionkey AS VARCHAR)) AS sha256, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS created, CAST(n_regionkey AS VARCHAR) AS content FROM nation",
        "series_lengths": f"WITH {_STATES} SELECT user_id, count(*) AS length, min(iteration) AS first_iteration, max(iteration) AS last_iteration FROM s GROUP BY user_id",
        "series_view": f"WITH {_STATES} SELECT user_id, iteration, value FROM s",
        "stream_capture": f"WITH {_STATES} SELECT iteration, value, event_type FROM s WHERE iteration % 100 = 0",
        "hopf_trajectory": "WITH RECURSIVE h AS (SELECT CAST(mu AS DOUBLE) AS mu, 0 AS iteration, 1.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM (VALUES (-0.25), (0.25), (1.0)) AS v(mu) UNION ALL SELECT mu, iteration + 1, x + 0.01 * (mu * x - 1.0 * y - (x * x + y * y) * x), y + 0.01 * (1.0 * x + mu * y - (x * x + y * y) * y) FROM h WHERE iteration < 90) SELECT mu, CAST(iteration AS BIGINT) AS iteration, round(x, 9) AS x, round(y, 9) AS y FROM h",
    }
