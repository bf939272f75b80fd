import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from kymo.errors import DecoderError, IntegrityError, MetadataError, RecordError, RecordingNotCompleteError, StorageError, UnknownStreamError
from kymo.operators.state import Field, State, StateSchema
from kymo.operators.streams import Storage, StreamConfig
from kymo.sources import metadata
from kymo.sources.reader import RecordingReader, disordered, faults, verified_bytes
from kymo.sources.writer import RecordingBuilder, reconcile
from kymo.streaming.sink import RecordingSink, capture

SCHEMA = StateSchema([Field("population", "Counts"), Field("label")])
# A chunk of the wire format, its digest, and below the keys of the metadata document.
GOLDEN = b'{"iteration":0,"physical_time":0.0,"values":[[2.0,1.0],"start"]}\n{"iteration":2,"physical_time":0.5,"values":[[1.0,2.0],"later"]}\n'
GOLDEN_SUM = "sha256:eb51b8dd52d7adcd98ae1886daf952bdba982ee12013dbcd86263c4ab361a4cb"


def states(*iterations):
    for i in iterations:
        s = State(SCHEMA, i, i / 4)
        s.insert_payload("population", [float(i), 1.5])
        s.insert_payload("label", f"n{i}")
        yield s


def builder(root, storage=Storage(64 * 1024, 1 << 20), checkpoint=2):
    out = RecordingBuilder(root, SCHEMA).with_shared_storage(storage)
    return out.add_stream(StreamConfig("observations", ("label",), 1)).add_stream(StreamConfig("checkpoint", ("label", "population"), checkpoint))


def golden(root, data=GOLDEN, **changes):
    folder = root / "streams" / "signal"
    folder.mkdir(parents=True)
    (folder / "chunk-000000.jsonl").write_bytes(data)
    chunk = {"ordinal": 0, "file": "chunk-000000.jsonl", "records": 2, "bytes": len(data), "checksum": GOLDEN_SUM, "first_iteration": 0, "last_iteration": 2} | changes
    document = {
        "format": "elsewhere-jsonl", "version": 7, "status": {"state": "complete"}, "records": {"encoding": "json", "framing": "json_lines"},
        "timing": {"created_at_utc": "2026-01-01T00:00:00Z", "finalized_at_utc": "2026-01-01T00:00:01Z", "active_duration_ns": 10, "continuation_count": 0},
        "time": {"iteration_name": "iteration", "physical_time_name": "physical_time"}, "user_metadata": {"study": "x"}, "terminal_metadata": {"why": "done"},
        "streams": [{"name": "signal", "directory": "streams/signal", "sampling_interval": {"iterations": 2}, "fields": [{"name": "population"}, {"name": "label"}], "storage": {"layout": {"kind": "chunked", "target_bytes": 1024}, "storage_queue_bytes": 4096}, "chunks": [chunk]}],
    }
    (root / "metadata.json").write_text(json.dumps(document))
    return document


def code(error, call):
    with pytest.raises(error) as e:
        call()
    return e.value.code


def test_golden_recording(spark, tmp_path):
    golden(tmp_path)
    reader = RecordingReader(spark, tmp_path)
    assert reader.stream_names() == ["signal"] and reader.stream_record_count("signal") == 2 and reader.stream_encoded_bytes("signal") == 130
    rows = reader.read_stream("signal", {"population": "array<double>", "label": "string"}).orderBy("iteration").collect()
    assert [(int(r["iteration"]), r["physical_time"], r["population"], r["label"]) for r in rows] == [(0, 0.0, [2.0, 1.0], "start"), (2, 0.5, [1.0, 2.0], "later")]
    assert reader.latest_state("signal") == (2, 0.5, {"population": [1.0, 2.0], "label": "later"})
    assert len(list(reader.iterate("signal"))) == 2 and reader.user_metadata == {"study": "x"} and reader.version == 7
    assert [str(v) for v in reader.read_stream("signal").orderBy("iteration").collect()[0]["population"].toPython()] == ["2.0", "1.0"]
    assert reader.lines().filter("iteration > 5").count() == 0 and disordered(reader.lines()).count() == 0
    assert faults(spark, tmp_path, reader.document).count() == 0
    assert code(UnknownStreamError, lambda: reader.read_stream("x")) == "unknown_stream"
    assert code(DecoderError, lambda: reader.read_stream("signal", {"label": "string"})) == "missing_decoder"
    assert code(MetadataError, lambda: RecordingReader(spark, tmp_path, "other-format")) == "wrong_format"


@pytest.mark.parametrize(
    "data,error,want",
    [
        (GOLDEN[:-1], RecordError, "unterminated_record"),
        (GOLDEN.replace(b',"later"', b""), RecordError, "record_width"),
        (GOLDEN.replace(b'"later"', b'"later",1'), RecordError, "record_width"),
        (GOLDEN.replace(b'[[1.0,2.0],"later"]', b"{}"), RecordError, "record_width"),
        (GOLDEN.replace(b"0.5", b"1e400"), RecordError, "non_finite"),
        (GOLDEN.replace(b'"iteration":2', b'"iteration":0'), RecordError, "record_order"),
        (GOLDEN.replace(b'"iteration":2', b'"iteration":3'), IntegrityError, "descriptor_mismatch"),
        (GOLDEN.replace(b"later", b"lat\\u0065r").replace(b'"values"', b'"x"'), RecordError, "record_keys"),
        (GOLDEN + b"\n", RecordError, "empty_record"),
    ],
)
def test_corrupt_records(spark, tmp_path, data, error, want):
    import hashlib

    golden(tmp_path, data, checksum="sha256:" + hashlib.sha256(data).hexdigest())
    reader = RecordingReader(spark, tmp_path)
    assert code(error, lambda: list(reader.iterate("signal"))) == want
    with pytest.raises(Exception):
        reader.read_stream("signal", {"population": "array<double>", "label": "string"}).collect()


def test_integrity(spark, tmp_path):
    document = golden(tmp_path)
    chunk = tmp_path / "streams/signal/chunk-000000.jsonl"
    reader = RecordingReader(spark, tmp_path)
    chunk.write_bytes(GOLDEN.replace(b"start", b"stort"))
    assert code(IntegrityError, lambda: reader.latest_state("signal")) == "checksum_mismatch"
    assert faults(spark, tmp_path, document).collect() == [("signal", 0, "checksum_mismatch")]
    chunk.write_bytes(GOLDEN + b"{}\n")
    assert code(IntegrityError, lambda: reader.latest_state("signal")) == "size_mismatch"
    chunk.unlink()
    assert code(IntegrityError, lambda: reader.latest_state("signal")) == "missing_chunk"
    assert code(IntegrityError, lambda: verified_bytes(chunk, 1, "x")) == "missing_chunk"


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.update(version=999), lambda d: d.update(extra=1), lambda d: d["time"].update(physical_time_unit="s", physical_time_name=None), lambda d: d["timing"].pop("finalized_at_utc"),
        lambda d: d["streams"].append(d["streams"][0]), lambda d: d["streams"][0].update(directory="../x"), lambda d: d["streams"][0].update(directory="a//b"), lambda d: d["streams"][0]["chunks"][0].update(ordinal=1),
        lambda d: d["streams"][0]["chunks"][0].update(checksum="sha256:zz"), lambda d: d["streams"][0]["chunks"][0].update(first_iteration=3), lambda d: d["streams"][0]["chunks"][0].update(records=0),
        lambda d: d["streams"][0]["fields"].append({"name": "label"}), lambda d: d["streams"][0]["storage"]["layout"].update(kind="x"), lambda d: d.update(streams=[]), lambda d: d["timing"].update(created_at_utc="2026-13-01T00:00:00Z"),
        lambda d: d["streams"][0].update(sampling_interval={"iterations": 0}), lambda d: d["records"].update(framing="x"), lambda d: d["status"].update(message="x"),
    ],
)
def test_metadata_rules(tmp_path, change):
    document = golden(tmp_path)
    metadata.validated(json.loads(json.dumps(document)))
    change(document)
    with pytest.raises(MetadataError):
        metadata.validated(document)


def test_write_and_read_back(spark, tmp_path):
    with builder(tmp_path / "r").with_user_metadata({"a": 1}).create() as writer:
        for s in states(0, 1, 2):
            writer.observe_state(s)
        final = next(states(3))
        writer.observe_state(final)
        got = writer.complete_with_final_state(final, {"reason": "end"})
    assert [g["records"] for g in got] == [4, 3]
    reader = RecordingReader(spark, tmp_path / "r")
    assert [i for i, _, _ in reader.iterate("checkpoint")] == [0, 2, 3] and reader.terminal_metadata == {"reason": "end"}
    assert reader.chunks().count() == 2 and reader.streams().count() == 2
    assert code(StorageError, lambda: builder(tmp_path / "r").create()) == "recording_exists"
    assert code(StorageError, lambda: builder(tmp_path / "r").with_user_metadata({"a": 1}).continue_existing()) == "not_running"


def test_float_bits_and_unicode(spark, tmp_path):
    value = struct.unpack(">d", bytes.fromhex("bfc1585507ca40c8"))[0]
    with builder(tmp_path / "r").create() as writer:
        s = State(SCHEMA, 0)
        s.insert_payload("population", [value])
        s.insert_payload("label", "spark → 世界")
        writer.observe_state(s)
        writer.complete()
    row = RecordingReader(spark, tmp_path / "r").read_stream("checkpoint", {"population": "array<double>", "label": "string"}).collect()[0]
    assert struct.pack(">d", row["population"][0]).hex() == "bfc1585507ca40c8" and row["label"] == "spark → 世界" and row["physical_time"] is None


def test_layouts_and_limits(tmp_path):
    for storage, want in ((Storage(64, 1 << 20), 3), (Storage(1 << 20, 1 << 20), 1), (Storage(None, 1 << 20), 3)):
        root = tmp_path / str(storage.target_bytes)
        with builder(root, storage, checkpoint=1).create() as writer:
            for s in states(0, 1, 2):
                writer.observe_state(s)
            assert writer.complete()[1]["chunk_count"] == want
    with builder(tmp_path / "q", Storage(64, 64)).create() as writer:
        s = next(states(0))
        s.insert_payload("label", "x" * 512)
        assert code(StorageError, lambda: writer.observe_state(s)) == "record_too_large"
    with builder(tmp_path / "o").create() as writer:
        for s in states(5, 5):
            writer.observe_state(s)
        assert code(StorageError, lambda: writer.observe_state(next(states(4)))) == "out_of_order_iteration"
        assert code(StorageError, lambda: writer.fail(" ")) == "blank_failure"
        writer.fail("stopped")
    with pytest.raises(RecordingNotCompleteError):
        metadata.complete(tmp_path / "o")


def test_one_writer_at_a_time(tmp_path):
    with builder(tmp_path / "r").create():
        assert code(StorageError, lambda: builder(tmp_path / "r").continue_existing()) == "writer_active"


def test_resume_from_checkpoint(tmp_path):
    with builder(tmp_path / "r").create() as writer:
        for s in states(0, 1, 2, 3):
            writer.observe_state(s)
    writer, state = builder(tmp_path / "r").open_or_resume()
    assert (state.iteration, state.payload("label")) == (2, "n2")
    assert [s["chunks"][-1]["last_iteration"] for s in writer.document["streams"]] == [2, 2]
    for s in states(3, 4):
        writer.observe_state(s)
    assert [g["records"] for g in writer.complete()] == [5, 3] and writer.document["timing"]["continuation_count"] == 1
    other, none = builder(tmp_path / "new").open_or_resume()
    assert none is None
    other.close()


def test_older_chunk_may_be_bad(tmp_path):
    with builder(tmp_path / "r", Storage(None, 1 << 20), checkpoint=1).create() as writer:
        for s in states(0, 1):
            writer.observe_state(s)
    (tmp_path / "r/streams/checkpoint/chunk-000000.jsonl").write_bytes(b"bad")
    writer, state = builder(tmp_path / "r", Storage(None, 1 << 20), checkpoint=1).continue_from_checkpoint()
    assert state.iteration == 1
    writer.close()


def test_reconcile(tmp_path):
    with builder(tmp_path / "r", Storage(None, 1 << 20), checkpoint=1).create() as writer:
        for s in states(0, 1):
            writer.observe_state(s)
    folder = tmp_path / "r/streams/checkpoint"
    document = metadata.read(tmp_path / "r")
    os.rename(folder / "chunk-000001.jsonl", folder / "chunk-000001.jsonl.tmp")
    (folder / "chunk-000002.jsonl.tmp").write_bytes(b"tail")
    reconcile(tmp_path / "r", document)
    assert sorted(p.name for p in folder.iterdir()) == ["chunk-000000.jsonl", "chunk-000001.jsonl"]
    (folder / "notes.txt").write_text("x")
    assert code(StorageError, lambda: reconcile(tmp_path / "r", document)) == "foreign_file"


def test_settings_must_match(tmp_path):
    with builder(tmp_path / "r").create():
        pass
    assert code(StorageError, lambda: builder(tmp_path / "r", checkpoint=3).continue_existing()) == "continuation_mismatch"
    assert code(StorageError, lambda: builder(tmp_path / "r").continue_from_checkpoint()) == "no_checkpoint"


def frame(spark, a, b):
    return spark.range(a, b, 1, 4).select(F.col("id").alias("iteration"), (F.col("id") / 4).alias("physical_time"), F.array(F.col("id").cast("double")).alias("population"), F.concat(F.lit("n"), "id").alias("label"))


def test_record_a_frame(spark, tmp_path):
    with builder(tmp_path / "r", Storage(256, 1 << 20), checkpoint=10).create() as writer:
        writer.record(frame(spark, 0, 50))
        writer.record(frame(spark, 40, 95), final=True)
        got = writer.complete()
    assert [g["records"] for g in got] == [95, 11] and got[0]["chunk_count"] > 10
    reader = RecordingReader(spark, tmp_path / "r")
    rows = reader.read_stream("checkpoint", {"population": "array<double>", "label": "string"}).orderBy("iteration").collect()
    assert [int(r["iteration"]) for r in rows] == [*range(0, 95, 10), 94] and rows[-1]["label"] == "n94"
    assert reader.lines("observations").filter((F.col("iteration") >= 60) & (F.col("iteration") < 62)).count() == 2
    assert not list((tmp_path / "r").rglob("*.tmp"))


def test_structured_streaming(spark, tmp_path):
    for k, (a, b) in enumerate(((0, 20), (20, 33))):
        frame(spark, a, b).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(frame(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    with builder(tmp_path / "r").create() as writer:
        query = capture(source, writer, str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
        assert [g["records"] for g in writer.complete()] == [33, 17]


def test_late_rows_are_rejected(spark, tmp_path):
    with builder(tmp_path / "r").create() as writer:
        writer.record(frame(spark, 0, 6), late="raise")
        with pytest.raises(StorageError) as e:
            writer.record(frame(spark, 3, 5).union(frame(spark, 6, 7)), late="raise")
        assert e.value.code == "out_of_order_iteration" and sorted(r["iteration"] for r in e.value.context["rejected"].collect()) == [3, 4]
        writer.record(frame(spark, 5, 8), late="raise")  # the last one taken is passed over
        assert code(StorageError, lambda: writer.record(frame(spark, 9, 10).union(frame(spark, 9, 10)), late="raise")) == "out_of_order_iteration"
        assert [g["records"] for g in writer.complete()] == [8, 4]
    assert not list((tmp_path / "r").rglob("*.tmp"))


def test_record_reads_in_several_tasks(spark, tmp_path):
    """What one task folds is numbers only, and chunks are those of states taken one by one."""
    from kymo.operators import chunks, streams

    records = streams.encoded(frame(spark, 0, 40), ["label"])
    plan = chunks.along_one_stream(records, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" not in plan
    for target in (200, None):
        with builder(tmp_path / f"a{target}", Storage(target, 1 << 20), 10).create() as a, builder(tmp_path / f"b{target}", Storage(target, 1 << 20), 10).create() as b:
            a.record(frame(spark, 0, 40))
            for s in states(*range(40)):
                s.insert_payload("population", [float(s.iteration)])
                b.observe_state(s)
            a.complete()
            b.complete()
            assert [s["chunks"] for s in a.document["streams"]] == [s["chunks"] for s in b.document["streams"]]


def test_fields_may_have_the_names_of_columns(spark, tmp_path):
    schema = StateSchema([Field("pos"), Field("stream"), Field("_pos")])
    with RecordingBuilder(tmp_path / "r", schema).with_shared_storage(Storage(512, 4096)).add_stream(StreamConfig("all", ("pos", "stream", "_pos"), 1)).create() as writer:
        s = State(schema, 4, 0.5)
        for f in schema.names():
            s.insert_payload(f, f + "!")
        writer.observe_state(s)
        writer.complete()
    row = RecordingReader(spark, tmp_path / "r").read_stream("all", {f: "string" for f in schema.names()}).collect()[0].asDict()
    assert (row["pos"], row["stream"], row["_pos"], row["__pos"], row["_stream"], int(row["iteration"])) == ("pos!", "stream!", "_pos!", 0, "all", 4)


def test_decoders_on_the_driver(spark, tmp_path):
    golden(tmp_path)
    reader = RecordingReader(spark, tmp_path, "elsewhere-jsonl")
    rows = list(reader.iterate("signal", {"population": sum, "label": str.upper}))
    assert [(i, v["population"], v["label"]) for i, _, v in rows] == [(0, 3.0, "START"), (2, 3.0, "LATER")]
    assert reader.latest_state("signal", [("population", len), ("label", len)])[2] == {"population": 2, "label": 5}
    assert code(DecoderError, lambda: reader.latest_state("signal", [("label", len), ("label", len)])) == "duplicate_decoder"
    assert code(DecoderError, lambda: reader.latest_state("signal", {"label": len})) == "missing_decoder"
    assert code(DecoderError, lambda: reader.latest_state("signal", {"label": int, "population": len})) == "decoder_failed"


def test_the_sinks_guard_outlives_it(spark, tmp_path):
    build = builder(tmp_path / "r")
    with build.create() as writer:
        RecordingSink(writer)(frame(spark, 0, 5), 0)
    with build.continue_existing() as writer:
        again = RecordingSink(writer)
        again(frame(spark, 0, 5), 0)  # ended before
        with pytest.raises(StorageError):
            again(frame(spark, 4, 8), 1)
        again._write(batch=1, done=False)  # as a crash within the batch leaves it
        writer.record(frame(spark, 5, 7))
    with build.continue_existing() as writer:
        RecordingSink(writer)(frame(spark, 5, 9), 1)
        assert [g["records"] for g in writer.complete()] == [9, 5]
