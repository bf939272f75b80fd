import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kymo.errors import PayloadInsertError, SeriesError, StateError, StorageError
from kymo.operators import chunks, series, state, streams
from kymo.operators.state import Field, State, StateSchema


def schema():
    return StateSchema([Field("population", "Counts"), Field("label")])


def test_schema_documents():
    s = StateSchema.load(b'{"fields":[{"name":" a ","description":"x"},{"name":"b"}]}')
    assert s.names() == ["a", "b"] and StateSchema.load(s.to_json_template()) == s and "a" in s and len(StateSchema.load('{"fields":[]}')) == 0
    for bad in ('{"fields":[{"name":" "}]}', '{"fields":[{"name":"a"},{"name":"a "}]}', '{"fields":[{"name":"a","x":1}]}', '{"fields":[],"y":1}', '{"fields":[{"name":"a","name":"b"}]}'):
        with pytest.raises(StateError):
            StateSchema.load(bad)


def test_state_payloads():
    s = State(schema())
    assert s.insert_payload("label", "a") is None and s.insert_payload("label", "b") == "a"
    with pytest.raises(PayloadInsertError) as e:
        s.insert_payload("label", 3)
    assert e.value.value == 3 and s.payload("label", str) == "b"
    with pytest.raises(StateError) as e:
        s.payload("label", int)
    assert e.value.code == "type_mismatch"
    assert s.take_payload("label") == "b" and not s.contains_payload("label") and s.payload_has_type("label", str)
    sibling = s.clone_structure_without_payloads()
    with pytest.raises(PayloadInsertError):
        sibling.insert_payload("label", 1)
    s.insert_payload("population", [1.0])
    copied = s.clone()
    copied.payload("population").append(2.0)
    assert s.payload("population") == [1.0] and s.populated_field_count == 1 and s.declared_field_count == 2
    with pytest.raises(StateError):
        s.payloads(("population", list), ("population", list))


def test_time():
    s = State(schema(), 3, 0.5)
    s.advance_simulation_time(0.25)
    assert (s.iteration, s.physical_time) == (4, 0.75)
    for delta in (math.inf, math.nan):
        with pytest.raises(StateError):
            s.advance_simulation_time(delta)
    assert (s.iteration, s.physical_time) == (4, 0.75)
    with pytest.raises(StateError):
        State(schema(), 0).advance_simulation_time(1.0)
    with pytest.raises(StateError):
        State(schema(), 2**64 - 1).advance_simulation_time()
    with pytest.raises(StateError):
        State(schema(), 0, math.nan)


def test_time_columns(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "iteration bigint, physical_time double")
    assert [r[0] for r in state.advance(df).select(F.col("iteration").cast("int")).orderBy("iteration").collect()] == [2, 3]
    with pytest.raises(Exception, match="invalid_time_advance"):
        state.advance(df, F.lit(1.0)).collect()
    top = spark.createDataFrame([("18446744073709551615", 0.0)], "i string, physical_time double").select(F.col("i").cast("decimal(20,0)").alias("iteration"), "physical_time")
    with pytest.raises(Exception, match="iteration_overflow"):
        state.advance(top).collect()


def test_series(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("b", 2, 3.0)], "k string, iteration bigint, v double")
    more = spark.createDataFrame([("a", 6, 4.0), ("b", 2, 5.0)], "k string, iteration bigint, v double")
    with pytest.raises(SeriesError) as e:
        series.append(rows, more, ["k"])
    assert e.value.rejected.collect() == [("b", 2, 5.0)]
    assert series.append(rows, more.filter("k = 'a'"), ["k"]).count() == 4
    with pytest.raises(SeriesError):
        series.append(rows, more.select("k", "iteration"), ["k"])
    assert sorted(series.latest_state(rows, ["k"]).collect()) == [("a", 5, 2.0), ("b", 2, 3.0)]
    assert sorted(r["iteration"] for r in series.state_at(rows, 1, ["k"]).collect()) == [5]
    assert series.without_last(rows, ["k"]).collect() == [("a", 1, 1.0)]
    assert series.order_violations(rows, ["k"], [F.desc("v")]).collect()[0]["iteration"] == 1
    empty = rows.limit(0)
    assert series.latest_state(empty, ["k"]).count() == 0 and series.append(empty, rows, ["k"]).count() == 3


def brute_chunks(sizes, target):
    out, ordinal, held = [], 0, 0
    for n in sizes:
        if held and held + n > target:
            ordinal, held = ordinal + 1, 0
        out.append(ordinal)
        held += n
        if held >= target:
            ordinal, held = ordinal + 1, 0
    return out


def test_rollover_is_the_fold():
    rng = np.random.default_rng(1)
    for target in (1, 5, 64, 1000):
        sizes = rng.integers(1, 90, 300)
        want = brute_chunks(sizes.tolist(), target)
        got, ordinal, held = chunks.chunk_ordinals(sizes, target)
        assert got.tolist() == want
        a, o, h = chunks.chunk_ordinals(sizes[:137], target)
        b, o, h = chunks.chunk_ordinals(sizes[137:], target, o, h)
        assert [*a.tolist(), *b.tolist()] == want and (o, h) == (ordinal, held)


def test_streams(spark):
    s = schema()
    assert streams.projected(s, ["label", "population"]) == ["population", "label"]
    for wanted, code in ((["x"], "unknown_stream_field"), (["label", "label"], "duplicate_stream_field")):
        with pytest.raises(StorageError) as e:
            streams.projected(s, wanted)
        assert e.value.code == code
    df = spark.createDataFrame([(i, float(i), [1.0 * i], "x\"y") for i in range(4)], "iteration bigint, physical_time double, population array<double>, label string")
    assert [r[0] for r in streams.sampled(df, 2, final=True).select("iteration").orderBy("iteration").collect()] == [0, 2, 3]
    line = streams.encoded(df, ["population", "label"]).orderBy("iteration").collect()[1]
    assert line["line"] == '{"iteration":1,"physical_time":1.0,"values":[[1.0],"x\\"y"]}' and line["bytes"] == len(line["line"]) + 1
    hole = df.withColumn("label", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="missing_payload"):
        streams.encoded(hole, ["label"]).collect()
    assert streams.StreamConfig.parse({"name": "a", "fields": ["x"], "sampling_interval": {"iterations": 10}}).interval == 10
    for bad in (0, {"iterations": 0}, {"n": 1}, True):
        with pytest.raises(StorageError):
            streams.StreamConfig.parse({"name": "a", "fields": [], "sampling_interval": bad})


def test_series_accessors(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "k string, iteration bigint, v double")
    assert [r["v"] for r in series.ordered(df, ["k"]).collect()] == [2.0, 1.0, 3.0]
    assert [tuple(r) for r in series.iterations(df, ["k"]).collect()] == [("a", 1), ("a", 3), ("b", 2)]
    assert sorted(tuple(r) for r in series.lengths(df, ["k"]).collect()) == [("a", 2, 1, 3), ("b", 1, 2, 2)]
    empty = series.cleared(df)
    assert empty.schema == df.schema and series.is_empty(empty) and not series.is_empty(df) and series.lengths(empty, ["k"]).count() == 0
    assert spark.sql(f"SELECT sum(v) FROM {series.view(df, 'some_series')}").first()[0] == 6.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 150))
def test_rollover_of_any_sizes(sizes, target):
    got, _, _ = chunks.chunk_ordinals(np.array(sizes, np.int64), target)
    want, ordinal, held = [], 0, 0
    for n in sizes:
        if held and held + n > target:
            ordinal, held = ordinal + 1, 0
        want.append(ordinal)
        held += n
        if held >= target:
            ordinal, held = ordinal + 1, 0
    assert got.tolist() == want
