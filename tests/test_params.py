import json

import pytest

from kymo.errors import ConfigurationError
from kymo.functions.strict_json import conflict, flatten, parse_strict, pointer_of, pointer_segments, rebuild, same_json
from kymo.plans.params import ParameterSpace, Sweep


def cartesian(**axes):
    return Sweep.parse({"mode": "cartesian", "axes": axes})


def code(call):
    with pytest.raises(ConfigurationError) as e:
        call()
    return e.value.code


def test_strict_json():
    assert list(parse_strict('{"b": 1, "a": 2}')) == ["b", "a"]
    assert code(lambda: parse_strict('[{"a": {"b": 1, "b": 2}}]')) == "duplicate_key"
    for text in ("NaN", "[Infinity]", "1e400"):
        assert code(lambda t=text: parse_strict(t)) == "non_finite"
    assert not same_json(300, 15.0) and not same_json(True, 1) and same_json({"a": [1, {"b": None}]}, {"a": [1, {"b": None}]})


def test_pointers():
    assert pointer_segments("/a~1b/~0c") == ("a/b", "~c") and pointer_of(("a/b", "~c")) == "/a~1b/~0c"
    assert pointer_segments("a") is None and pointer_segments("/a~2") is None and pointer_segments("/a~") is None
    assert conflict(("a",), ("a", "b")) and not conflict(("a", "b"), ("a", "c"))
    doc = {"a": {"b": [1, {"c": 2}], "d": {}}, "e": None}
    assert list(flatten(doc)) == [("a", "b"), ("a", "d"), ("e",)] and rebuild(flatten(doc)) == doc


def test_cartesian_order_last_axis_fastest(spark):
    space = ParameterSpace({"dt": 0.04}, cartesian(rate={"values": [12.0, 15.0]}, lot={"values": [3, 8, 21]}))
    got = [(t.value("/rate"), t.value("/lot")) for t in space.tasks()]
    assert got == [(12.0, 3), (12.0, 8), (12.0, 21), (15.0, 3), (15.0, 8), (15.0, 21)]
    rows = [json.loads(r["document"]) for r in space.frame(spark).orderBy("ordinal").collect()]
    assert rows == [t.to_json() for t in space.tasks()]
    assert space.facts() == {"fixed_parameter_count": 1, "sweep_parameter_count": 2, "parameter_count": 3, "task_count": 6}
    assert space.matching(spark, "/rate", 15.0).count() == 3 and space.matching(spark, "/rate", 15).count() == 0
    assert code(lambda: space.unique_matching("/lot", 3)) == "ambiguous_match"
    assert code(lambda: space.unique_matching("/lot", 9)) == "no_match"
    assert code(lambda: space.matching(spark, "/dt", 0.04)) == "not_selectable"
    assert code(lambda: space.task(6)) == "ordinal_out_of_range"


def test_nested_and_structured_axes(spark):
    nested = ParameterSpace({}, cartesian(tariff={"duty": {"values": [0.1, 0.3]}}, freight={"share": {"values": [0.4, 0.9]}}))
    assert [t.to_json() for t in nested.tasks()][1] == {"tariff": {"duty": 0.1}, "freight": {"share": 0.9}}
    parts = [{"name": "a", "weight": 1}, {"weight": 2, "name": "b"}]
    space = ParameterSpace({}, cartesian(parts={"values": parts}, size={"values": [4, 9]}))
    assert space.sweep_keys() == ["/parts", "/size"] and space.matching(spark, "/parts", parts[1]).count() == 2
    assert [t.keys() for t in space.tasks()] == [["/parts/name", "/parts/weight", "/size"]] * 4


def test_cases():
    space = ParameterSpace({}, Sweep.parse({"mode": "cases", "cases": [{"t": 5.0, "d": 0.6}, {"d": 0.7, "t": 6.0}]}))
    assert [t.items() for t in space.tasks()] == [[("/t", 5.0), ("/d", 0.6)], [("/t", 6.0), ("/d", 0.7)]]
    assert space.unique_matching("/t", 6.0).ordinal == 1


def test_no_axes_is_one_task(spark):
    space = ParameterSpace({}, cartesian())
    assert space.task_count == 1 and space.frame(spark).collect()[0]["document"] == "{}"


@pytest.mark.parametrize(
    "sweep,want",
    [
        ({"mode": "cartesian", "axes": {"a": {"values": []}}}, "empty_axis"),
        ({"mode": "cartesian", "axes": {"a": {}}}, "empty_axis"),
        ({"mode": "cartesian", "axes": {"a": {"values": [1]}}, "x": 1}, "invalid_sweep"),
        ({"mode": "cartesian", "axes": {" ": {"values": [1]}}}, "blank_segment"),
        ({"mode": "cartesian", "axes": {"a": {"values": [{"b": 1}, {"c": 1}]}}}, "inconsistent_candidates"),
        ({"mode": "cases", "cases": []}, "empty_cases"),
        ({"mode": "cases", "cases": [{"a": 1}, {"b": 1}]}, "inconsistent_cases"),
        ({"mode": "cartesian", "axes": [1]}, "not_an_object"),
    ],
)
def test_rejected_sweeps(sweep, want):
    assert code(lambda: Sweep.parse(sweep)) == want


def test_lookups_and_export(tmp_path):
    (tmp_path / "config").mkdir()
    for name, text in (("fixed", '{"pricing": {"rule": "tiered", "n": 3}}'), ("sweep", '{"mode": "cartesian", "axes": {"mu": {"values": [1, 2]}}}'), ("paths", '{"out": "data/../x", "abs": "/y"}')):
        (tmp_path / "config" / f"{name}.json").write_text(text)
    space = ParameterSpace.load(tmp_path)
    task = space.task(1)
    assert task.value("/pricing") == {"rule": "tiered", "n": 3} and task.contains("/pricing") and not task.contains("/pric")
    assert task.decode_values(("/pricing/rule", str), ("/mu", float)) == ("tiered", 2.0)
    assert code(lambda: task.decode_value("/pricing/rule", int)) == "wrong_type" and code(lambda: task.require_value("/q")) == "missing_parameter"
    assert space.paths.resolve_path("out") == tmp_path / "x" and str(space.paths.resolve_path("abs")) == "/y"
    task.write_resolved_json(tmp_path / "a.json")
    task.write_resolved_json(tmp_path / "a.json")
    assert code(lambda: space.task(0).write_resolved_json(tmp_path / "a.json")) == "export_conflict"
    ParameterSpace.write_source_config(tmp_path, tmp_path / "copy")
    assert (tmp_path / "copy" / "paths.json").read_bytes() == (tmp_path / "config" / "paths.json").read_bytes()
    assert code(lambda: ParameterSpace.write_source_config(tmp_path, tmp_path / "config")) == "export_conflict"
    assert code(lambda: ParameterSpace({"mu": 1}, space.sweep)) == "fixed_sweep_overlap"
    (tmp_path / "config" / "paths.json").write_text('{"out": 3}')
    assert code(lambda: ParameterSpace.load(tmp_path)) == "invalid_path"
