import io
import json
import time

import pytest

from kymo.errors import ProvenanceError, RuntimePlanError
from kymo.plans.params import ParameterSpace, Sweep
from kymo.plans.provenance import Artifact, ExecutionScope, RngRecord, load_artifact, persist_artifact
from kymo.plans.runtime import FINISH_ACTIVE, Cancelled, Phase, Plan, Selector, activity_tasks, progress_summary, progress_tasks, shown

SPACE = ParameterSpace({"shape": [2, 3]}, Sweep.parse({"mode": "cartesian", "axes": {"mu": {"values": [0.1, 0.2, 0.3]}}}))


def code(call, error=RuntimePlanError):
    with pytest.raises(error) as e:
        call()
    return e.value.code


def advance(context):
    for i in range(context.target + 1):
        context.set_iteration(i)


def test_labels_selection_and_plan(spark, tmp_path):
    phase = Phase(1, "simulate", progress_tasks(SPACE, "run", 3, advance), delay_per_task=0.5)
    assert [t.label for t in phase.tasks] == ["run [mu=0.1]", "run [mu=0.2]", "run [mu=0.3]"]
    plan = Plan([phase, Phase(2, "check", activity_tasks(SPACE, "check", None), (1,))])
    assert plan.unique_task(Selector(phase=1, parameters=(("/mu", 0.2),))).ordinal == 1
    assert code(lambda: plan.unique_task(Selector(kind="run"))) == "ambiguous_task" and code(lambda: plan.unique_task(Selector(kind="x"))) == "no_task"
    document = plan.to_json()
    assert [t["release_offset_ns"] for t in document["phases"][0]["tasks"]] == [0, 500_000_000, 1_000_000_000]
    assert [t["delay_rank"] for t in document["phases"][1]["tasks"]] == [None] * 3
    plan.write_json(tmp_path / "plan.json")
    plan.write_json(tmp_path / "plan.json")
    (tmp_path / "plan.json").write_text("{}")
    assert code(lambda: plan.write_json(tmp_path / "plan.json")) == "plan_conflict"
    rows = progress_summary(plan.tasks(spark)).orderBy("phase").collect()
    assert [(r["total"], r["pending"], r["reused"], r["success"]) for r in rows] == [(3, 3, 0, False), (3, 0, 3, True)]
    assert shown([1, 2]).startswith("<array:2:") and shown("a") == '"a"'


def test_phase_rules():
    tasks = activity_tasks(SPACE, "a", lambda c: None)
    assert code(lambda: Phase(1, " ", tasks)) == "blank_label" and code(lambda: Phase(1, "x", [])) == "no_tasks"
    assert code(lambda: Phase(1, "x", tasks, max_active_tasks=0)) == "invalid_limit" and code(lambda: Phase(1, "x", tasks, task_timeout=0)) == "invalid_duration"
    assert code(lambda: Phase(1, "x", tasks, (1,))) == "invalid_dependency" and code(lambda: Phase(1, "x", tasks + tasks)) == "duplicate_task"
    assert code(lambda: Phase(1, "x", activity_tasks(SPACE, "a", None, ["/shape"]))) == "label_collision"
    assert code(lambda: Phase(1, "x", activity_tasks(SPACE, "a", None, ["/q"]))) == "invalid_display_key"


def phases(*edges):
    return Plan([Phase(i, f"p{i}", activity_tasks(SPACE, f"k{i}", lambda c: None), d) for i, d in edges])


def test_order_and_closure():
    plan = phases((3, (1, 2)), (1, ()), (2, (1,)), (4, (3,)), (5, ()))
    assert plan.order([1, 2, 3, 4, 5]) == [1, 2, 3, 4, 5] and plan.closure([3]) == [1, 2, 3]
    assert plan.closure([4], satisfied=lambda d: d == 3) == [4]
    assert code(lambda: phases((1, (2,)), (2, (1,)))) == "dependency_cycle" and code(lambda: phases((1, (7,)))) == "unknown_dependency"
    assert code(lambda: plan.run([4])) == "unsatisfied_dependency"
    assert [s.id for s in plan.run_with_dependencies([3])] == [1, 2, 3]


def test_run_writes_a_record(tmp_path):
    plan = Plan([Phase(1, "a", progress_tasks(SPACE, "run", 2, advance), max_active_tasks=2, requires_confirmation=True), Phase(2, "b", activity_tasks(SPACE, "z", None), (1,))])
    done = plan.run(record=tmp_path / "record.json", confirm=io.StringIO(" YES \n"))
    record = json.loads((tmp_path / "record.json").read_text())
    assert all(s.success for s in done) and record["status"] == "completed" and record["task_count"] == 6
    assert [t["final_iteration"] for t in record["phases"][0]["tasks"]] == [2, 2, 2] and record["phases"][1]["progress"]["reused"] == 3
    assert code(lambda: plan.run(confirm=io.StringIO(""))) == "confirmation_ended" and code(lambda: plan.run(confirm=io.StringIO("no\n"))) == "confirmation_refused"


def test_failure_policies():
    def work(context):
        if context.configuration.value("/mu") == 0.1:
            time.sleep(0.1)
            raise ValueError("bad")
        for _ in range(200):
            if not context.should_continue():
                raise Cancelled
            time.sleep(0.005)

    fast = Plan([Phase(1, "a", activity_tasks(SPACE, "k", work), max_active_tasks=2)]).run()[0].counts
    assert (fast["failed"], fast["cancelled"], fast["skipped"]) == (1, 1, 1)
    finish = Plan([Phase(1, "a", activity_tasks(SPACE, "k", work), max_active_tasks=2, failure_policy=FINISH_ACTIVE)]).run()[0].counts
    assert (finish["failed"], finish["completed"], finish["skipped"]) == (1, 1, 1)
    missed = Plan([Phase(1, "a", progress_tasks(SPACE, "k", 5, lambda c: c.set_iteration(3)))]).run()[0]
    assert missed.counts["failed"] == 3 and not missed.success
    late = Plan([Phase(1, "a", activity_tasks(SPACE, "k", lambda c: time.sleep(0.05)), task_timeout=0.01)]).run()[0].counts
    assert (late["failed"], late["skipped"]) == (1, 2)
    assert Plan([Phase(1, "a", activity_tasks(SPACE, "k", lambda c: c.set_iteration(1)))]).run()[0].counts["failed"] == 1


def test_rng_records():
    own = RngRecord("sampling", "pcg64", "1", "decimal", "42", {"streams": 3})
    user = {"a": 1}
    own.insert_into(user)
    assert RngRecord.find(user, "sampling") == own and RngRecord.find(user, "x") is None and user["a"] == 1
    assert code(lambda: own.insert_into(user), ProvenanceError) == "duplicate_namespace"
    assert code(lambda: RngRecord("a", " ", "1", "x", "y"), ProvenanceError) == "empty_field"
    assert code(lambda: RngRecord.find({"rng_records": {"b": own.to_json()}}, "b"), ProvenanceError) == "namespace_mismatch"


def test_scopes_and_artifacts(tmp_path):
    scope = ExecutionScope.create_named(tmp_path, "run")
    assert code(lambda: ExecutionScope.create_named(tmp_path, "run"), ProvenanceError) == "scope_exists"
    assert code(lambda: ExecutionScope.create_named(tmp_path, "../x"), ProvenanceError) == "unsafe_name"
    assert ExecutionScope.create_generated(tmp_path).directory != ExecutionScope.create_generated(tmp_path).directory
    assert scope.task_recording_directory(7).name == "task-000007" and scope.named_task_recording_directory("a/b") == scope.directory / "a/b"
    assert ExecutionScope.open_existing(scope.directory).created_at_utc is None and ExecutionScope.open_or_create(tmp_path / "d").directory.is_dir()
    own, created = persist_artifact(scope, "input", "bin", b"abc")
    assert created and persist_artifact(scope, "input", "bin", b"abc") == (own, False)
    assert load_artifact(scope.directory, own) == b"abc"
    (scope.directory / own.path).write_bytes(b"abd")
    assert code(lambda: load_artifact(scope.directory, own), ProvenanceError) == "digest_mismatch"
    assert code(lambda: load_artifact(scope.directory, Artifact(own.sha256, "../x")), ProvenanceError) == "invalid_descriptor"
    assert code(lambda: persist_artifact(scope, "a/b", "bin", b""), ProvenanceError) == "unsafe_name"


def test_cancellation_reaches_running_tasks_and_their_jobs(spark):
    import threading
    import time

    cancel, started = threading.Event(), threading.Event()
    seen = []

    def slow_job(context):
        started.set()
        spark.range(0, 8, 1, 4).rdd.foreach(lambda _: time.sleep(60))

    def loop(context):
        while context.should_continue():
            time.sleep(0.01)
        seen.append(context.id)
        raise Cancelled

    space = ParameterSpace({}, Sweep.parse({"mode": "cartesian", "axes": {"k": {"values": [0, 1]}}}))
    tasks = activity_tasks(space, "t", lambda c: (slow_job if c.configuration.value("/k") else loop)(c))
    threading.Thread(target=lambda: (started.wait(30), time.sleep(1), cancel.set())).start()
    began = time.monotonic()
    summary = Plan([Phase(1, "both", tasks, max_active_tasks=2)]).run(cancel=cancel)[0]
    assert time.monotonic() - began < 40 and seen == ["t:0"] and summary.counts["cancelled"] == 2


def test_selector_over_a_table(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2)], "phase int, kind string, `/k` int")
    assert Selector(1, "a").rows(rows).count() == 1 and Selector(parameters=(("/k", 1),)).rows(rows).count() == 2 and Selector().rows(rows).count() == 3
