from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.operators import state

STATES = "run_id string, dag_id string, task_id string, state string"
ATTEMPTS = "run_id string, dag_id string, task_id string, attempt int, started_at long, finished_at long, envelope string"
OK, BAD = '{"ok": true, "result": {"attempts": 1}}', '{"ok": false, "error": "ConnectionError: no"}'


def states(spark, found, run="r", dag="d"):
    return spark.createDataFrame([(run, dag, t, s) for t, s in found.items()], STATES)


def ready(spark, found, edges=(("a", "b"),)):
    e = spark.createDataFrame([("d", *x) for x in edges], "dag_id string, upstream string, downstream string")
    return sorted(r["task_id"] for r in state.ready_tasks(states(spark, found), e).collect())


def test_ready_waits_for_success(spark):
    assert ready(spark, {"a": None, "b": None}) == ["a"]
    assert ready(spark, {"a": "running", "b": "pending"}) == []
    assert ready(spark, {"a": "success", "b": "pending"}) == ["b"]
    assert ready(spark, {"a": "failed", "b": "pending"}) == []


def test_a_task_without_a_row_is_ready_like_a_pending_one(spark):
    assert ready(spark, {"a": "success"}) == ["b"]
    assert ready(spark, {"a": "running"}) == []
    assert ready(spark, {"a": "success", "b": "success"}, (("a", "c"), ("b", "c"))) == ["c"]
    assert ready(spark, {"a": "success", "b": "failed"}, (("a", "c"), ("b", "c"))) == []


def test_ready_needs_every_parent(spark):
    edges = (("a", "c"), ("b", "c"), ("b", "c"))
    assert ready(spark, {"a": "success", "b": "running", "c": "pending"}, edges) == []
    assert ready(spark, {"a": "success", "b": "success", "c": "pending"}, edges) == ["c"]


def attempts(spark, envelopes, task="t"):
    rows = [("r", "d", task, i, 10 * i, 10 * i + 5, e) for i, e in enumerate(envelopes, 1)]
    return spark.createDataFrame(rows, ATTEMPTS)


def outcome(spark, envelopes, retries):
    limits = spark.createDataFrame([("d", "t", retries)], "dag_id string, task_id string, retries int")
    row = state.retry_outcome(state.read_envelopes(attempts(spark, envelopes)), limits).first()
    return row["state"], row["try_number"]


def test_retries_until_success(spark):
    assert outcome(spark, [BAD, BAD, OK], 3) == ("success", 3)


def test_a_task_without_a_limit_has_no_retry(spark):
    limits = spark.createDataFrame([("d", "other", 3)], "dag_id string, task_id string, retries int")
    row = state.retry_outcome(state.read_envelopes(attempts(spark, [BAD, OK])), limits).first()
    assert (row["state"], row["try_number"]) == ("failed", 1)


def test_only_the_resumed_run_is_reset(spark):
    both = states(spark, {"a": "running", "b": "success"}).unionAll(states(spark, {"a": "running"}, run="other"))
    resumed = spark.createDataFrame([("r",)], "run_id string")
    got = {(r["run_id"], r["task_id"]): r["state"] for r in state.reset_orphans(both, runs=resumed).collect()}
    assert got == {("r", "a"): "pending", ("r", "b"): "success", ("other", "a"): "running"}
    assert {r["state"] for r in state.reset_orphans(both).collect()} == {"pending", "success"}


def test_retries_are_bounded(spark):
    assert outcome(spark, [BAD, BAD, OK], 1) == ("failed", 2)


def test_attempts_after_a_success_do_not_count(spark):
    assert outcome(spark, [OK, BAD], 3) == ("success", 1)


def test_killed_process_is_a_failure(spark):
    rows = state.read_envelopes(attempts(spark, [None]), exit_code=F.lit(9), log=F.lit("x" * 3000))
    row = rows.first()
    assert row["ok"] is False and "without writing a result" in row["error"] and "exited 9" in row["error"]
    assert len(row["traceback"]) == 2000
    settled = state.settle(rows).first()
    assert settled["state"] == "failed" and settled["error"] == row["error"] and settled["result"] is None


def test_settle_takes_the_newest_and_clears_the_error(spark):
    row = state.settle(state.read_envelopes(attempts(spark, [BAD, OK]))).first()
    assert (row["state"], row["error"], row["result"]) == ("success", None, '{"attempts":1}')
    row = state.settle(state.read_envelopes(attempts(spark, [OK, '{"ok": false}']))).first()
    assert (row["state"], row["error"], row["result"]) == ("failed", "unknown error", None)


def test_outcome_of_runs(spark):
    runs = spark.createDataFrame([("good",), ("bad",), ("empty",)], "run_id string")
    rows = states(spark, {"a": "success", "b": "success"}, "good").unionByName(
        states(spark, {"a": "success", "b": "upstream_failed"}, "bad")
    )
    got = {r["run_id"]: r["outcome"] for r in state.run_outcome(runs, rows).collect()}
    assert got == {"good": "success", "bad": "failed", "empty": "success"}


def test_init_keeps_rows_that_exist(spark):
    runs = spark.createDataFrame([("r", "d")], "run_id string, dag_id string")
    tasks = spark.createDataFrame([("d", "a"), ("d", "b")], "dag_id string, task_id string")
    old = spark.createDataFrame([("r", "a", "success", 2)], "run_id string, task_id string, state string, try_number long")
    got = {r["task_id"]: (r["state"], r["try_number"]) for r in state.init_tasks(runs, tasks, old).collect()}
    assert got == {"a": ("success", 2), "b": ("pending", 0)}


def test_upstream_results_reach_grandparents_and_nobody_else(spark):
    edges = spark.createDataFrame(
        [("d", "a", "b"), ("d", "b", "c"), ("d", "a", "x")], "dag_id string, upstream string, downstream string"
    )
    run_tasks = spark.createDataFrame([("r", "d", t) for t in "abcx"], "run_id string, dag_id string, task_id string")
    results = spark.createDataFrame([("r", "a", "1"), ("r", "x", "9")], "run_id string, task_id string, result string")
    got = {(r["task_id"], r["ancestor"]): r["result"] for r in state.upstream_results(run_tasks, edges, results).collect()}
    assert got == {("b", "a"): "1", ("c", "a"): "1", ("c", "b"): None, ("x", "a"): "1"}


def test_first_of_duplicates_wins(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, place int")
    assert [tuple(r) for r in state.duplicate_ids(rows, ["id"], ["place"]).collect()] == [("a", 2, 1)]


RUNS = "run_id string, state string, created_at long, finished_at long"


def test_reap_closes_old_running_runs(spark):
    runs = spark.createDataFrame(
        [("old", "running", 0, None), ("edge", "running", 100, None), ("done", "success", 0, 5)], RUNS
    )
    rows = spark.createDataFrame(
        [("old", "a", "running", None), ("old", "b", "pending", None), ("edge", "a", "running", None)],
        "run_id string, task_id string, state string, finished_at long",
    )
    new_runs, new_states, report = state.reap(runs, rows, F.lit(1000), 900)
    assert {r["run_id"]: r["state"] for r in new_runs.collect()} == {"old": "failed", "edge": "running", "done": "success"}
    got = {(r["run_id"], r["task_id"]): (r["state"], r["error"]) for r in new_states.collect()}
    assert got[("old", "a")] == ("failed", fixed.REAPED)
    assert got[("old", "b")] == ("pending", None) and got[("edge", "a")] == ("running", None)
    assert [tuple(r) for r in report.collect()] == [("old", 1)]


def test_reap_can_look_at_the_newest_only(spark):
    runs = spark.createDataFrame([(f"r{i}", "running", i, None) for i in range(5)], RUNS)
    none = spark.createDataFrame([], "run_id string, task_id string, state string, finished_at long")
    new_runs, _, _ = state.reap(runs, none, F.lit(10_000), 900, newest=2)
    assert {r["run_id"] for r in new_runs.filter("state = 'failed'").collect()} == {"r3", "r4"}


def test_reset_orphans(spark):
    rows = states(spark, {"a": "success", "b": "running", "c": "failed"})
    assert {r["task_id"]: r["state"] for r in state.reset_orphans(rows).collect()} == {
        "a": "success", "b": "pending", "c": "failed",
    }
    both = state.reset_orphans(rows, ("running", "failed"))
    assert both.filter("state = 'pending'").count() == 2


def test_tick_stamps_before_it_starts_and_does_not_repeat(spark):
    s = spark.createDataFrame(
        [("hourly", "@hourly", None), ("fresh", "@hourly", 990.0), ("manual", None, None)],
        "dag_id string, schedule string, last_run_at double",
    )
    stamped, started = state.tick(s, F.lit(1000.0))
    assert [r["dag_id"] for r in started.collect()] == ["hourly"]
    assert {r["dag_id"]: r["last_run_at"] for r in stamped.collect()} == {"hourly": 1000.0, "fresh": 990.0}
    again = s.drop("last_run_at").join(stamped, "dag_id", "left")
    assert state.tick(again, F.lit(1001.0))[1].isEmpty()


def advance(spark, applied, run_states, **kw):
    rev = spark.createDataFrame([("app", "new", applied)], "app_name string, desired string, applied string")
    runs = spark.createDataFrame([("app", d, s) for d, s in run_states], "app_name string, dag_id string, state string")
    r = state.revision_advance(rev, runs, **kw).first()
    return r["action"], r["applied"], r["in_sync"], r["n_runs"]


def test_revision_moves_only_after_success(spark):
    assert advance(spark, None, [("d", "success")]) == ("synced", "new", True, 1)
    assert advance(spark, "old", [("d", "success"), ("e", "failed")]) == ("failed", "old", False, 2)
    assert advance(spark, "new", [("d", "failed")]) == ("none", "new", True, 0)
    assert advance(spark, "new", [("d", "success")], force=True) == ("synced", "new", True, 1)


def test_revision_with_a_dag_list(spark):
    only = spark.createDataFrame([("d",)], "dag_id string")
    assert advance(spark, "old", [("d", "success"), ("e", "failed")], only=only) == ("synced", "new", True, 1)
    nothing = spark.createDataFrame([("z",)], "dag_id string")
    assert advance(spark, "old", [("e", "failed")], only=nothing) == ("synced", "new", True, 0)
    assert advance(spark, "old", [], require_runs=True) == ("failed", "old", False, 0)


def test_detail_of_a_run_without_tasks(spark):
    runs = spark.createDataFrame([("r", "d")], "run_id string, dag_id string")
    rows = spark.createDataFrame(
        [],
        "run_id string, task_id string, state string, try_number int, started_at long, finished_at long, error string, result string",
    )
    assert state.run_detail(runs, rows).first()["tasks"] is None


def test_catalogue_counts_and_sorts(spark):
    dags = spark.createDataFrame([("d", "text", None), ("e", "", "@daily")], "dag_id string, description string, schedule string")
    tasks = spark.createDataFrame([("d", "b"), ("d", "a")], "dag_id string, task_id string")
    got = {r["dag_id"]: (r["schedule"], r["n_tasks"], r["tasks"]) for r in state.catalogue(dags, tasks).collect()}
    assert got == {"d": ("-", 2, ["a", "b"]), "e": ("@daily", 0, [])}
