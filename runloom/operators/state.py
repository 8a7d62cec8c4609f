"""Run and task state as batch jobs: every function takes tables and returns tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators.graph import ancestors
from runloom.operators.keyed import latest, nest, spread, upsert

ENVELOPE = "ok boolean, result string, error string, traceback string"


def read_envelopes(
    attempts: DataFrame, executor: str = "local", exit_code: Column | None = None, log: Column | None = None
) -> DataFrame:
    """Decode ``envelope`` into ok / result / error / traceback.

    No envelope means the process died: a failure that says so, with the log's tail.
    """
    code = F.lit("?") if exit_code is None else F.coalesce(exit_code.cast("string"), F.lit("?"))
    died = F.struct(
        F.lit(False).alias("ok"),
        F.lit(None).cast("string").alias("result"),
        F.format_string(fixed.NO_RESULT, F.lit(executor), code).alias("error"),
        S.log_tail(F.lit("") if log is None else log).alias("traceback"),
    )
    return attempts.withColumn("_e", F.coalesce(F.from_json("envelope", ENVELOPE), died)).select(
        *attempts.columns, "_e.*"
    )


def settle(results: DataFrame) -> DataFrame:
    """Task state from decoded attempts: the newest by (finished_at, attempt) decides."""
    ok = F.coalesce("ok", F.lit(False))
    rows = results.select(
        "run_id",
        "task_id",
        "attempt",
        "started_at",
        "finished_at",
        F.when(ok, fixed.SUCCESS).otherwise(fixed.FAILED).alias("state"),
        F.when(ok, F.coalesce("result", F.lit("null"))).alias("result"),
        F.when(~ok, F.coalesce("error", F.lit(fixed.UNKNOWN_ERROR))).alias("error"),
    )
    return latest(rows, ["run_id", "task_id"], ["finished_at", "attempt"])


def retry_outcome(results: DataFrame, limits: DataFrame) -> DataFrame:
    """Attempts end at the first success or after ``retries + 1``; the last one decides.

    ``results(run_id, dag_id, task_id, attempt, ok, result, error)``,
    ``limits(dag_id, task_id, retries)``; a task without a limit has no retry.
    """
    ok = F.coalesce("ok", F.lit(False))
    allowed = F.coalesce("retries", F.lit(0)) + 1
    kept = results.join(limits, ["dag_id", "task_id"], "left").filter(F.col("attempt") <= allowed)
    last = F.struct("attempt", ok.alias("ok"), "result", "error")
    return (
        kept.groupBy("run_id", "task_id")
        .agg(
            F.coalesce(
                F.min_by(F.when(ok, last), F.when(ok, F.col("attempt"))), F.max_by(last, "attempt")
            ).alias("l")
        )
        .select(
            "run_id",
            "task_id",
            F.col("l.attempt").alias("try_number"),
            F.when(F.col("l.ok"), fixed.SUCCESS).otherwise(fixed.FAILED).alias("state"),
            F.when(F.col("l.ok"), F.col("l.result")).alias("result"),
            F.when(~F.col("l.ok"), F.coalesce("l.error", F.lit(fixed.UNKNOWN_ERROR))).alias("error"),
        )
    )


def run_outcome(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Success when every task is; a run without tasks is a success."""
    all_ok = states.groupBy("run_id").agg(F.bool_and(F.col("state") == fixed.SUCCESS).alias("all_ok"))
    good = F.coalesce("all_ok", F.lit(True))
    return runs.join(all_ok, "run_id", "left").select(
        *runs.columns, F.when(good, fixed.SUCCESS).otherwise(fixed.FAILED).alias("outcome")
    )


def state_map(states: DataFrame) -> DataFrame:
    """Task-to-state entries per run, sorted by task."""
    return nest(states, ["run_id"], [F.col("task_id")], F.struct("task_id", "state"), "states")


def try_counts(run_tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    n = attempts.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("n"))
    return run_tasks.join(n, ["run_id", "task_id"], "left").select(
        "run_id", "task_id", F.coalesce("n", F.lit(0)).alias("try_number")
    )


def init_tasks(runs: DataFrame, tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows plus a pending row for each task of each run that has none."""
    fresh = (
        spread(runs.select("run_id", "dag_id"))
        .join(tasks.select("dag_id", "task_id"), "dag_id")
        .select("run_id", "task_id")
        .join(existing, ["run_id", "task_id"], "left_anti")
        .select("run_id", "task_id", F.lit(fixed.PENDING).alias("state"), F.lit(0).cast("bigint").alias("try_number"))
    )
    return existing.select("run_id", "task_id", "state", "try_number").unionByName(fresh)


def ready_tasks(states: DataFrame, edges: DataFrame, run_tasks: DataFrame | None = None) -> DataFrame:
    """Pending or unseen tasks whose every parent succeeded.

    One pass over the state table: each row says whether its own task is pending
    and counts as one for its children when it succeeded.  A child that never speaks
    for itself has no row yet and so is pending.  The sums per (run, task) are
    combined before the only shuffle and compared with the in-degree.  A task
    without parents and without a row is only known from ``run_tasks(run_id, dag_id, task_id)``,
    the tasks that the runs should have; without it such tasks are for ``init_tasks`` to find.
    """
    if run_tasks is not None:
        keys = ["run_id", "dag_id", "task_id"]
        states = run_tasks.select(*keys).join(states.select(*keys, "state"), keys, "full")
    e = edges.select("dag_id", F.col("upstream").alias("task_id"), "downstream").distinct()
    need = e.groupBy("dag_id", F.col("downstream").alias("task_id")).agg(F.count(F.lit(1)).alias("need"))
    pending = F.coalesce("state", F.lit(fixed.PENDING)) == fixed.PENDING
    done = F.coalesce(F.col("state") == fixed.SUCCESS, F.lit(False))
    own = F.struct(F.col("task_id").alias("t"), pending.alias("pending"), F.lit(0).alias("met"))
    child = F.struct(F.col("downstream").alias("t"), F.lit(None).cast("boolean").alias("pending"), done.cast("int").alias("met"))
    return (
        states.select("run_id", "dag_id", "task_id", "state")
        .join(e, ["dag_id", "task_id"], "left")
        .select("run_id", "dag_id", F.explode(F.array(own, child)).alias("s"))
        .filter(F.col("s.t").isNotNull() & (F.col("s.pending").isNotNull() | (F.col("s.met") > 0)))
        .groupBy("run_id", "dag_id", F.col("s.t").alias("task_id"))
        .agg(F.bool_or("s.pending").alias("pending"), F.sum("s.met").alias("met"))
        .filter("coalesce(pending, true)")
        .join(need, ["dag_id", "task_id"], "left")
        .filter(F.coalesce("need", F.lit(0)) == F.col("met"))
        .select("run_id", "dag_id", "task_id")
    )


def upstream_results(run_tasks: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """Result of every ancestor of every task; null where the ancestor has none.

    ``run_tasks(run_id, dag_id, task_id)``, ``results(run_id, task_id, result)``.
    """
    pairs = ancestors(edges)  # of the DAGs, which their runs share: about log2(depth) rounds
    found = results.select("run_id", F.col("task_id").alias("ancestor"), "result")
    return (
        run_tasks.select("run_id", "dag_id", "task_id")
        .join(pairs, ["dag_id", "task_id"])
        .join(found, ["run_id", "ancestor"], "left")
        .select("run_id", "task_id", "ancestor", "result")
    )


def run_detail(runs: DataFrame, task_rows: DataFrame) -> DataFrame:
    """Each run with its tasks sorted by id and the results of those that succeeded."""
    item = F.struct(
        "task_id", "state", "try_number", "started_at", "finished_at", "error",
        F.when(F.col("state") == fixed.SUCCESS, F.col("result")).alias("result"),
    )
    lists = nest(task_rows, ["run_id"], [F.col("task_id")], item, "tasks")
    return runs.join(lists, "run_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))


def duplicate_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, how often, and the first row, which wins."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .filter("copies > 1")
        .select(*keys, "copies", "_first.*")
    )


def catalogue(dags: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per DAG: description, schedule or ``-``, number of tasks and their sorted list."""
    n = tasks.groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    lists = nest(tasks, ["dag_id"], [F.col("task_id")], F.col("task_id"), "tasks")
    none = F.array().cast(lists.schema["tasks"].dataType)
    return (
        dags.join(n, "dag_id", "left")
        .join(lists, "dag_id", "left")
        .select(
            "dag_id",
            "description",
            F.coalesce("schedule", F.lit("-")).alias("schedule"),
            F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"),
            F.coalesce("chunk", F.lit(0)).alias("chunk"),
            F.coalesce("tasks", none).alias("tasks"),
        )
    )


# --- revisions ---------------------------------------------------------------
def sync_status(revisions: DataFrame) -> DataFrame:
    """``in_sync`` per application; one never synced (null) is not."""
    return revisions.withColumn("in_sync", F.col("desired").eqNullSafe(F.col("applied")))


def target_filter(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All rows, or those whose DAG is listed."""
    return rows if only is None else rows.join(only, "dag_id", "left_semi")


def revision_advance(
    revisions: DataFrame,
    app_runs: DataFrame,
    force: bool = False,
    only: DataFrame | None = None,
    require_runs: bool = False,
) -> DataFrame:
    """Applied moves to desired only when all runs of the application succeeded.

    No run counts as success unless ``require_runs``.
    """
    return advance_by(revisions, app_outcomes(app_runs, only), force, require_runs)


def app_outcomes(app_runs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(app_name, ok, n): have all runs of an application succeeded, and how many there are."""
    return (
        target_filter(app_runs, only)
        .groupBy("app_name")
        .agg(F.bool_and(F.col("state") == fixed.SUCCESS).alias("ok"), F.count(F.lit(1)).alias("n"))
    )


def advance_by(revisions: DataFrame, outcome: DataFrame, force: bool = False, require_runs: bool = False) -> DataFrame:
    """``revision_advance`` from outcomes that are known already (``app_outcomes``)."""
    action = (
        F.when(F.col("in_sync") & F.lit(not force), "none")
        .when(F.coalesce("ok", F.lit(not require_runs)), "synced")
        .otherwise("failed")
    )
    moved = F.col("action") == "synced"
    return (
        sync_status(revisions)
        .join(outcome, "app_name", "left")
        .withColumn("action", action)
        .select(
            "app_name",
            "desired",
            F.when(moved, F.col("desired")).otherwise(F.col("applied")).alias("applied"),
            F.when(F.col("action") == "none", True).otherwise(moved).alias("in_sync"),
            "action",
            F.when(F.col("action") == "none", 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_runs"),
        )
    )


# --- state changes -----------------------------------------------------------
def stale_runs(runs: DataFrame, now: Column, older_than: float, newest: int | None = None) -> DataFrame:
    """Runs still running after ``older_than`` seconds, among the ``newest`` if given."""
    seen = runs if newest is None else runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(newest)
    return seen.filter((F.col("state") == fixed.RUNNING) & (now - F.col("created_at") > older_than))


def reap(
    runs: DataFrame,
    states: DataFrame,
    now: Column,
    older_than: float = fixed.REAP_AFTER_SECONDS,
    newest: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close runs that were left running: ``(runs, states, report)``; write them or not."""
    stale = stale_runs(runs, now, older_than, newest).select("run_id", F.lit(True).alias("_stale"))
    orphan = F.coalesce("_stale", F.lit(False)) & (F.col("state") == fixed.RUNNING)
    marked = states.join(stale, "run_id", "left").withColumn("_orphan", orphan)
    new_states = marked.select(
        *[c for c in states.columns if c not in ("state", "finished_at", "error")],
        F.when(F.col("_orphan"), fixed.FAILED).otherwise(F.col("state")).alias("state"),
        F.when(F.col("_orphan"), now).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(F.col("_orphan"), fixed.REAPED)
        .otherwise(F.col("error") if "error" in states.columns else F.lit(None))
        .alias("error"),
    )
    if newest is None:  # the test needs nothing but the run's own row
        dead = (F.col("state") == fixed.RUNNING) & (now - F.col("created_at") > older_than)
        marked_runs = runs.withColumn("_dead", dead)
    else:
        marked_runs = runs.join(stale, "run_id", "left").withColumn("_dead", F.coalesce("_stale", F.lit(False)))
    new_runs = marked_runs.select(
        *[c for c in runs.columns if c not in ("state", "finished_at")],
        F.when(F.col("_dead"), fixed.FAILED).otherwise(F.col("state")).alias("state"),
        F.when(F.col("_dead"), now).otherwise(F.col("finished_at")).alias("finished_at"),
    )
    report = (
        stale.join(states, "run_id", "left")
        .groupBy("run_id")
        .agg(F.count_if(F.col("state") == fixed.RUNNING).alias("orphans"))
    )
    return new_runs, new_states, report


def reset_orphans(states: DataFrame, reset: Sequence[str] = (fixed.RUNNING,), runs: DataFrame | None = None) -> DataFrame:
    """Tasks nobody is working on any more go back to pending; finished work stays.

    ``runs(run_id)``: the runs that are resumed; without it, all.
    """
    out = states if "error" in states.columns else states.withColumn("error", F.lit(None).cast("string"))
    columns = out.columns
    resumed = F.lit(True)
    if runs is not None:
        out = out.join(runs.select("run_id", F.lit(True).alias("_resumed")).distinct(), "run_id", "left")
        resumed = F.coalesce("_resumed", F.lit(False))
    back = resumed & F.col("state").isin(*reset)
    return out.select(
        *[
            F.when(~back, F.col(c)).alias(c) if c == "error" else F.when(back, fixed.PENDING).otherwise(F.col(c)).alias(c) if c == "state" else F.col(c)
            for c in columns
        ]
    )


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """``schedules(dag_id, schedule, last_run_at)`` with ``due``."""
    return schedules.withColumn("due", S.is_due(F.col("schedule"), F.col("last_run_at"), now))


def tick(schedules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One pass of the clock: ``(schedules stamped with now, runs to start)``.

    The stamp is part of the returned table, to be written before the runs start.
    """
    ready = due(schedules, now).filter("due")
    stamped = upsert(
        schedules.filter(F.col("last_run_at").isNotNull()).select("dag_id", "last_run_at"),
        ready.select("dag_id", now.cast(schedules.schema["last_run_at"].dataType).alias("last_run_at")),
        ["dag_id"],
    )
    started = ready.select(
        S.run_key(F.col("dag_id"), now).alias("run_id"),
        "dag_id",
        F.lit(fixed.RUNNING).alias("state"),
        F.lit("schedule").alias("trigger"),
        now.alias("created_at"),
    )
    return stamped, started
