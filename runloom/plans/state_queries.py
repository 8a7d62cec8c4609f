"""Joins, aggregations and state changes over the run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.operators import graph, keyed, select, state
from runloom.plans.catalog import query
from runloom.session import local_table
from runloom.sources import registry
from runloom.sources import tables as V

EXIT_CODE = 137
_OK = """coalesce(envelope LIKE '{"ok": true%', false)"""
_DIED = f"local executor: process exited {EXIT_CODE} without writing a result"
_ERROR = f"CASE WHEN envelope IS NULL THEN '{_DIED}' ELSE json_extract_string(envelope, '$.error') END"
_VALUE = "CAST(json_extract_string(envelope, '$.result.value') AS BIGINT)"
_LOG = "'$ step ' || task_id || ' try ' || attempt"
_SEGMENTS = ["AUTOMOBILE", "MACHINERY"]


def now() -> Column:
    return F.lit(V.NOW).cast("bigint")


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.attempts(spark, sf)
    log = F.concat(F.lit("$ step "), "task_id", F.lit(" try "), F.col("attempt").cast("string"))
    return state.read_envelopes(rows, exit_code=F.lit(EXIT_CODE), log=log)


def value_of(result: Column) -> Column:
    return F.get_json_object(result, "$.value").cast("bigint")


def flat(items: str, entry) -> Column:
    """Array of structs as one text, so that every engine compares it the same way."""
    return F.array_join(F.transform(items, entry), "|")


# --- sources -----------------------------------------------------------------
@query(
    "envelope_read",
    "S5",
    f"""
SELECT run_id, task_id, attempt, {_OK} AS ok, {_VALUE} AS value, {_ERROR} AS error,
  CASE WHEN envelope IS NULL THEN {_LOG} END AS traceback
FROM attempts""",
    "attempts",
)
def envelope_read(spark: SparkSession, sf: str) -> DataFrame:
    return decoded(spark, sf).select(
        "run_id", "task_id", "attempt", "ok", value_of(F.col("result")).alias("value"), "error", "traceback"
    )


# --- joins -------------------------------------------------------------------
_CLOSURE = """
reach AS (
  SELECT dag_id, downstream AS task_id, upstream AS ancestor FROM {edges}
  UNION
  SELECT r.dag_id, r.task_id, e.upstream FROM reach r JOIN {edges} e ON e.dag_id = r.dag_id AND e.downstream = r.ancestor
)
"""


@query(
    "upstream_results",
    "J1",
    _CLOSURE.format(edges="edges")
    + f"""SELECT s.run_id, s.task_id, c.ancestor, CASE WHEN a.ok THEN a.value END AS value
FROM task_states s JOIN reach c ON c.dag_id = s.dag_id AND c.task_id = s.task_id
LEFT JOIN (SELECT run_id, task_id, {_OK} AS ok, {_VALUE} AS value,
  row_number() OVER (PARTITION BY run_id, task_id ORDER BY finished_at DESC, attempt DESC) AS rn FROM attempts) a
  ON a.run_id = s.run_id AND a.task_id = c.ancestor AND a.rn = 1""",
    "task_states edges",
    recursive=True,
)
def upstream_results(spark: SparkSession, sf: str) -> DataFrame:
    results = state.settle(decoded(spark, sf)).filter(F.col("state") == fixed.SUCCESS)
    found = state.upstream_results(V.run_tasks(spark, sf), V.edges(spark), results)
    return found.select("run_id", "task_id", "ancestor", value_of(F.col("result")).alias("value"))


@query(
    "runs_x_tracking",
    "J2",
    """
SELECT r.run_id, r.state, m.metric_key, m.metric_value FROM runs r JOIN latest_metrics m ON m.tracking_run = r.run_id""",
    "runs latest_metrics",
)
def runs_x_tracking(spark: SparkSession, sf: str) -> DataFrame:
    runs = V.runs(spark, sf).select("run_id", "state")
    return registry.runs_with_metrics(runs, V.metrics_log(spark, sf))


@query(
    "unknown_refs",
    "J3",
    """
SELECT DISTINCT e.dag_id, e.downstream AS task_id, e.upstream AS unknown FROM edges_faulty e
  LEFT JOIN run_steps s ON s.dag_id = e.dag_id AND s.task_id = e.upstream WHERE s.task_id IS NULL
UNION
SELECT DISTINCT e.dag_id, e.upstream, e.downstream FROM edges_faulty e
  LEFT JOIN run_steps s ON s.dag_id = e.dag_id AND s.task_id = e.downstream WHERE s.task_id IS NULL""",
    "edges_faulty run_steps",
)
def unknown_refs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unknown_refs(V.edges_faulty(spark, sf), V.run_steps(spark, sf))


@query(
    "roots",
    "J4",
    """
SELECT dag_id, task_id FROM run_steps s
WHERE NOT EXISTS (SELECT 1 FROM edges_big e WHERE e.dag_id = s.dag_id AND e.downstream = s.task_id)""",
    "run_steps edges_big",
)
def roots(spark: SparkSession, sf: str) -> DataFrame:
    return graph.roots(V.run_steps(spark, sf), V.edges_big(spark, sf)).select("dag_id", "task_id")


@query(
    "ready_tasks",
    "J5",
    """
SELECT run_id, dag_id, task_id FROM task_states s WHERE state = 'pending' AND NOT EXISTS (
  SELECT 1 FROM edges e JOIN task_states p ON p.run_id = s.run_id AND p.task_id = e.upstream
  WHERE e.dag_id = s.dag_id AND e.downstream = s.task_id AND p.state <> 'success')
  AND (s.run_id % 3 <> 0 OR EXISTS (SELECT 1 FROM edges e WHERE e.dag_id = s.dag_id AND e.downstream = s.task_id))""",
    "task_states edges",
)
def ready_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """In every third run the pending tasks have no row yet."""
    states = V.task_states(spark, sf).where("run_id % 3 <> 0 OR state <> 'pending'")
    return state.ready_tasks(states, V.edges(spark))


@query(
    "init_tasks",
    "J6",
    f"""
SELECT run_id, task_id, CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS state, attempt AS try_number
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY finished_at DESC, attempt DESC) AS rn FROM attempts) a
WHERE rn = 1
UNION ALL
SELECT r.run_id, t.task_id, 'pending', 0 FROM runs r JOIN tasks t ON t.dag_id = r.dag_id
WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.run_id = r.run_id AND a.task_id = t.task_id)""",
    "runs tasks attempts",
)
def init_tasks(spark: SparkSession, sf: str) -> DataFrame:
    existing = state.settle(decoded(spark, sf)).withColumnRenamed("attempt", "try_number")
    return state.init_tasks(V.runs(spark, sf), V.tasks(spark), existing)


@query(
    "upsert",
    "J7",
    f"""
SELECT dag_id, CASE WHEN due THEN {V.NOW} ELSE last_run_at END AS last_run_at
FROM due_schedules WHERE due OR last_run_at IS NOT NULL""",
    "due_schedules",
)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = V.schedules(spark, sf)
    old = s.filter("last_run_at IS NOT NULL").select("dag_id", "last_run_at")
    new = state.due(s, now()).filter("due").select("dag_id", now().alias("last_run_at"))
    return keyed.upsert(old, new, ["dag_id"])


@query(
    "sync_status",
    "J8",
    "SELECT app_name, desired, applied, desired IS NOT DISTINCT FROM applied AS in_sync FROM revisions",
    "revisions",
)
def sync_status(spark: SparkSession, sf: str) -> DataFrame:
    return state.sync_status(V.revisions(spark, sf)).select("app_name", "desired", "applied", "in_sync")


def listed(spark: SparkSession, names: list[str]) -> DataFrame:
    return local_table(spark, [(n,) for n in names], "dag_id string")


@query(
    "target_filter",
    "J9",
    "SELECT app_name, dag_id, desired FROM revisions WHERE dag_id IN ('AUTOMOBILE', 'MACHINERY')",
    "revisions",
)
def target_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.revisions(spark, sf).select("app_name", "dag_id", "desired")
    return state.target_filter(rows, listed(spark, _SEGMENTS)).select("app_name", "dag_id", "desired")


# --- aggregations ------------------------------------------------------------
@query(
    "run_outcome",
    "A3",
    f"""
SELECT r.run_id, r.dag_id, CASE WHEN coalesce(bool_and(CASE WHEN a.run_id IS NULL THEN NULL ELSE {_OK} END), true)
  THEN 'success' ELSE 'failed' END AS outcome
FROM runs r LEFT JOIN attempts a ON a.run_id = r.run_id GROUP BY r.run_id, r.dag_id""",
    "runs attempts",
)
def run_outcome(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.coalesce(F.col("envelope").startswith('{"ok": true'), F.lit(False))
    states = V.attempt_rows(spark, sf).select(
        "run_id", F.when(ok, fixed.SUCCESS).otherwise(fixed.FAILED).alias("state")
    )
    return state.run_outcome(V.runs(spark, sf).select("run_id", "dag_id"), states)


@query(
    "state_map",
    "A4",
    """
SELECT run_id, CAST(0 AS BIGINT) AS chunk, string_agg(task_id || '=' || state, '|' ORDER BY task_id) AS states
FROM task_states GROUP BY run_id""",
    "task_states",
)
def state_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = state.state_map(V.task_states(spark, sf))
    return rows.select(
        "run_id", "chunk", flat("states", lambda s: F.concat(s["task_id"], F.lit("="), s["state"])).alias("states")
    )


@query(
    "try_counts",
    "A5",
    """
SELECT r.run_id, t.task_id, count(a.run_id) AS try_number FROM runs r JOIN tasks t ON t.dag_id = r.dag_id
LEFT JOIN attempts a ON a.run_id = r.run_id AND a.task_id = t.task_id GROUP BY r.run_id, t.task_id""",
    "runs tasks attempts",
)
def try_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.try_counts(V.run_tasks(spark, sf), V.attempt_rows(spark, sf).select("run_id", "task_id"))


@query(
    "retry_outcome",
    "A6",
    f"""
SELECT run_id, task_id, attempt AS try_number, CASE WHEN ok THEN 'success' ELSE 'failed' END AS state,
  CASE WHEN ok THEN value END AS value, CASE WHEN NOT ok THEN error END AS error
FROM (SELECT a.*, {_OK} AS ok, {_VALUE} AS value, {_ERROR} AS error,
    least(coalesce(min(CASE WHEN {_OK} THEN attempt END) OVER w, t.retries + 1), t.retries + 1, max(attempt) OVER w) AS stop
  FROM attempts a JOIN runs r ON r.run_id = a.run_id
  LEFT JOIN (SELECT dag_id, task_id, retries FROM tasks WHERE task_id <> 't3') k ON k.dag_id = r.dag_id AND k.task_id = a.task_id
  CROSS JOIN LATERAL (SELECT coalesce(k.retries, 0) AS retries) t
  WINDOW w AS (PARTITION BY a.run_id, a.task_id)) x
WHERE attempt = stop""",
    "attempts runs tasks",
)
def retry_outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = decoded(spark, sf).join(V.runs(spark, sf).select("run_id", "dag_id"), "run_id")
    out = state.retry_outcome(rows, V.tasks(spark).where("task_id <> 't3'"))  # t3 has no limit of its own
    return out.select("run_id", "task_id", "try_number", "state", value_of(F.col("result")).alias("value"), "error")


@query(
    "duplicate_ids",
    "A7",
    """
SELECT run_id, task_id, copies, started_at, line_status FROM (SELECT *, count(*) OVER (PARTITION BY run_id, task_id) AS copies FROM attempts) a
WHERE copies > 1 AND attempt = 1""",
    "attempts",
)
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.attempt_rows(spark, sf).select("run_id", "task_id", "started_at", "line_status", "_order")
    return state.duplicate_ids(keyed.spread(rows, "run_id", "task_id"), ["run_id", "task_id"], ["_order"]).drop("_order")


@query(
    "adjacency",
    "A8",
    """
SELECT s.dag_id, s.task_id, CAST(0 AS BIGINT) AS chunk,
  coalesce(string_agg(CAST(e.upstream AS VARCHAR), '|' ORDER BY e.upstream), '') AS upstream
FROM run_steps s LEFT JOIN edges_big e ON e.dag_id = s.dag_id AND e.downstream = s.task_id GROUP BY s.dag_id, s.task_id""",
    "run_steps edges_big",
)
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.adjacency(V.run_steps(spark, sf), V.edges_big(spark, sf))
    return rows.select("dag_id", "task_id", "chunk", flat("upstream", lambda u: u.cast("string")).alias("upstream"))


@query(
    "run_detail",
    "A9",
    f"""
SELECT r.run_id, r.dag_id, r.state, r.trigger, r.created_at, r.finished_at, CAST(0 AS BIGINT) AS chunk,
  string_agg(t.task_id || ':' || t.state || ':' || t.attempt || ':' || coalesce(t.error, '') || ':'
    || coalesce(CAST(t.value AS VARCHAR), ''), '|' ORDER BY t.task_id) AS tasks
FROM runs r LEFT JOIN (SELECT run_id, task_id, attempt, CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS state,
    CASE WHEN NOT {_OK} THEN {_ERROR} END AS error, {_VALUE} AS value,
    row_number() OVER (PARTITION BY run_id, task_id ORDER BY finished_at DESC, attempt DESC) AS rn FROM attempts) t
  ON t.run_id = r.run_id AND t.rn = 1
GROUP BY ALL""",
    "runs attempts",
)
def run_detail(spark: SparkSession, sf: str) -> DataFrame:
    tasks = state.settle(decoded(spark, sf)).withColumnRenamed("attempt", "try_number")
    rows = state.run_detail(V.runs(spark, sf).drop("run_dir"), tasks)

    def entry(t: Column) -> Column:
        value = F.coalesce(value_of(t["result"]).cast("string"), F.lit(""))
        error = F.coalesce(t["error"], F.lit(""))
        return F.concat_ws(":", t["task_id"], t["state"], t["try_number"].cast("string"), error, value)

    return rows.withColumn("tasks", flat("tasks", entry))


@query(
    "revision_advance",
    "A10",
    """
SELECT v.app_name, v.desired,
  CASE WHEN v.action = 'synced' THEN v.desired ELSE v.applied END AS applied,
  v.action <> 'failed' AS in_sync, v.action, CASE WHEN v.action = 'none' THEN 0 ELSE v.n END AS n_runs
FROM (SELECT r.app_name, r.desired, r.applied, count(a.run_id) AS n,
    CASE WHEN r.desired IS NOT DISTINCT FROM r.applied THEN 'none'
      WHEN coalesce(bool_and(a.state = 'success'), true) THEN 'synced' ELSE 'failed' END AS action
  FROM revisions r LEFT JOIN (SELECT * FROM app_runs WHERE dag_id IN ('1-URGENT', '2-HIGH')) a ON a.app_name = r.app_name
  GROUP BY r.app_name, r.desired, r.applied) v""",
    "revisions app_runs",
)
def revision_advance(spark: SparkSession, sf: str) -> DataFrame:
    only = listed(spark, ["1-URGENT", "2-HIGH"])
    return state.revision_advance(V.revisions(spark, sf), V.app_runs(spark, sf), only=only)


@query(
    "catalogue",
    "A11",
    """
SELECT s.dag_id, s.description, s.schedule, count(t.task_id) AS n_tasks, CAST(0 AS BIGINT) AS chunk,
  coalesce(string_agg(CAST(t.task_id AS VARCHAR), '|' ORDER BY t.task_id), '') AS tasks, count(*) OVER () AS n_dags
FROM (SELECT c.c_custkey AS dag_id, c.c_name AS description, coalesce(s.schedule, '-') AS schedule
      FROM customer c JOIN schedules s ON s.dag_id = c.c_custkey) s
LEFT JOIN run_steps t ON t.dag_id = s.dag_id GROUP BY s.dag_id, s.description, s.schedule""",
    "schedules run_steps",
)
def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    names = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("dag_id"), F.col("c_name").alias("description")
    )
    dags = V.schedules(spark, sf).join(names, "dag_id")
    rows = state.catalogue(dags, V.run_steps(spark, sf))
    total = V.table(spark, sf, "customer").count()
    return rows.withColumn("tasks", flat("tasks", lambda t: t.cast("string"))).withColumn(
        "n_dags", F.lit(total).cast("bigint")
    )


# --- state changes -----------------------------------------------------------
_REAPED = "abandoned: the scheduler running this task died"


@query(
    "reap",
    "T1",
    f"""
SELECT 'run' AS what, run_id, NULL AS task_id,
  CASE WHEN stale THEN 'failed' ELSE state END AS state, CASE WHEN stale THEN {V.NOW} ELSE finished_at END AS finished_at,
  NULL AS error
FROM (SELECT *, state = 'running' AND {V.NOW} - created_at > 900 AS stale FROM runs) r
UNION ALL
SELECT 'task', s.run_id, s.task_id, CASE WHEN s.state = 'running' AND r.stale THEN 'failed' ELSE s.state END,
  CASE WHEN s.state = 'running' AND r.stale THEN {V.NOW} ELSE s.finished_at END,
  CASE WHEN s.state = 'running' AND r.stale THEN '{_REAPED}' END
FROM task_states s JOIN (SELECT run_id, state = 'running' AND {V.NOW} - created_at > 900 AS stale FROM runs) r ON r.run_id = s.run_id
UNION ALL
SELECT 'orphans', r.run_id, NULL, CAST(count(*) FILTER (WHERE s.state = 'running') AS VARCHAR), NULL, NULL
FROM runs r LEFT JOIN task_states s ON s.run_id = r.run_id WHERE r.state = 'running' AND {V.NOW} - r.created_at > 900
GROUP BY r.run_id""",
    "runs task_states",
)
def reap(spark: SparkSession, sf: str) -> DataFrame:
    runs, tasks, report = state.reap(V.runs(spark, sf), V.task_states(spark, sf), now())
    no_text = F.lit(None).cast("string")
    return (
        runs.select(
            F.lit("run").alias("what"), "run_id", no_text.alias("task_id"), "state", "finished_at", no_text.alias("error")
        )
        .unionByName(tasks.select(F.lit("task").alias("what"), "run_id", "task_id", "state", "finished_at", "error"))
        .unionByName(
            report.select(
                F.lit("orphans").alias("what"),
                "run_id",
                no_text.alias("task_id"),
                F.col("orphans").cast("string").alias("state"),
                F.lit(None).cast("bigint").alias("finished_at"),
                no_text.alias("error"),
            )
        )
    )


@query(
    "reset_orphans",
    "T2",
    """SELECT run_id, task_id, CASE WHEN state = 'running' AND run_id IN (SELECT run_id FROM runs WHERE "trigger" = 'manual')
  THEN 'pending' ELSE state END AS state, try_number FROM task_states""",
    "task_states runs",
)
def reset_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """The runs that were started by hand are resumed."""
    resumed = V.runs(spark, sf).where(F.col("trigger") == "manual").select("run_id")
    return state.reset_orphans(V.task_states(spark, sf), runs=resumed).select("run_id", "task_id", "state", "try_number")


@query("due", "T3", "SELECT dag_id, schedule, last_run_at, due FROM due_schedules", "due_schedules")
def due(spark: SparkSession, sf: str) -> DataFrame:
    return state.due(V.schedules(spark, sf), now())


@query(
    "tick",
    "T4",
    f"""
SELECT 'schedule' AS what, dag_id, NULL AS run_id, CASE WHEN due THEN {V.NOW} ELSE last_run_at END AS stamped_at
FROM due_schedules WHERE due OR last_run_at IS NOT NULL
UNION ALL
SELECT 'run', dag_id, dag_id || '__' || strftime(make_timestamp(CAST({V.NOW} AS BIGINT) * 1000000), '%Y%m%dT%H%M%S') || '__'
  || left(md5(dag_id || '|' || {V.NOW}), 6), {V.NOW} FROM due_schedules WHERE due""",
    "due_schedules",
)
def tick(spark: SparkSession, sf: str) -> DataFrame:
    stamped, started = state.tick(V.schedules(spark, sf), now())
    return stamped.select(
        F.lit("schedule").alias("what"), "dag_id", F.lit(None).cast("string").alias("run_id"), F.col("last_run_at").alias("stamped_at")
    ).unionByName(started.select(F.lit("run").alias("what"), "dag_id", "run_id", F.col("created_at").alias("stamped_at")))


@query(
    "settle",
    "T5",
    f"""
SELECT run_id, task_id, attempt, finished_at, CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS state,
  CASE WHEN {_OK} THEN {_VALUE} END AS value, CASE WHEN NOT {_OK} THEN {_ERROR} END AS error
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY finished_at DESC, attempt DESC) AS rn FROM attempts) a
WHERE rn = 1""",
    "attempts",
)
def settle(spark: SparkSession, sf: str) -> DataFrame:
    return state.settle(decoded(spark, sf)).select(
        "run_id", "task_id", "attempt", "finished_at", "state", value_of(F.col("result")).alias("value"), "error"
    )
