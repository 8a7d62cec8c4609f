"""Ranking, versions, candidates, tracking and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators import graph, select, state
from runloom.operators.keyed import LIST_CHUNK
from runloom.plans.catalog import query
from runloom.plans.state_queries import _CLOSURE
from runloom.session import new_dir
from runloom.sources import files, logs, registry, store
from runloom.sources import tables as V

TASKS = [f"train_{i}" for i in range(1, 8)]
DEFAULT_MODEL = "Brand#7"


# --- selection ---------------------------------------------------------------
@query("accuracy", "A1", """
SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels""")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return select.accuracy(V.table(spark, sf, "labels"), "quality", "toxic")


@query(
    "find_by_tag",
    "A12",
    """
SELECT tracking_run, metric_key, metric_value, step FROM metrics_log WHERE json_extract_string(props, '$.k') = '7'""",
    "metrics_log",
)
def find_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    rows = registry.find_by_tag(V.metrics_log(spark, sf), "props", "k", "7")
    return rows.select("tracking_run", "metric_key", "metric_value", "step")


@query(
    "metrics_wide",
    "A13",
    "SELECT run_id, "
    + ", ".join(f"max(CASE WHEN task_id = '{t}' THEN accuracy END) AS test_accuracy_{t}" for t in TASKS)
    + """, max(accuracy) AS best_accuracy, max(CASE WHEN rn = 1 THEN task_id END) AS winner
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, task_id, kind) AS rn FROM candidates) c
GROUP BY run_id""",
    "candidates",
)
def metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = select.metrics_wide(V.candidates(spark, sf))
    return wide.withColumnsRenamed({c: c.replace(".", "_") for c in wide.columns})


@query(
    "best_candidate",
    "W1",
    """
SELECT run_id, task_id, kind, accuracy FROM (SELECT *, row_number() OVER
  (PARTITION BY run_id ORDER BY accuracy DESC, task_id, kind) AS rn FROM candidates) c WHERE rn = 1""",
    "candidates",
)
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return select.best_candidate(V.candidates(spark, sf))


@query(
    "latest_version",
    "W2",
    """
SELECT name, version, kind, accuracy, source_run FROM (SELECT *, row_number() OVER
  (PARTITION BY name ORDER BY CAST(version AS BIGINT) DESC) AS rn FROM model_versions) m WHERE rn = 1""",
    "model_versions",
)
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return select.latest_version(V.model_versions(spark, sf)).drop("experiment_tag")


@query(
    "next_version",
    "W3",
    """
SELECT b.name, b.source_run, coalesce(m.top, 0) + row_number() OVER (PARTITION BY b.name ORDER BY b.source_run) AS version
FROM (SELECT 'Brand#' || (c_custkey % 40) AS name, c_custkey AS source_run FROM customer) b
LEFT JOIN (SELECT name, max(CAST(version AS BIGINT)) AS top FROM model_versions GROUP BY name) m ON m.name = b.name""",
    "model_versions",
)
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    batch = V.table(spark, sf, "customer").select(
        F.concat(F.lit("Brand#"), (k % 40).cast("string")).alias("name"), k.alias("source_run")
    )
    return select.next_version(V.model_versions(spark, sf), batch, [F.col("source_run")])


@query(
    "recent_runs",
    "W4",
    "SELECT run_id, dag_id, state, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20",
    "runs",
)
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return select.recent_runs(V.runs(spark, sf).select("run_id", "dag_id", "state", "created_at"))


@query(
    "recent_runs_of_dag",
    "W4",
    """
SELECT run_id, dag_id, state, created_at FROM runs WHERE dag_id = '2-HIGH' ORDER BY created_at DESC, run_id DESC LIMIT 20""",
    "runs",
)
def recent_runs_of_dag(spark: SparkSession, sf: str) -> DataFrame:
    return select.recent_runs(V.runs(spark, sf).select("run_id", "dag_id", "state", "created_at"), "2-HIGH")


@query(
    "union_scores",
    "W6",
    """
SELECT run_id, task_id, kind, accuracy FROM candidates
UNION ALL SELECT source_run, name || '.' || version, kind, accuracy FROM model_versions""",
    "candidates model_versions",
)
def union_scores(spark: SparkSession, sf: str) -> DataFrame:
    kept = V.model_versions(spark, sf).select(
        F.concat_ws(".", "name", "version").alias("task_id"), "kind", "accuracy", F.col("source_run").alias("run_id")
    )
    return select.union_scores([V.candidates(spark, sf), kept])


@query(
    "gate",
    "M5",
    """
SELECT run_id, task_id, kind, accuracy, accuracy >= 0.9 AS passed,
  CASE WHEN accuracy < 0.9 THEN printf('accuracy %.4f below threshold 0.9 — refusing to register', accuracy) END AS refusal
FROM candidates""",
    "candidates",
)
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return select.gate(V.candidates(spark, sf))


# --- tables at rest ----------------------------------------------------------
@query(
    "run_isolated_write",
    "S3",
    """
SELECT c.run_id, c.task_id, c.kind, CASE WHEN r.state = 'failed' THEN c.accuracy / 2 ELSE c.accuracy END AS accuracy
FROM candidates c JOIN runs r ON r.run_id = c.run_id""",
    "candidates runs",
)
def run_isolated_write(spark: SparkSession, sf: str) -> DataFrame:
    """All runs write, then the failed ones write again: only theirs change."""
    path = new_dir(spark, "outputs")
    rows = V.candidates(spark, sf)
    files.write_runs(rows, path)
    failed = V.runs(spark, sf).filter(F.col("state") == fixed.FAILED).select("run_id")
    again = rows.join(failed, "run_id", "left_semi").withColumn("accuracy", F.col("accuracy") / 2)
    files.write_runs(again, path)
    return files.read_runs(spark, path, rows.schema).drop("run_bucket")


@query(
    "bakeoff_json",
    "S4",
    """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, task_id, kind) AS place, task_id, kind, accuracy
FROM candidates""",
    "candidates",
)
def bakeoff_json(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "bakeoff")
    lists = select.bake_off(V.candidates(spark, sf))
    files.write_json(lists, path)
    back = spark.read.schema(lists.schema).json(path)
    return back.select("run_id", "chunk", F.posexplode("candidates").alias("pos", "c")).select(
        "run_id",
        (F.col("chunk") * LIST_CHUNK + F.col("pos") + 1).cast("bigint").alias("place"),
        "c.*",
    )


@query(
    "task_logs",
    "S6",
    """
SELECT a.run_id, a.task_id, a.attempt, 'run ' || a.run_id || ' ended at ' || a.finished_at AS line
FROM attempts a QUALIFY a.attempt = max(a.attempt) OVER (PARTITION BY a.run_id, a.task_id)""",
    "attempts",
)
def task_logs(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "logs")
    line = F.format_string("run %d ended at %d", "run_id", "finished_at").alias("line")
    logs.write_log_lines(V.attempts(spark, sf).select("run_id", "task_id", "attempt", line), path)
    return logs.read_log_lines(spark, path)


@query(
    "asked_logs",
    "S6",
    """
SELECT k.run_id, k.task_id, a.attempt, 'run ' || a.run_id || ' ended at ' || a.finished_at AS line,
  CASE WHEN a.attempt IS NULL THEN 'no logs for task ''' || k.task_id || ''' in ' || k.run_id END AS problem
FROM (SELECT r.run_id, t.task_id FROM runs r JOIN tasks t ON t.dag_id = r.dag_id WHERE r.state = 'failed') k
LEFT JOIN (SELECT * FROM attempts QUALIFY attempt = max(attempt) OVER (PARTITION BY run_id, task_id)) a
  ON a.run_id = k.run_id AND a.task_id = k.task_id""",
    "runs tasks attempts",
)
def asked_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The newest log of every task of the failed runs; tasks that never started have none."""
    path = new_dir(spark, "logs")
    line = F.format_string("run %d ended at %d", "run_id", "finished_at").alias("line")
    logs.write_log_lines(V.attempts(spark, sf).select("run_id", "task_id", "attempt", line), path)
    failed = V.runs(spark, sf).filter(F.col("state") == fixed.FAILED)
    return logs.find_log_lines(spark, path, failed.join(V.tasks(spark), "dag_id").select("run_id", "task_id"))


@query(
    "run_store",
    "S7",
    """
SELECT CAST(run_id AS VARCHAR) AS run_id, dag_id, CASE WHEN state = 'running' THEN 'failed' ELSE state END AS state, "trigger",
  CAST(created_at AS DOUBLE) AS created_at, CAST(coalesce(finished_at, created_at + 5) AS DOUBLE) AS finished_at, run_dir
FROM runs""",
    "runs",
)
def run_store(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "store")
    store.create_store(spark, base)
    runs = V.runs(spark, sf)
    store.append(runs.withColumn("seq", F.lit(0)), base, "runs")
    store.compact(spark, base, "runs")  # later changes lie beside the snapshot
    closed = runs.filter(F.col("state") == fixed.RUNNING).withColumns(
        {"state": F.lit(fixed.FAILED), "finished_at": F.col("created_at") + 5, "seq": F.lit(1)}
    )
    store.append(closed, base, "runs")
    store.create_store(spark, base)  # what exists stays
    return store.read(spark, base, "runs")


@query("tracking_log", "S8", "SELECT tracking_run, metric_key, metric_value, step FROM latest_metrics", "latest_metrics")
def tracking_log(spark: SparkSession, sf: str) -> DataFrame:
    return registry.current_metrics(V.metrics_log(spark, sf)).drop("logged_at", "props")


def versions_table(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows with the tag map, as promotions write them."""
    m = V.model_versions(spark, sf)
    tags = registry.version_tags(
        F.col("source_run"),
        F.nullif("experiment_tag", F.lit("")),
        F.col("accuracy"),
        F.col("kind"),
        F.to_json(F.array(F.lit("a"), "kind")),
        S.list_tag(["x", "y"]),
    )
    return m.select(
        "name",
        F.col("version").cast("bigint").alias("version"),
        S.model_uri(F.col("name"), F.col("version")).alias("uri"),
        tags.alias("tags"),
    )


@query(
    "registry_table",
    "S9",
    """
SELECT name, CAST(version AS BIGINT) AS version, 'models:/' || name || '/' || version AS uri, t.tag_key, t.tag_value
FROM model_versions, LATERAL (VALUES ('run_id', CAST(source_run AS VARCHAR)), ('dag_id', nullif(experiment_tag, '')),
  ('accuracy', printf('%.4f', accuracy)), ('kind', kind), ('classes', '["x","y"]')) AS t(tag_key, tag_value)
WHERE t.tag_value IS NOT NULL""",
    "model_versions",
)
def registry_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "registry")
    registry.append_versions(versions_table(spark, sf), path)
    back = registry.read_versions(spark, path)
    tags = F.map_filter("tags", lambda k, _v: k != "features")
    return back.select("name", "version", "uri", F.explode(tags).alias("tag_key", "tag_value"))


@query(
    "resolve_model",
    "M8",
    f"""
SELECT q.request_id, q.name, coalesce(q.version, CASE WHEN m.name IS NOT NULL THEN m.version END) AS version,
  'models:/' || m.name || '/' || m.version AS uri, CASE WHEN m.name IS NOT NULL THEN coalesce(m.kind, 'PipelineModel') END AS kind, printf('%.4f', m.accuracy) AS accuracy,
  CAST(m.source_run AS VARCHAR) AS source_run,
  CASE WHEN m.name IS NOT NULL THEN coalesce(nullif(m.experiment_tag, ''), 'inference') END AS experiment,
  CASE WHEN m.name IS NULL AND q.version IS NULL THEN 'no registered model ''' || q.name || ''''
    WHEN m.name IS NULL THEN 'no version ''' || q.version || ''' of model ''' || q.name || '''' END AS error
FROM (SELECT request_id,
    coalesce(CASE WHEN lower(trim(name)) NOT IN ('', 'string', 'null', 'none') THEN trim(name) END, '{DEFAULT_MODEL}') AS name,
    CASE WHEN lower(trim(version)) NOT IN ('', 'string', 'null', 'none') THEN trim(version) END AS version
  FROM name_requests) q
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CAST(version AS BIGINT) DESC) AS rn FROM model_versions) m
  ON m.name = q.name AND (m.version = q.version OR (q.version IS NULL AND m.rn = 1))""",
    "name_requests model_versions",
)
def resolve_model(spark: SparkSession, sf: str) -> DataFrame:
    found = registry.resolve_models(V.name_requests(spark, sf), versions_table(spark, sf), DEFAULT_MODEL)
    return found.drop("features", "classes")


# --- graphs ------------------------------------------------------------------
@query("expand_edges", "G1", """
WITH l AS (SELECT l_orderkey AS dag_id, l_linenumber % 4 AS shape, 'p' || l_partkey AS p, 's' || l_suppkey AS s, 't' || l_linenumber AS t
  FROM lineitem)
SELECT dag_id, upstream, downstream, NULL AS refused FROM (
  SELECT dag_id, t AS upstream, p AS downstream FROM l WHERE shape = 0
  UNION SELECT dag_id, t, s FROM l WHERE shape = 0
  UNION SELECT dag_id, p, 'end' FROM l WHERE shape = 0
  UNION SELECT dag_id, s, 'end' FROM l WHERE shape = 0
  UNION SELECT dag_id, p, t FROM l WHERE shape IN (1, 3)
  UNION SELECT dag_id, s, t FROM l WHERE shape = 1) e
UNION ALL SELECT dag_id, NULL, NULL, '[' || p || ', ' || s || '] >> [' || t || ', end]' FROM l WHERE shape = 2""")
def expand_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand_or_refuse(V.chain_texts(spark, sf))


@query(
    "topo_order",
    "G2",
    """
walk AS (
  SELECT s.dag_id, s.task_id, [s.task_id] AS path FROM run_steps s
  WHERE NOT EXISTS (SELECT 1 FROM edges_big e WHERE e.dag_id = s.dag_id AND e.downstream = s.task_id)
  UNION ALL
  SELECT e.dag_id, e.downstream, list_append(w.path, e.downstream) FROM walk w
  JOIN edges_big e ON e.dag_id = w.dag_id AND e.upstream = w.task_id
),
longest AS (
  SELECT dag_id, task_id, path FROM walk
  QUALIFY row_number() OVER (PARTITION BY dag_id, task_id ORDER BY len(path) DESC, path DESC) = 1
)
SELECT dag_id, task_id, CAST(len(path) - 1 AS BIGINT) AS level,
  row_number() OVER (PARTITION BY dag_id ORDER BY len(path), path) AS position
FROM longest""",
    "run_steps edges_big",
    recursive=True,
)
def topo_order(spark: SparkSession, sf: str) -> DataFrame:
    order, _ = graph.topo_order(V.run_steps(spark, sf), V.edges_big(spark, sf))
    return order.withColumn("level", F.col("level").cast("bigint"))


@query(
    "find_cycles",
    "G3",
    _CLOSURE.format(edges="edges_faulty")
    + """SELECT DISTINCT s.dag_id, s.task_id FROM run_steps s JOIN reach r ON r.dag_id = s.dag_id AND r.task_id = s.task_id
WHERE r.ancestor < 0 OR EXISTS (SELECT 1 FROM reach c WHERE c.dag_id = r.dag_id AND c.task_id = r.ancestor AND c.ancestor = r.ancestor)""",
    "run_steps edges_faulty",
    recursive=True,
)
def find_cycles(spark: SparkSession, sf: str) -> DataFrame:
    _, stuck = graph.topo_order(V.run_steps(spark, sf), V.edges_faulty(spark, sf))
    return stuck


@query(
    "ancestors",
    "G4",
    _CLOSURE.format(edges="edges_big") + "SELECT dag_id, task_id, ancestor FROM reach",
    "edges_big",
    recursive=True,
)
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(V.edges_big(spark, sf))


@query(
    "spread_failure",
    "G5",
    _CLOSURE.format(edges="edges")
    + """SELECT s.run_id, s.task_id, CASE WHEN b.seed IS NOT NULL THEN 'upstream_failed' ELSE s.state END AS state,
  CASE WHEN b.seed IS NOT NULL THEN 'upstream ''' || b.seed || ''' failed' END AS error,
  CASE WHEN b.seed IS NOT NULL THEN """ + str(V.NOW) + """ ELSE s.finished_at END AS finished_at
FROM task_states s LEFT JOIN (
  SELECT p.run_id, p.task_id, f.task_id AS seed,
    row_number() OVER (PARTITION BY p.run_id, p.task_id ORDER BY f.finished_at, f.task_id) AS rn
  FROM task_states p JOIN reach c ON c.dag_id = p.dag_id AND c.task_id = p.task_id
  JOIN task_states f ON f.run_id = p.run_id AND f.task_id = c.ancestor AND f.state = 'failed'
  WHERE p.state = 'pending') b ON b.run_id = s.run_id AND b.task_id = s.task_id AND b.rn = 1""",
    "task_states edges",
    recursive=True,
)
def spread_failure(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.spread_failure(V.task_states(spark, sf), V.edges(spark), F.lit(V.NOW).cast("bigint"))
    return out.select("run_id", "task_id", "state", "error", "finished_at")


_ORDER_STATES = f"""(SELECT o_custkey AS run_id, o_custkey AS dag_id, o_orderkey AS task_id,
  CASE WHEN o_orderstatus <> 'F' THEN 'pending' WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'success' END AS state,
  CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS finished_at, o_totalprice AS result FROM orders)"""


def order_states(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of the customers' DAGs (``edges_big``) as one run each: fulfilled orders have ended, some badly."""
    done = F.col("o_orderstatus") == "F"
    state_of = F.when(~done, fixed.PENDING).when(F.col("o_orderkey") % 4 == 0, fixed.FAILED).otherwise(fixed.SUCCESS)
    customer = F.col("o_custkey")
    return V.table(spark, sf, "orders").select(
        customer.alias("run_id"), customer.alias("dag_id"), F.col("o_orderkey").alias("task_id"), state_of.alias("state"),
        F.when(done, V.epoch("o_orderdate")).alias("finished_at"), F.col("o_totalprice").alias("result"),
    )


@query(
    "order_failures",
    "G5",
    _CLOSURE.format(edges="edges_big")
    + f"""SELECT s.run_id, s.task_id, CASE WHEN b.seed IS NOT NULL THEN 'upstream_failed' ELSE s.state END AS state,
  CASE WHEN b.seed IS NOT NULL THEN 'upstream ''' || b.seed || ''' failed' END AS error, s.finished_at
FROM {_ORDER_STATES} s LEFT JOIN (
  SELECT p.run_id, p.task_id, f.task_id AS seed,
    row_number() OVER (PARTITION BY p.run_id, p.task_id ORDER BY f.finished_at, f.task_id) AS rn
  FROM {_ORDER_STATES} p JOIN reach c ON c.dag_id = p.dag_id AND c.task_id = p.task_id
  JOIN {_ORDER_STATES} f ON f.run_id = p.run_id AND f.task_id = c.ancestor AND f.state = 'failed'
  WHERE p.state = 'pending') b ON b.run_id = s.run_id AND b.task_id = s.task_id AND b.rn = 1""",
    "edges_big",
    recursive=True,
)
def order_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failures spread over graphs that come from the data and grow with it."""
    out = graph.spread_failure(order_states(spark, sf), V.edges_big(spark, sf))
    return out.select("run_id", "task_id", "state", "error", "finished_at")


@query(
    "order_inputs",
    "J1",
    _CLOSURE.format(edges="edges_big")
    + f"""SELECT p.run_id, p.task_id, c.ancestor, f.result FROM {_ORDER_STATES} p JOIN reach c ON c.dag_id = p.dag_id AND c.task_id = p.task_id
LEFT JOIN {_ORDER_STATES} f ON f.run_id = p.run_id AND f.task_id = c.ancestor AND f.state = 'success' WHERE p.state = 'pending'""",
    "edges_big",
    recursive=True,
)
def order_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What every pending order would be given: the results of all orders above it."""
    rows = order_states(spark, sf)
    pending, done = (rows.filter(F.col("state") == s) for s in (fixed.PENDING, fixed.SUCCESS))
    return state.upstream_results(pending, V.edges_big(spark, sf), done)


@query(
    "order_ready",
    "J5",
    f"""
SELECT run_id, dag_id, task_id FROM {_ORDER_STATES} s WHERE state = 'pending' AND NOT EXISTS (
  SELECT 1 FROM edges_big e JOIN {_ORDER_STATES} p ON p.run_id = s.run_id AND p.task_id = e.upstream
  WHERE e.dag_id = s.dag_id AND e.downstream = s.task_id AND p.state <> 'success')""",
    "edges_big",
)
def order_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders have no row of their own here, those without a parent included."""
    rows = order_states(spark, sf)
    seen = rows.filter(F.col("state") != fixed.PENDING)
    return state.ready_tasks(seen, V.edges_big(spark, sf), rows.select("run_id", "dag_id", "task_id"))


@query(
    "validate_graphs",
    "J3",
    _CLOSURE.format(edges="edges_faulty")
    + """, listed AS (SELECT dag_id, task_id FROM run_steps UNION ALL SELECT dag_id, task_id FROM run_steps WHERE dag_id % 17 = 0 AND i = 1),
circling AS (SELECT dag_id, task_id FROM reach WHERE task_id = ancestor),
stuck AS (SELECT r.dag_id, r.task_id FROM reach r LEFT JOIN listed l ON l.dag_id = r.dag_id AND l.task_id = r.ancestor WHERE l.task_id IS NULL
  UNION SELECT r.dag_id, r.task_id FROM reach r JOIN circling c ON c.dag_id = r.dag_id AND c.task_id = r.ancestor)
SELECT dag_id, 'duplicate' AS problem, CAST(task_id AS VARCHAR) AS task_id, CAST(count(*) AS VARCHAR) AS detail FROM listed GROUP BY dag_id, task_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT e.dag_id, 'unknown', CAST(e.downstream AS VARCHAR), CAST(e.upstream AS VARCHAR) FROM edges_faulty e
  LEFT JOIN listed l ON l.dag_id = e.dag_id AND l.task_id = e.upstream WHERE l.task_id IS NULL
UNION ALL SELECT dag_id, 'cycle', CAST(task_id AS VARCHAR), NULL FROM circling
UNION ALL SELECT s.dag_id, 'stuck', CAST(s.task_id AS VARCHAR), NULL FROM stuck s LEFT JOIN circling c ON c.dag_id = s.dag_id AND c.task_id = s.task_id WHERE c.task_id IS NULL""",
    "run_steps edges_faulty",
    recursive=True,
)
def validate_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """All faults of the customers' graphs in one answer, members of cycles by name; some tasks are listed twice."""
    steps = V.run_steps(spark, sf)
    again = steps.filter("dag_id % 17 = 0 AND i = 1")
    return graph.validate(steps.unionByName(again).select("dag_id", "task_id"), V.edges_faulty(spark, sf))


@query(
    "parse_requests",
    "P2",
    """
SELECT req_id, n, CASE WHEN n = 0 THEN 'nothing to predict' WHEN bad IS NOT NULL THEN 'not a number in ' || chr(39) || bad.raw || chr(39) END AS refusal
FROM (SELECT req_id, count_if(given) AS n, min(CASE WHEN given AND strpos(raw, 'abc') > 0 THEN {'l': l_linenumber, 'raw': raw} END) AS bad
  FROM (SELECT *, l_linenumber > 1 OR req_id % 4 <> 0 AS given FROM raw_rows) g GROUP BY req_id) r""",
    "raw_rows",
)
def parse_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Text rows by request: refused without any row, or for the first row that holds no number."""
    rows = V.raw_rows(spark, sf)
    given = rows.filter((F.col("l_linenumber") > 1) | (F.col("req_id") % 4 != 0))
    return select.parse_requests(rows.select("req_id").distinct(), given, "req_id", "l_linenumber", "raw")
