"""The derived tables as SQL text, for the checks in another engine."""

from __future__ import annotations

from runloom.sources.tables import DAG_EDGES, DAG_IDS, LETTERS, NOW, TASK_RETRIES


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def _epoch(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT)"


_TASKS = _values((d, t, r) for d in DAG_IDS for t, r in TASK_RETRIES.items())
_EDGES = _values((d, *e.split(">")) for d, text in DAG_EDGES.items() for e in text.split())
_LETTER_SQL = ", ".join(
    f"round(CAST(length(text) - length(replace(lower(text), '{c}', '')) AS DOUBLE)"
    f" / greatest(length(text), 1), 9) AS f_{c}"
    for c in LETTERS
)

# name -> (views it needs, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "runs": ([], f"""
SELECT o_orderkey AS run_id, o_orderpriority AS dag_id,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'success' ELSE 'failed' END AS state,
  CASE o_custkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'schedule' WHEN 2 THEN 'gitops' ELSE 'api' END AS "trigger",
  {_epoch('o_orderdate')} AS created_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {_epoch('o_orderdate')} + 60 + o_custkey % 3600 END AS finished_at,
  '/runs/' || CAST(o_orderkey AS VARCHAR) AS run_dir
FROM orders"""),
    "app_runs": (["runs"], """
SELECT r.*, o.o_custkey AS app_name FROM runs r JOIN orders o ON o.o_orderkey = r.run_id"""),
    "attempts": ([], f"""
SELECT l_orderkey AS run_id, 't' || CAST(l_linenumber AS VARCHAR) AS task_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS attempt,
  {_epoch('l_shipdate')} AS started_at,
  {_epoch('l_shipdate')} + CAST(l_quantity AS BIGINT) AS finished_at,
  l_linestatus AS line_status,
  CASE WHEN l_returnflag <> 'R' THEN '{{"ok": true, "result": {{"value": ' || CAST(l_partkey AS VARCHAR) || '}}}}'
    WHEN l_partkey % 4 = 0 THEN NULL
    WHEN l_partkey % 4 = 1 THEN '{{"ok": false, "error": "ConnectionError: upstream API returned 503"}}'
    WHEN l_partkey % 4 = 2 THEN '{{"ok": false, "error": "GitError: git fetch failed: Permission denied (publickey)"}}'
    ELSE '{{"ok": false, "error": "RuntimeError: failed on purpose"}}' END AS envelope
FROM lineitem"""),
    "tasks": ([], f"SELECT * FROM (VALUES {_TASKS}) AS t(dag_id, task_id, retries)"),
    "edges": ([], f"SELECT * FROM (VALUES {_EDGES}) AS e(dag_id, upstream, downstream)"),
    "task_states": (["runs", "attempts", "tasks"], """
SELECT r.run_id, r.dag_id, t.task_id,
  CASE WHEN l.run_id IS NULL THEN 'pending'
    WHEN l.envelope LIKE '{"ok": true%' THEN 'success'
    WHEN r.state = 'running' AND l.line_status = 'O' THEN 'running'
    ELSE 'failed' END AS state,
  coalesce(l.attempt, 0) AS try_number, l.started_at,
  CASE WHEN r.state = 'running' AND l.line_status = 'O' AND (l.envelope IS NULL OR l.envelope NOT LIKE '{"ok": true%')
    THEN NULL ELSE l.finished_at END AS finished_at
FROM runs r JOIN tasks t ON r.dag_id = t.dag_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY attempt DESC) AS rn FROM attempts) l
  ON l.run_id = r.run_id AND l.task_id = t.task_id AND l.rn = 1"""),
    "run_steps": ([], """
SELECT o_custkey AS dag_id, o_orderkey AS task_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS i FROM orders"""),
    "edges_big": (["run_steps"], """
SELECT c.dag_id, p.task_id AS upstream, c.task_id AS downstream
FROM run_steps c JOIN run_steps p ON c.dag_id = p.dag_id AND p.i = c.i // 2
UNION
SELECT c.dag_id, p.task_id AS upstream, c.task_id AS downstream
FROM run_steps c JOIN run_steps p ON c.dag_id = p.dag_id AND c.i % 3 = 0 AND p.i = c.i - 1"""),
    "edges_faulty": (["run_steps", "edges_big"], """
SELECT * FROM edges_big
UNION ALL SELECT a.dag_id, a.task_id, b.task_id FROM run_steps a JOIN run_steps b ON a.dag_id = b.dag_id
  WHERE a.dag_id % 7 = 0 AND a.i = 4 AND b.i = 2
UNION ALL SELECT dag_id, task_id, task_id FROM run_steps WHERE dag_id % 11 = 0 AND i = 3
UNION ALL SELECT dag_id, -1 - task_id, task_id FROM run_steps WHERE dag_id % 13 = 0 AND i = 1"""),
    "schedules": ([], f"""
SELECT c_custkey AS dag_id,
  CASE c_custkey % 11 WHEN 0 THEN '30s' WHEN 1 THEN '5m' WHEN 2 THEN '2h' WHEN 3 THEN '1d' WHEN 4 THEN '@hourly'
    WHEN 5 THEN '@daily' WHEN 6 THEN '@weekly' WHEN 7 THEN '@once' WHEN 8 THEN ' 1.5h ' WHEN 9 THEN '*/5 * * * *' END AS schedule,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {NOW} - c_custkey * 60 END AS last_run_at
FROM customer"""),
    "parsed_schedules": (["schedules"], """
SELECT dag_id, schedule, last_run_at,
  CASE schedule WHEN '@hourly' THEN 3600.0::DOUBLE WHEN '@daily' THEN 86400.0 WHEN '@weekly' THEN 604800.0 WHEN '@once' THEN NULL
    ELSE CASE WHEN regexp_full_match(trim(schedule), '[0-9]+([.][0-9]+)?[smhd]')
      THEN CAST(left(trim(schedule), length(trim(schedule)) - 1) AS DOUBLE)
        * CASE right(trim(schedule), 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END END AS seconds,
  schedule IS NOT NULL AND schedule NOT IN ('@hourly', '@daily', '@weekly', '@once')
    AND NOT regexp_full_match(trim(schedule), '[0-9]+([.][0-9]+)?[smhd]') AS bad_schedule
FROM schedules"""),
    "due_schedules": (["parsed_schedules"], f"""
SELECT *, CASE WHEN schedule = '@once' THEN last_run_at IS NULL WHEN seconds IS NULL THEN false
  ELSE last_run_at IS NULL OR {NOW} - last_run_at >= seconds END AS due FROM parsed_schedules"""),
    "revisions": ([], """
SELECT c_custkey AS app_name, c_mktsegment AS dag_id, md5('head' || CAST(c_custkey AS VARCHAR)) AS desired,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 < 3 THEN md5('head' || CAST(c_custkey AS VARCHAR))
    ELSE md5('old' || CAST(c_custkey AS VARCHAR)) END AS applied
FROM customer"""),
    "model_versions": ([], """
SELECT p_brand AS name,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR) AS version,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS kind,
  CAST(p_size AS DOUBLE) / 50.0 AS accuracy,
  CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'iris' END AS experiment_tag,
  p_partkey AS source_run
FROM part"""),
    "candidates": ([], """
SELECT l_orderkey AS run_id, 'train_' || CAST(l_linenumber AS VARCHAR) AS task_id, l_returnflag AS kind,
  CAST(CAST(max(l_quantity) AS INT) AS DOUBLE) / 50.0 AS accuracy
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag"""),
    "metrics_log": ([], """
SELECT user_id AS tracking_run, event_type AS metric_key, value AS metric_value, event_id AS step, ts AS logged_at, props
FROM events"""),
    "latest_metrics": (["metrics_log"], """
SELECT tracking_run, metric_key, metric_value, step FROM (SELECT *, row_number() OVER
  (PARTITION BY tracking_run, metric_key ORDER BY logged_at DESC, step DESC) AS rn FROM metrics_log) m WHERE rn = 1"""),
    "doc_features": ([], f"SELECT doc_id, lang, {_LETTER_SQL} FROM documents"),
    "split_ranks": ([], """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
FROM documents"""),
    "split_quota": ([], """
SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) <= n_train - sum(q) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT lang, n_train, CAST(n_c AS HUGEINT) * n_train // n AS q, CAST(n_c AS HUGEINT) * n_train % n AS rem
  FROM (SELECT lang, count(*) AS n_c, sum(count(*)) OVER () AS n,
          sum(count(*)) OVER () - CAST(ceil(sum(count(*)) OVER () * 0.25) AS BIGINT) AS n_train
        FROM documents GROUP BY lang) a) b"""),
    "doc_split": (["split_ranks", "split_quota"], """
SELECT r.doc_id, r.lang, CASE WHEN r.rk <= q.quota THEN 'train' ELSE 'test' END AS split
FROM split_ranks r JOIN split_quota q ON q.lang = r.lang"""),
    "score_requests": ([], """
SELECT vec_id // 4 AS request_id, vec_id,
  CASE WHEN vec_id % 10 = 0 THEN embedding[1:3] ELSE embedding END AS row_values FROM embeddings"""),
    "raw_rows": ([], """
SELECT l_orderkey AS req_id, l_linenumber,
  CAST(l_partkey AS VARCHAR) || ', ' || CAST(l_suppkey AS VARCHAR) || ' '
  || CASE WHEN l_partkey % 9 = 0 THEN 'abc' ELSE CAST(l_linenumber AS VARCHAR) END AS raw
FROM lineitem"""),
    "name_requests": ([], """
SELECT p_partkey AS request_id,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' String ' WHEN 2 THEN 'NONE' WHEN 3 THEN 'no such model'
    ELSE '  ' || p_brand || ' ' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' null' ELSE CAST(p_size AS VARCHAR) END AS version
FROM part"""),
    "step_refs": ([], """
SELECT p_partkey AS part_key,
  CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_name, ' ', '.'))
    WHEN 1 THEN lower(replace(p_name, ' ', '.')) || ':' || p_type
    WHEN 2 THEN lower(replace(p_name, ' ', '.')) || ':' || p_type || '.run'
    ELSE lower(replace(p_name, ' ', '.')) || ':a:b' END AS ref
FROM part"""),
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` behind the definitions of the views it names, in order of need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = VIEWS[name]
        for need in needs:
            add(need)
        done[name] = text

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    if not ctes:
        return sql
    if recursive:  # the query brings its own recursive members
        return f"{head}{ctes},\n{sql.strip()}"
    return f"{head}{ctes}\n{sql.strip()}"
