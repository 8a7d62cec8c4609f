"""Projections and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import scalars as S
from runloom.operators import learn
from runloom.plans.catalog import query
from runloom.session import new_dir
from runloom.sources import files
from runloom.sources import tables as V

WIDE = [f"x{i}" for i in range(64)]
CLASS_NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven"]
_LETTER_COLS = ", ".join(V.FEATURES)


@query("split_target", "P1", f"SELECT doc_id, {_LETTER_COLS} FROM doc_features", "doc_features")
def split_target(spark: SparkSession, sf: str) -> DataFrame:
    return V.doc_features(spark, sf).drop("lang")


@query(
    "parse_rows",
    "P2",
    """
SELECT req_id, l_linenumber, raw, CAST(3 AS BIGINT) AS n_values, v[1]::DOUBLE AS v0, v[2]::DOUBLE AS v1,
  TRY_CAST(v[3] AS DOUBLE) AS v2, TRY_CAST(v[3] AS DOUBLE) IS NULL AS rejected
FROM (SELECT *, list_filter(string_split(replace(raw, ',', ' '), ' '), lambda x: x <> '') AS v FROM raw_rows) p""",
    "raw_rows",
)
def parse_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.raw_rows(spark, sf).withColumn("v", S.parse_row(F.col("raw")))
    return rows.select(
        "req_id",
        "l_linenumber",
        "raw",
        F.size("v").cast("bigint").alias("n_values"),
        *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)],
        S.is_rejected(F.col("v")).alias("rejected"),
    )


@query(
    "row_width",
    "P3",
    f"""
SELECT request_id, vec_id, CAST(len(row_values) AS BIGINT) AS width,
  CASE WHEN len(row_values) <> 64 THEN 'expected 64 values ({", ".join(WIDE)}), got ' || len(row_values) END AS message,
  bool_and(len(row_values) = 64) OVER (PARTITION BY request_id) AS accepted
FROM score_requests""",
    "score_requests",
)
def row_width(spark: SparkSession, sf: str) -> DataFrame:
    rows = learn.split_by_width(V.score_requests(spark, sf), "row_values", WIDE, "request_id")
    return rows.select("request_id", "vec_id", F.size("row_values").cast("bigint").alias("width"), "message", "accepted")


@query(
    "decode_class",
    "P4",
    f"SELECT vec_id, label, CASE WHEN label < {len(CLASS_NAMES)} THEN ({CLASS_NAMES!r})[label + 1] END AS class_name FROM embeddings",
)
def decode_class(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return V.table(spark, sf, "embeddings").select(
        "vec_id", "label", S.decode_class(names, F.col("label")).alias("class_name")
    )


@query(
    "blank_names",
    "P5",
    """
SELECT request_id, coalesce(CASE WHEN lower(trim(name)) NOT IN ('', 'string', 'null', 'none') THEN trim(name) END, 'default') AS name,
  CASE WHEN lower(trim(version)) NOT IN ('', 'string', 'null', 'none') THEN trim(version) END AS version
FROM name_requests""",
    "name_requests",
)
def blank_names(spark: SparkSession, sf: str) -> DataFrame:
    return V.name_requests(spark, sf).select(
        "request_id",
        F.coalesce(S.given(F.col("name")), F.lit("default")).alias("name"),
        S.given(F.col("version")).alias("version"),
    )


@query(
    "format_score",
    "P6",
    """
SELECT name, version, printf('%.4f', accuracy) AS accuracy_text, printf('%.3f', accuracy) AS confidence_text
FROM model_versions""",
    "model_versions",
)
def format_score(spark: SparkSession, sf: str) -> DataFrame:
    return V.model_versions(spark, sf).select(
        "name",
        "version",
        S.fixed_text(F.col("accuracy"), 4).alias("accuracy_text"),
        S.fixed_text(F.col("accuracy"), 3).alias("confidence_text"),
    )


@query(
    "run_key",
    "P7",
    """
SELECT run_id, dag_id || '__' || strftime(make_timestamp(created_at * 1000000), '%Y%m%dT%H%M%S') || '__'
  || left(md5(dag_id || '|' || created_at || '|' || run_id), 6) AS run_key
FROM runs""",
    "runs",
)
def run_key(spark: SparkSession, sf: str) -> DataFrame:
    return V.runs(spark, sf).select(
        "run_id", S.run_key(F.col("dag_id"), F.col("created_at"), F.col("run_id")).alias("run_key")
    )


@query("parse_schedule", "P8", "SELECT dag_id, schedule, seconds, bad_schedule FROM parsed_schedules", "parsed_schedules")
def parse_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return V.schedules(spark, sf).select(
        "dag_id",
        "schedule",
        S.schedule_seconds(F.col("schedule")).alias("seconds"),
        S.is_bad_schedule(F.col("schedule")).alias("bad_schedule"),
    )


def _age_sql(at: str, now: str) -> str:
    d = f"CAST({now} - {at} AS DOUBLE)"
    units = " ".join(
        f"WHEN {d} >= {n} THEN CAST(CAST(round_even({d} / {n}, 0) AS BIGINT) AS VARCHAR) || '{u} ago'"
        for u, n in (("d", 86400), ("h", 3600), ("m", 60))
    )
    return f"CASE WHEN {at} IS NULL THEN '-' {units} ELSE CAST(CAST({d} AS BIGINT) AS VARCHAR) || 's ago' END"


@query(
    "age_label",
    "P9",
    f"""
SELECT run_id, {_age_sql('created_at', V.NOW)} AS created, {_age_sql('finished_at', V.NOW)} AS finished,
  {_age_sql('created_at', f'coalesce(finished_at, {V.NOW})')} AS created_at_finish
FROM runs""",
    "runs",
)
def age_label(spark: SparkSession, sf: str) -> DataFrame:
    c, f, now = F.col("created_at"), F.col("finished_at"), F.lit(V.NOW)
    return V.runs(spark, sf).select(
        "run_id",
        S.age_label(c, now).alias("created"),
        S.age_label(f, now).alias("finished"),
        S.age_label(c, F.coalesce(f, now)).alias("created_at_finish"),
    )


@query(
    "durations",
    "P10",
    f"""
SELECT run_id, NULL AS task_id, NULL AS attempt, coalesce(finished_at, {V.NOW}) - created_at AS seconds FROM runs
UNION ALL SELECT run_id, task_id, attempt, finished_at - started_at FROM attempts""",
    "runs attempts",
)
def durations(spark: SparkSession, sf: str) -> DataFrame:
    per_run = V.runs(spark, sf).select(
        "run_id",
        F.lit(None).cast("string").alias("task_id"),
        F.lit(None).cast("bigint").alias("attempt"),
        S.run_seconds(F.col("created_at"), F.col("finished_at"), F.lit(V.NOW)).alias("seconds"),
    )
    per_task = V.attempts(spark, sf).select(
        "run_id", "task_id", "attempt", S.task_seconds(F.col("started_at"), F.col("finished_at")).alias("seconds")
    )
    return per_run.unionByName(per_task)


@query(
    "decode_result",
    "P11",
    """
SELECT run_id, task_id, attempt, CASE WHEN envelope LIKE '{"ok": true%' THEN
  CAST(json_extract_string(envelope, '$.result.value') AS BIGINT) END AS value
FROM attempts""",
    "attempts",
)
def decode_result(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.coalesce(F.get_json_object("envelope", "$.result"), F.lit(""))
    return V.attempts(spark, sf).select(
        "run_id",
        "task_id",
        "attempt",
        F.try_variant_get(S.decode_result(stored), "$.value", "bigint").alias("value"),
    )


_ERROR_SQL = "json_extract_string(envelope, '$.error')"


@query(
    "error_class",
    "P12",
    f"""
SELECT run_id, task_id, attempt, coalesce(regexp_matches(lower({_ERROR_SQL}),
  'could not read username|authentication failed|permission denied|terminal prompts disabled|repository not found'), false) AS auth_failure
FROM attempts""",
    "attempts",
)
def error_class(spark: SparkSession, sf: str) -> DataFrame:
    return V.attempts(spark, sf).select(
        "run_id", "task_id", "attempt", S.is_auth_failure(F.get_json_object("envelope", "$.error")).alias("auth_failure")
    )


@query("log_tail", "P13", "SELECT doc_id, right(text, 2000) AS tail FROM documents")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", S.log_tail(F.col("text")).alias("tail"))


@query(
    "split_ref",
    "P14",
    """
SELECT part_key, ref, split_part(ref, ':', 1) AS module_name,
  CASE WHEN strpos(ref, ':') > 0 THEN substr(ref, strpos(ref, ':') + 1) ELSE '' END AS function_name
FROM step_refs""",
    "step_refs",
)
def split_ref(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.col("ref")
    return V.step_refs(spark, sf).select(
        "part_key", "ref", S.ref_module(ref).alias("module_name"), S.ref_function(ref).alias("function_name")
    )


@query(
    "error_parts",
    "P15",
    f"""
SELECT run_id, task_id, attempt, split_part({_ERROR_SQL}, ': ', 1) AS error_type,
  substr({_ERROR_SQL}, strpos({_ERROR_SQL}, ': ') + 2) AS error_message
FROM attempts""",
    "attempts",
)
def error_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.attempts(spark, sf).withColumn("error", F.get_json_object("envelope", "$.error"))
    return rows.select(
        "run_id",
        "task_id",
        "attempt",
        S.error_type(F.col("error")).alias("error_type"),
        S.error_message(F.col("error")).alias("error_message"),
    )


@query(
    "tag_codec",
    "P16",
    """
SELECT name, version, CASE WHEN experiment_tag = '' THEN '["' || kind || '","x"]' END AS features_tag,
  CASE WHEN source_run % 7 = 0 THEN 'own' WHEN experiment_tag = '' AND kind IS NOT NULL THEN kind || '+x' ELSE '' END AS features
FROM model_versions""",
    "model_versions",
)
def tag_codec(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.model_versions(spark, sf).withColumn(
        "features_tag",
        F.when((F.col("experiment_tag") == "") & F.col("kind").isNotNull(), F.to_json(F.array("kind", F.lit("x")))),
    )
    tags = F.map_filter(F.create_map(F.lit("features"), F.col("features_tag")), lambda _k, v: v.isNotNull())
    own = F.when(F.col("source_run") % 7 == 0, F.array(F.lit("own")))
    return rows.select(
        "name", "version", "features_tag", F.array_join(S.tag_list(tags, "features", own), "+").alias("features")
    )


@query(
    "tag_defaults",
    "P17",
    """
SELECT name, version, coalesce(kind, 'PipelineModel') AS kind, coalesce(nullif(experiment_tag, ''), 'inference') AS experiment
FROM model_versions""",
    "model_versions",
)
def tag_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return V.model_versions(spark, sf).select(
        "name",
        "version",
        S.kind_of(F.col("kind")).alias("kind"),
        S.experiment_of(F.col("experiment_tag")).alias("experiment"),
    )


@query("read_scale", "P18", "SELECT l_partkey * 2 AS value FROM lineitem")
def read_scale(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "numbers")
    V.table(spark, sf, "lineitem").select(F.format_string(" %d ", "l_partkey").alias("value")).write.text(path)
    return files.read_scale(spark, path)
