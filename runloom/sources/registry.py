"""Tracking log and model registry as append-only tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators.contract import contract_of
from runloom.operators.keyed import latest
from runloom.operators.select import latest_version, next_version
from runloom.session import local_table
from runloom.sources.files import path_exists

LOG_SCHEMA = (
    "tracking_run string, dag_id string, run_id string, task_id string,"
    " kind string, key string, value string, step bigint, logged_at timestamp"
)
VERSION_SCHEMA = "name string, version bigint, uri string, tags map<string,string>"


# --- tracking ----------------------------------------------------------------
def log_rows(
    spark: SparkSession,
    tracking_run: str,
    ids: Mapping[str, str],
    params: Mapping[str, object] = {},
    metrics: Mapping[str, float] = {},
    tags: Mapping[str, str] = {},
    step: int = 0,
) -> DataFrame:
    """Params, metrics and tags of one task run in long form, with the run's ids."""
    entries = [
        (tracking_run, ids["dag_id"], ids["run_id"], ids["task_id"], kind, k, str(v), step)
        for kind, found in (("param", params), ("metric", metrics), ("tag", tags))
        for k, v in found.items()
    ]
    schema = LOG_SCHEMA.rsplit(",", 1)[0]
    return local_table(spark, entries, schema).withColumn("logged_at", F.current_timestamp())


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("kind").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def current_metrics(log: DataFrame, keys: Sequence[str] = ("tracking_run", "metric_key")) -> DataFrame:
    """Last value written per run and key."""
    return latest(log, list(keys), ["logged_at", "step"])


def find_by_tag(rows: DataFrame, tags: str, key: str, value: str) -> DataFrame:
    """Rows whose JSON tag column holds ``value`` under ``key``."""
    return rows.filter(F.get_json_object(tags, f"$.{key}") == value)


def runs_with_metrics(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Run states beside the current metrics of the same run."""
    m = current_metrics(log).select(F.col("tracking_run").alias("run_id"), "metric_key", "metric_value")
    return runs.join(m, "run_id")


# --- registry ----------------------------------------------------------------
def version_tags(run_id: Column, dag_id: Column, accuracy: Column, kind: Column, features: Column, classes: Column) -> Column:
    """Tag map of a version; entries without a value are left out."""
    full = F.create_map(
        F.lit("run_id"), run_id.cast("string"),
        F.lit("dag_id"), dag_id.cast("string"),
        F.lit("accuracy"), S.fixed_text(accuracy, 4),
        F.lit("kind"), kind,
        F.lit("features"), features,
        F.lit("classes"), classes,
    )
    return F.map_filter(full, lambda _k, v: v.isNotNull())


def append_versions(rows: DataFrame, path: str) -> None:
    rows.select("name", F.col("version").cast("bigint").alias("version"), "uri", "tags").write.mode("append").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], VERSION_SCHEMA)
    return spark.read.schema(VERSION_SCHEMA).parquet(path)


def register(
    model: PipelineModel, base: str, name: str, accuracy: float, tags: DataFrame, threshold: float = fixed.MIN_ACCURACY
) -> DataFrame:
    """Gate, then model files, then the registry row; a refused model leaves nothing.

    ``tags`` is the one-row table with the ``tags`` map.  Returns the new version's row.
    """
    if accuracy < threshold:
        raise ValueError(fixed.BELOW_GATE % (accuracy, threshold))
    spark = tags.sparkSession
    row = next_version(read_versions(spark, f"{base}/versions"), tags.withColumn("name", F.lit(name)), [F.lit(0)])
    version = row.first()["version"]
    model.write().save(model_path(base, name, version))
    new = tags.select(F.lit(name).alias("name"), F.lit(version).alias("version"), S.model_uri(F.lit(name), F.lit(version)).alias("uri"), "tags")
    append_versions(new, f"{base}/versions")
    return read_versions(spark, f"{base}/versions").filter((F.col("name") == name) & (F.col("version") == version))


def resolve_models(requests: DataFrame, versions: DataFrame, default_name: str) -> DataFrame:
    """Request name and version to a registry row, or the reason there is none.

    ``requests(request_id, name, version)``; blanks mean the default name and the
    newest version.
    """
    asked = requests.select(
        "request_id",
        F.coalesce(S.given(F.col("name")), F.lit(default_name)).alias("name"),
        S.given(F.col("version")).alias("version"),
    )
    known = versions.withColumn("version", F.col("version").cast("string"))
    pinned = asked.filter(F.col("version").isNotNull()).join(known, ["name", "version"], "left")
    newest = (
        asked.filter(F.col("version").isNull()).drop("version").join(latest_version(known), "name", "left")
    )
    missing = F.when(
        F.col("tags").isNull(),
        F.when(F.col("version").isNull(), F.format_string(fixed.NO_MODEL, F.col("name"))).otherwise(
            F.format_string(fixed.NO_VERSION, F.col("version"), F.col("name"))
        ),
    )
    return pinned.unionByName(newest.select(*pinned.columns)).select(
        "request_id",
        "name",
        "version",
        "uri",
        F.when(F.col("tags").isNotNull(), S.kind_of(F.try_element_at("tags", F.lit("kind")))).alias("kind"),
        F.try_element_at("tags", F.lit("accuracy")).alias("accuracy"),
        F.when(F.col("tags").isNotNull(), S.tag_list(F.col("tags"), "features")).alias("features"),
        F.when(F.col("tags").isNotNull(), S.tag_list(F.col("tags"), "classes")).alias("classes"),
        F.try_element_at("tags", F.lit("run_id")).alias("source_run"),
        F.when(F.col("tags").isNotNull(), S.experiment_of(F.try_element_at("tags", F.lit("dag_id")))).alias("experiment"),
        missing.alias("error"),
    )


def load_model(spark: SparkSession, base: str, name: str | None = None, version: str | None = None, default_name: str = "default") -> tuple[dict, PipelineModel]:
    """The resolved row and its model; ``LookupError`` when nothing is registered.

    ``features`` are the columns the model itself names, if it does, else those of its tag.
    """
    asked = local_table(spark, [(0, name, version)], "request_id int, name string, version string")
    row = resolve_models(asked, read_versions(spark, f"{base}/versions"), default_name).first().asDict()
    if row["error"]:
        raise LookupError(row["error"])
    model = PipelineModel.load(model_path(base, row["name"], row["version"]))
    own = contract_of(model)
    return row | ({"features": own.schema().names} if own else {}), model


def model_path(base: str, name: str, version: object) -> str:
    return f"{base}/models/{name}/{version}"
