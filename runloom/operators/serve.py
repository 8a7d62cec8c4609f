"""Scoring a table of requests, each answered by the model version it asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.operators import learn
from runloom.operators.contract import contract_of
from runloom.session import stage_counted
from runloom.sources import registry

ANSWER = ["request_id", "row_id", "name", "version", "uri", "prediction", "label", "confidence", "refusal"]


def route(requests: DataFrame, rows: DataFrame, versions: DataFrame, default_name: str) -> DataFrame:
    """Every row of every request beside its resolved version, with ``refusal``: why the request gets no answer.

    ``requests(request_id, name, version)``, ``rows(request_id, row_id, row_values)``. A request is refused as a
    whole: its model is not registered, it has no rows, or a row is not as wide as the model's feature list
    (the first such row is named). Requests without rows are one row with a null ``row_id``; a null array has no values.
    """
    resolved = registry.resolve_models(requests, versions, default_name).select("request_id", "name", "version", "uri", "features", "classes", "error")
    beside = resolved.join(rows.select("request_id", "row_id", "row_values", F.lit(True).alias("_row")), "request_id", "left")
    width = F.coalesce(F.when(F.col("row_values").isNotNull(), F.size("row_values")), F.lit(0))
    wrong = F.format_string(fixed.WIDTH, F.size("features"), F.array_join("features", ", "), width)
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_row").isNull(), fixed.NO_ROWS)
        .when(width != F.size("features"), wrong)
    )
    judged = beside.withColumn("_message", message).drop("_row", "error")
    first = F.min_by("_message", F.struct("row_id", "_message"))
    refused = judged.filter(F.col("_message").isNotNull()).groupBy("request_id").agg(first.alias("refusal"))
    return judged.drop("_message").join(refused, "request_id", "left")


def answer(spark: SparkSession, base: str, requests: DataFrame, rows: DataFrame, default_name: str) -> DataFrame:
    """``ANSWER`` columns for every row: label and confidence of the version its request resolves to, or the refusal.

    The routed rows are written once, by version, so each model reads its own slice only. The driver holds the
    versions in use and loads each once; their rows stay in the table.
    """
    routed = route(requests, rows, registry.read_versions(spark, f"{base}/versions"), default_name)
    served = F.col("refusal").isNull()
    split = routed.withColumn("slice", F.when(served, F.concat_ws("/", "name", "version")))
    held, _ = stage_counted(split, {"rows": F.count(F.lit(1))}, "routed", partition_by=["slice"])
    used = held.filter(F.col("slice").isNotNull()).select("slice", "name", "version", "features", "classes").distinct().collect()
    parts = [
        held.filter(F.col("slice").isNull()).select(
            "request_id", "row_id", "name", "version", "uri",
            F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"), "refusal",
        )
    ]
    for v in sorted(used, key=lambda v: v["slice"]):
        model = PipelineModel.load(registry.model_path(base, v["name"], v["version"]))
        own = contract_of(model)
        features = own.schema().names if own else v["features"]
        mine = held.filter(F.col("slice") == v["slice"]).drop("features", "classes", "slice")
        scored = learn.predict(model, learn.spread_values(mine, "row_values", features).drop("row_values"), features, v["classes"])
        parts.append(scored.select(*ANSWER))
    return reduce(DataFrame.unionByName, parts)
