"""Predictions with a trace beside them; a broken trace never costs an answer."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def trace_rows(scored: DataFrame, model_uri: str, features: list[str]) -> DataFrame:
    """What was asked and answered: model, inputs, outputs."""
    return scored.select(
        F.lit(model_uri).alias("model_uri"),
        F.struct(F.col("row"), F.array(*[F.lit(f) for f in features]).alias("features")).alias("inputs"),
        F.struct("prediction", "label").alias("outputs"),
    )


def write_scored(
    scored: DataFrame, out: str, model_uri: str, features: list[str], traces: str | None = None
) -> tuple[DataFrame, bool]:
    """Commits the predictions, then the traces if asked for.

    Returns the committed predictions and whether the traces were kept.  Traces are
    made from the committed files, so the model runs once.
    """
    scored.write.mode("overwrite").parquet(out)
    kept = scored.sparkSession.read.schema(scored.schema).parquet(out)
    if traces is None:
        return kept, False
    try:
        trace_rows(kept, model_uri, features).write.mode("overwrite").parquet(traces)
    except Exception:  # noqa: BLE001 - any sink may break in any way
        log.warning("traces of %s were not kept", out, exc_info=True)
        return kept, False
    return kept, True
