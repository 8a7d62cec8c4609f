"""Ranking, versions and candidate tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators.keyed import nest, rank_rows


def _bake_off_order() -> list[Column]:
    return [F.desc_nulls_last("accuracy"), F.col("task_id"), F.col("kind")]


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Winner per run: highest accuracy, ties by task id, then kind; a null score never wins over a number.

    ``min_by`` folds before the shuffle, so a run with many candidates is cheap.
    """
    rest = [c for c in candidates.columns if c != "run_id"]
    return (
        candidates.filter(F.col("task_id").startswith(fixed.CANDIDATE_PREFIX))
        .groupBy("run_id")
        .agg(F.min_by(F.struct(*rest), F.struct(F.col("accuracy").isNull(), -F.col("accuracy"), "task_id", "kind")).alias("b"))
        .select("run_id", "b.*")
    )


def bake_off(candidates: DataFrame) -> DataFrame:
    """Ranked candidate list per run."""
    kept = candidates.filter(F.col("task_id").startswith(fixed.CANDIDATE_PREFIX))
    return nest(kept, ["run_id"], _bake_off_order(), F.struct("task_id", "kind", "accuracy"), "candidates")


def union_scores(scores: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), scores)


def metrics_long(candidates: DataFrame) -> DataFrame:
    """One row per run and candidate task, whatever their names: its score, and whether it won the run."""
    kept = candidates.filter(F.col("task_id").startswith(fixed.CANDIDATE_PREFIX))
    scores = kept.groupBy("run_id", "task_id").agg(F.max("accuracy").alias("test_accuracy"))
    return scores.join(best_candidate(candidates).select("run_id", F.col("task_id").alias("winner")), "run_id")


def metrics_wide(candidates: DataFrame, tasks: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """One row per run: a score column per candidate task, the best score and the winner.

    Without ``tasks`` the columns are the names found; above ``most`` names this
    is refused and ``metrics_long`` has the rows.
    """
    kept = candidates.filter(F.col("task_id").startswith(fixed.CANDIDATE_PREFIX))
    if tasks is None:
        tasks = sorted(r[0] for r in kept.select("task_id").distinct().limit(most + 1).collect())
        if len(tasks) > most:
            raise ValueError(f"more than {most} candidate names; use metrics_long")
    best = F.min_by("task_id", F.struct(F.col("accuracy").isNull(), -F.col("accuracy"), "task_id"))
    return (
        kept.groupBy("run_id")
        .agg(
            *[
                F.max(F.when(F.col("task_id") == t, F.col("accuracy"))).alias(f"test_accuracy.{t}")
                for t in tasks
            ],
            F.max("accuracy").alias("best_accuracy"),
            best.alias("winner"),
        )
    )


def accuracy(rows: DataFrame, prediction: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows where the prediction is the label."""
    hit = F.coalesce(F.col(prediction) == F.col(label), F.lit(False)).cast("double")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def recent_runs(runs: DataFrame, dag_id: str | None = None, limit: int = fixed.RECENT_RUNS) -> DataFrame:
    """Newest runs first; the run id breaks ties."""
    kept = runs if dag_id is None else runs.filter(F.col("dag_id") == dag_id)
    return kept.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def latest_version(versions: DataFrame) -> DataFrame:
    """Highest version per name, by number ('10' beats '2')."""
    rest = [c for c in versions.columns if c != "name"]
    return (
        versions.groupBy("name")
        .agg(F.max_by(F.struct(*rest), F.col("version").cast("bigint")).alias("v"))
        .select("name", "v.*")
    )


def next_version(versions: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Numbers a batch of promotions on from the highest version of each name.

    One writer per registry: two at once would mint the same number.
    """
    top = versions.groupBy("name").agg(F.max(F.col("version").cast("bigint")).alias("_top"))
    ranked = rank_rows(batch, ["name"], order, "_n")
    return ranked.join(top, "name", "left").select(
        *batch.columns, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint").alias("version")
    )


def gate(candidates: DataFrame, threshold: float = fixed.MIN_ACCURACY) -> DataFrame:
    """``passed`` and, below the threshold, the refusal text; equal passes."""
    passed = F.col("accuracy") >= threshold
    refusal = F.format_string(fixed.BELOW_GATE, "accuracy", F.lit(str(threshold)))
    return candidates.withColumn("passed", passed).withColumn("refusal", F.when(~passed, refusal))


def parse_requests(requests: DataFrame, rows: DataFrame, request: str, order: str, text: str) -> DataFrame:
    """Each request with the number of its text rows and why it is refused, if it is: ``(request, n, refusal)``.

    A request without rows has nothing to predict; the first row by ``order`` with a token that is no number refuses the whole.
    """
    values = S.parse_row(F.col(text))
    bad = F.when(S.is_rejected(values), F.struct(F.col(order), F.col(text)))
    per = rows.groupBy(request).agg(F.count(F.lit(1)).alias("n"), F.min(bad).alias("_bad"))
    found = requests.join(per, request, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    refusal = F.when(F.col("n") == 0, fixed.NO_ROWS).when(F.col("_bad").isNotNull(), F.format_string(fixed.NOT_A_NUMBER, F.col("_bad")[text]))
    return found.select(request, "n", refusal.alias("refusal"))
