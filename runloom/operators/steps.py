"""User code as steps: over tables, over rows that may fail, over groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import new_dir, stage_counted


def run_step(fn: Callable[..., DataFrame], upstream: dict[str, DataFrame], **params) -> DataFrame:
    """Calls a step with its params and the tables of its upstream steps.

    Tables are passed as plans, not data; nothing runs until the result is used.
    """
    return fn(upstream, **params)


def row_function(
    rows: DataFrame,
    fn: Callable,
    keys: Sequence[str],
    inputs: Sequence[str],
    result_type: str,
    batch_fn: Callable[..., Sequence] | None = None,
) -> DataFrame:
    """``fn(*inputs)`` per row; a failing row is a record, not a crash.

    Returns ``(keys, ok, result, error)`` with error ``Type: message``.  With
    ``batch_fn(*columns)`` an Arrow batch is first tried as a whole and only a
    batch that raises goes row by row.
    """
    keys, inputs = list(keys), list(inputs)
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("ok", T.BooleanType()),
            T.StructField("result", T._parse_datatype_string(result_type)),
            T.StructField("error", T.StringType()),
        ]
    )

    def attempt(values: tuple) -> tuple:
        try:
            return True, fn(*values), None
        except Exception as exc:  # noqa: BLE001 - user code may raise anything
            return False, None, f"{type(exc).__name__}: {exc}"

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if batch_fn is not None:
                try:
                    values = batch_fn(*[pdf[c] for c in inputs])
                    yield pdf[keys].assign(ok=True, result=values, error=None)
                    continue
                except Exception:  # noqa: BLE001 - find the rows below
                    pass
            found = [attempt(v) for v in zip(*[pdf[c] for c in inputs])]
            ok, result, error = zip(*found) if found else ((), (), ())
            yield pdf[keys].assign(ok=list(ok), result=pd.Series(list(result), index=pdf.index, dtype=object), error=list(error))

    return rows.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(over, schema)


def group_function(
    rows: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], Sequence[float]],
    finish: Callable[[Sequence[float]], Sequence[float]],
    n_stats: int,
    outputs: Sequence[str],
) -> DataFrame:
    """The same trainer for every group, however large the group.

    ``partial`` turns the rows of a group inside one batch into ``n_stats`` sums,
    Spark adds them up per group, ``finish`` turns the totals into the result.
    """
    keys = list(keys)
    stats = [f"_s{i}" for i in range(n_stats)]
    key_fields = [rows.schema[k] for k in keys]
    partial_schema = T.StructType(key_fields + [T.StructField(s, T.DoubleType()) for s in stats])
    out_schema = T.StructType(key_fields + [T.StructField(o, T.DoubleType()) for o in outputs])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (*(k if isinstance(k, tuple) else (k,)), *map(float, partial(g)))
                for k, g in pdf.groupby(keys, dropna=False, sort=False)
            ]
            yield pd.DataFrame(found, columns=[*keys, *stats])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (*[r[k] for k in keys], *map(float, finish([r[s] for s in stats])))
                for r in pdf.to_dict("records")
            ]
            yield pd.DataFrame(found, columns=[*keys, *outputs])

    totals = rows.mapInPandas(fold, partial_schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in stats])
    return totals.mapInPandas(close, out_schema)


@dataclass(frozen=True)
class RoundTrainer:
    """A trainer in rounds: sums over rows under the present weights, then new weights from the totals.

    ``start`` holds a group's first weights. ``partial(rows, weights)`` gives the sums of some rows of a group,
    ``update(weights, totals)`` the next weights and whether they are final.
    """

    start: Sequence[float]
    partial: Callable[[pd.DataFrame, np.ndarray], Sequence[float]]
    update: Callable[[np.ndarray, np.ndarray], tuple[Sequence[float], bool]]
    n_sums: int


def logistic(inputs: Sequence[str], target: str, penalty: float = 0.0, tol: float = 1e-9) -> RoundTrainer:
    """Logistic regression of a 0/1 target by Newton steps: mean log loss plus ``penalty / 2`` times the squared slopes.

    Weights are the intercept, then a slope per input. A step that would overshoot is halved by ``update`` as long as
    the quadratic model is not to be trusted (a large step), which keeps separable groups finite under a penalty.
    """
    d = len(inputs) + 1
    upper = np.triu_indices(d)
    ridge = penalty * np.diag([0.0] + [1.0] * (d - 1))

    def partial(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(rows)), rows[list(inputs)].to_numpy(np.float64)])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - rows[target].to_numpy(np.float64))
        curvature = (x * (p * (1 - p))[:, None]).T @ x
        return np.concatenate([[len(rows)], gradient, curvature[upper]])

    def update(w: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
        n, gradient = sums[0], sums[1 : d + 1] / sums[0]
        curvature = np.zeros((d, d))
        curvature[upper] = sums[d + 1 :] / n
        curvature = curvature + np.triu(curvature, 1).T + ridge
        step = np.linalg.lstsq(curvature, gradient + ridge @ w, rcond=None)[0]
        size = np.abs(step).max()
        return w - step * min(1.0, 5.0 / max(size, 1e-300)), bool(size <= tol)

    return RoundTrainer([0.0] * d, partial, update, 1 + d + d * (d + 1) // 2)


def group_rounds(rows: DataFrame, keys: Sequence[str], trainer: RoundTrainer, most: int = 50) -> DataFrame:
    """One model per group, all groups advancing together: ``(keys, weights, rounds, converged)``.

    A round is one job: weights join their groups' rows, sums are taken per batch and group, Spark adds them up, and the
    next weights are worked out where a group's totals are. Groups that have converged leave with their rows. However large
    a group or their number, only sums and weights travel; each round's weights are a table of their own. Null keys are a group;
    rows with nulls in what ``partial`` reads are for the caller to drop.
    """
    spark, keys = rows.sparkSession, list(keys)
    base = new_dir(spark, "rounds")
    d, sums = len(trainer.start), [f"_s{i}" for i in range(trainer.n_sums)]
    weights = [f"_w{i}" for i in range(d)]
    key_fields = [rows.schema[k] for k in keys]
    plain = [c for c in rows.columns if c not in keys]
    sums_of, update = trainer.partial, trainer.update  # functions alone go to the workers

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (*(k if isinstance(k, tuple) else (k,)), *g[weights].iloc[0], *map(float, sums_of(g[plain], g[weights].iloc[0].to_numpy(np.float64))))
                for k, g in pdf.groupby(keys, dropna=False, sort=False)
            ]
            yield pd.DataFrame(found, columns=[*keys, *weights, *sums])

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.to_dict("records"):
                w, final = update(np.array([r[c] for c in weights]), np.array([r[c] for c in sums]))
                found.append((*[r[k] for k in keys], [float(v) for v in w], final))
            yield pd.DataFrame(found, columns=[*keys, "weights", "converged"])

    double = T.DoubleType()
    folded = T.StructType(key_fields + [T.StructField(c, double) for c in [*weights, *sums]])
    advanced = T.StructType([*key_fields, T.StructField("weights", T.ArrayType(double)), T.StructField("converged", T.BooleanType())])
    state = rows.select(*keys).distinct().withColumn("weights", F.array(*[F.lit(float(v)) for v in trainer.start]))
    for number in range(most):
        now = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.get("weights", F.lit(i)).alias(w) for i, w in enumerate(weights)])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        joined = rows.join(now, same).select(*rows.columns, *weights)
        totals = joined.mapInPandas(fold, folded).groupBy(*keys).agg(*[F.first(w).alias(w) for w in weights], *[F.sum(s).alias(s) for s in sums])
        moved, counts = stage_counted(totals.mapInPandas(advance, advanced), {"open": F.count_if(~F.col("converged"))}, path=f"{base}/round={number + 1}")
        if counts["open"] == 0 or number + 1 == most:
            break
        state = moved.filter("NOT converged").drop("converged")
    all_rounds = spark.read.schema(T.StructType([*advanced.fields, T.StructField("round", T.IntegerType())])).parquet(base)
    return all_rounds.filter(F.col("converged") | (F.col("round") == number + 1)).withColumnRenamed("round", "rounds").select(*keys, "weights", "rounds", "converged")
