from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from runloom.operators import steps


def test_steps_pass_tables_and_params(spark):
    double = lambda up, factor: up["base"].withColumn("id", F.col("id") * factor)
    out = steps.run_step(double, {"base": spark.range(3)}, factor=2)
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 4]


@pytest.mark.parametrize("with_batch", [True, False])
def test_a_failing_row_is_a_record(spark, with_batch):
    def half(x):
        if x == 3:
            raise ValueError("no three")
        return x / 2

    def halves(xs: pd.Series):
        if (xs == 3).any():
            raise RuntimeError("somewhere")
        return xs / 2

    rows = spark.range(6).repartition(3).withColumn("x", F.col("id"))
    out = steps.row_function(rows, half, ["id"], ["x"], "double", halves if with_batch else None)
    got = {r["id"]: (r["ok"], r["result"], r["error"]) for r in out.collect()}
    assert got[3] == (False, None, "ValueError: no three")
    assert all(got[i] == (True, i / 2, None) for i in (0, 1, 2, 4, 5))


def test_row_function_on_no_rows(spark):
    out = steps.row_function(spark.range(0), lambda x: x, ["id"], ["id"], "long")
    assert out.collect() == []


def test_group_function_does_not_depend_on_batches(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.col("id").cast("double").alias("x"),
    )
    mean = lambda s: [s[1] / s[0]]
    sums = lambda g: [len(g), g["x"].sum()]
    got = {r["k"]: r["m"] for r in steps.group_function(rows.repartition(7), ["k"], sums, mean, 2, ["m"]).collect()}
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.avg("x").alias("m")).collect()}
    assert got == pytest.approx(want)


def labelled(spark, n=3000):
    """Three groups, one with two thirds of the rows and one with a null key, and noisy 0/1 targets of two inputs."""
    rng = np.random.default_rng(5)
    group = np.where(np.arange(n) % 3 != 2, "hot", np.where(np.arange(n) % 2 == 0, "small", None))
    x = rng.normal(size=(n, 2))
    slope = np.where(group == "hot", 2.0, -1.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + slope * x[:, 0] + 0.5 * x[:, 1])))).astype(float)
    rows = [(g, float(a), float(b), float(t)) for g, (a, b), t in zip(group, x, y)]
    return spark.createDataFrame(rows, "kind string, a double, b double, y double")


@pytest.mark.parametrize("penalty", [0.0, 0.1])
def test_logistic_groups_equal_single_fits(spark, penalty):
    rows = labelled(spark)
    out = steps.group_rounds(rows.repartition(5), ["kind"], steps.logistic(["a", "b"], "y", penalty))
    got = {r["kind"]: r for r in out.collect()}
    assert set(got) == {"hot", "small", None} and all(r["converged"] for r in got.values())
    assemble = VectorAssembler(inputCols=["a", "b"], outputCol="f")
    for kind, r in got.items():
        one = assemble.transform(rows.filter(F.col("kind").eqNullSafe(kind)))
        m = LogisticRegression(featuresCol="f", labelCol="y", regParam=penalty, standardization=False, tol=1e-12, maxIter=500).fit(one)
        assert r["weights"] == pytest.approx([m.intercept, *m.coefficients.toArray()], abs=1e-5)


def test_converged_groups_leave_and_open_ones_are_told(spark):
    rows = spark.createDataFrame([("far", float(i)) for i in range(9)] + [("near", 0.0)], "kind string, x double")
    seen = lambda g, w: [len(g), g["x"].sum()]

    def toward_mean(w, s):
        mean = s[1] / s[0]
        step = np.clip(mean - w[0], -1, 1)
        return [w[0] + step], abs(step) < 1e-9

    trainer = steps.RoundTrainer([0.0], seen, toward_mean, 2)
    got = {r["kind"]: (r["weights"], r["rounds"], r["converged"]) for r in steps.group_rounds(rows, ["kind"], trainer).collect()}
    assert got == {"near": ([0.0], 1, True), "far": ([4.0], 5, True)}
    cut = {r["kind"]: (r["weights"], r["rounds"], r["converged"]) for r in steps.group_rounds(rows, ["kind"], trainer, most=2).collect()}
    assert cut == {"near": ([0.0], 1, True), "far": ([2.0], 2, False)}
    assert steps.group_rounds(rows.limit(0), ["kind"], trainer).collect() == []
