"""Split, train, compare, gate, register, score: MLlib over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators.contract import InputContract
from runloom.operators.keyed import gather, is_small, rank_rows
from runloom.session import local_table, stage

SPLIT_DIGITS = 4  # leading hex digits that name a bucket: 65,536 of them


# --- split -------------------------------------------------------------------
def class_index(rows: DataFrame, label: str, name: str = "target", classes: Sequence | None = None) -> DataFrame:
    """Adds the 0-based place of ``label`` in the sorted list of its values (a null label comes first)."""
    if classes is None:
        found = rank_rows(rows.select(label).distinct(), [], [F.asc_nulls_first(label)], name)
        found = found.withColumn(name, (F.col(name) - 1).cast("int"))
    else:
        schema = T.StructType([rows.schema[label]]).add(name, "integer")
        found = local_table(rows.sparkSession, [(c, i) for i, c in enumerate(classes)], schema)
    found = found.withColumnRenamed(label, "_class")
    return rows.join(found, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def train_quotas(sizes: DataFrame, label: str, share: str = fixed.TEST_SHARE) -> DataFrame:
    """``sizes`` (label, size), one row per class, with the ``quota`` of rows that go to train.

    ``ceil(share * n)`` rows are held out over all classes; what is left is dealt
    by largest remainder, ties by class. Whole numbers throughout; the classes stay a table.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    n = int(sizes.agg(F.coalesce(F.sum(wide(F.col("size"))), F.lit(0))).first()[0])
    n_train = n - ceil(Fraction(share) * n)
    product = wide(F.col("size")) * F.lit(n_train).cast("decimal(19,0)")
    divisor = F.lit(max(n, 1)).cast("decimal(19,0)")
    dealt = sizes.withColumn("_rest", F.pmod(product, divisor)).withColumn("quota", wide((product - F.col("_rest")) / divisor).cast("bigint"))
    left = n_train - (dealt.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    ranked = rank_rows(dealt, [], [F.desc("_rest"), F.asc_nulls_first(label)], "_place")
    return ranked.withColumn("quota", F.col("quota") + (F.col("_place") <= left).cast("bigint")).drop("_rest", "_place")


def split_bounds(
    rows: DataFrame, key: str, label: str, share: str = fixed.TEST_SHARE, seed: int = 0, small: int | None = None
) -> DataFrame:
    """One row per class: ``(label, size, quota, bound_hash, bound_key)``.

    The bound is the last row that trains when the class is ordered by
    ``md5(seed:key)``.  In a large table no class is sorted: rows are counted per
    hash bucket first and only the bucket the bound lies in is ranked. However many
    classes there are, they are rows of tables.
    """
    sizes = stage(rows.groupBy(label).agg(F.count(F.lit(1)).alias("size")), "classes")[0]
    quotas = train_quotas(sizes, label, share)
    wanted = quotas.select(F.col(label).alias("_class"), F.col("quota").alias("place"))
    same = F.col(label).eqNullSafe(F.col("_class"))

    hashed = rows.select(F.col(label), F.col(key), _split_hash(key, seed).alias("_h"))
    if not is_small(rows, small):
        bucket = F.substring("_h", 1, SPLIT_DIGITS)
        before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = hashed.groupBy(label, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
        cuts = stage(
            counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(wanted, same)
            .filter((F.col("_before") < F.col("place")) & (F.col("place") <= F.col("_before") + F.col("n")))
            .select("_class", "_b", (F.col("place") - F.col("_before")).alias("place")),
            "cuts",
        )[0]
        hashed = hashed.join(cuts.select(F.col("_class").alias("_c"), "_b"), F.col(label).eqNullSafe(F.col("_c")))
        hashed = hashed.filter(bucket == F.col("_b")).drop("_c", "_b")
        wanted = cuts.drop("_b")
    ranked = rank_rows(hashed, [label], [F.col("_h"), F.col(key)], "_n")
    last = ranked.join(wanted, same & (F.col("_n") == F.col("place")))
    last = last.select(F.col(label).alias("_class"), F.col("_h").alias("bound_hash"), F.col(key).alias("bound_key"))
    found = quotas.join(last, same, "left").select(label, "size", "quota", "bound_hash", "bound_key")
    return stage(found, "bounds")[0]


def stratified_split(
    rows: DataFrame,
    key: str,
    label: str,
    share: str = fixed.TEST_SHARE,
    seed: int = 0,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split`` = train / test, balanced by class, the same on every run.

    A row trains when its hash is not above its class's bound: the rows themselves
    are neither shuffled nor sorted.
    """
    bounds = split_bounds(rows, key, label, share, seed) if bounds is None else bounds
    b = bounds.select(F.col(label).alias("_class"), "bound_hash", "bound_key")
    at = F.struct(_split_hash(key, seed).alias("h"), F.col(key).alias("k"))
    trains = at <= F.struct(F.col("bound_hash").alias("h"), F.col("bound_key").alias("k"))
    return rows.join(b, F.col(label).eqNullSafe(F.col("_class"))).select(
        *rows.columns,
        F.when(F.col("bound_hash").isNotNull() & trains, "train").otherwise("test").alias("split"),
    )


def _split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


# --- train -------------------------------------------------------------------
def logreg(n_rows: int, max_iter: int = 500) -> LogisticRegression:
    """Multinomial logistic regression; ``1 / n`` is the usual C = 1 penalty."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="target",
        maxIter=max_iter,
        tol=1e-4,
        family="multinomial",
        regParam=1.0 / max(1, n_rows),
        standardization=True,
    )


def tree(max_depth: int = 3, seed: int = 0) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        featuresCol="features", labelCol="target", maxDepth=max_depth, seed=seed, impurity="gini"
    )


@dataclass
class Candidate:
    task_id: str
    kind: str
    model: PipelineModel
    train_accuracy: float
    params: dict


def fit_candidates(
    train: DataFrame, features: Sequence[str], estimators: Mapping[str, Estimator], parallelism: int = 4
) -> list[Candidate]:
    """Fits independent candidates at the same time, as Spark jobs from driver threads.

    Each model begins with the contract of its input: names and types in order, with example rows.
    """
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    spark = train.sparkSession
    train = gather(train)
    contract = InputContract.of(train, features)

    def fit(task_id: str) -> tuple[str, PipelineModel]:
        return task_id, Pipeline(stages=[contract, assemble, estimators[task_id]]).fit(train)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(fit), t) for t in sorted(estimators)]
        models = dict(f.result() for f in done)
    scores = evaluate(train, models)
    return [
        Candidate(
            t,
            type(estimators[t]).__name__,
            models[t],
            scores[t],
            {p.name: v for p, v in estimators[t].extractParamMap().items() if estimators[t].isSet(p)},
        )
        for t in sorted(models)
    ]


@dataclass
class Search:
    """A grid searched by k folds: ``scores(task_id, fold, accuracy)``, and the winner, fitted on all rows."""

    scores: DataFrame
    winner: Candidate


def grid(task_id: str, estimator: Estimator, **values: Sequence) -> dict[str, Estimator]:
    """One estimator per combination of parameter values, named ``task_id.param=value...``."""
    found = ParamGridBuilder()
    for name, some in values.items():
        found = found.addGrid(estimator.getParam(name), list(some))
    return {
        ".".join([task_id, *[f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)]]): estimator.copy(m)
        for m in found.build()
    }


def fold_of(key: str, folds: int, seed: int = 0) -> Column:
    """The fold of a row, by a hash of its key: 0 to ``folds`` - 1."""
    return (F.conv(F.substring(_split_hash(key, seed), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def grid_search(
    rows: DataFrame, features: Sequence[str], key: str, estimators: Mapping[str, Estimator], folds: int = 3, parallelism: int = 4
) -> Search:
    """Scores every estimator on every fold by a model of the other folds; the best mean wins, ties by name.

    The rows are read once and persisted, folds are a column of theirs. All fits run from one bounded pool; a fold's
    models are scored in one pass. At most ``len(estimators) * folds`` models are on the driver.
    """
    spark = rows.sparkSession
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    held = gather(rows.select(*features, "target", fold_of(key, folds).alias("fold"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def fit(task: str, fold: int) -> PipelineModel:
            return Pipeline(stages=[assemble, estimators[task]]).fit(held.filter(F.col("fold") != fold))

        tasks = sorted(estimators)
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            started = {(f, t): pool.submit(inheritable_thread_target(spark)(fit), t, f) for f in range(folds) for t in tasks}
            models = {at: future.result() for at, future in started.items()}
        found = []
        for f in range(folds):
            accuracy = evaluate(held.filter(F.col("fold") == f), {str(i): models[f, t] for i, t in enumerate(tasks)})
            found += [(t, f, accuracy[str(i)]) for i, t in enumerate(tasks)]
    finally:
        held.unpersist()
    scores = local_table(spark, found, "task_id string, fold int, accuracy double")
    mean = {t: [a for name, _, a in found if name == t and a is not None] for t in tasks}
    best = min(tasks, key=lambda t: (-sum(mean[t]) / len(mean[t]) if mean[t] else float("inf"), t))
    return Search(scores, fit_candidates(rows, features, {best: estimators[best]})[0])


def predictions(rows: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Adds ``p_<task>`` for every model in one pass over the rows."""
    out = rows
    for t, model in models.items():
        scored = model.transform(out)
        drop = [c for c in scored.columns if c not in out.columns and c != "prediction"]
        out = scored.drop(*drop).withColumnRenamed("prediction", f"p_{t}")
    return out


def evaluate(rows: DataFrame, models: Mapping[str, PipelineModel]) -> dict[str, float]:
    """Accuracy of each model on the same rows, from one scan."""
    hit = lambda t: F.avg((F.col(f"`p_{t}`") == F.col("target")).cast("double")).alias(t)
    row = predictions(rows, models).agg(*[hit(t) for t in models]).first()
    return {t: row[t] for t in models}


def score_table(spark: SparkSession, run_id: str, found: Sequence[Candidate], accuracy: Mapping[str, float]) -> DataFrame:
    """Candidate scores as a table (one row per candidate)."""
    rows = [(run_id, c.task_id, c.kind, float(c.train_accuracy), float(accuracy[c.task_id])) for c in found]
    schema = "run_id string, task_id string, kind string, train_accuracy double, accuracy double"
    return local_table(spark, rows, schema)


# --- input contract ----------------------------------------------------------
def input_contract(train: DataFrame, features: Sequence[str]) -> dict:
    """Column names and types in order, with the first rows as an example."""
    made = InputContract.of(train, features)
    return {"schema": made.schema().jsonValue(), "example": made.example_rows()}


def meet_contract(rows: DataFrame, contract: dict) -> DataFrame:
    """The contract's columns by name, in its order; anything else is refused."""
    return InputContract()._set(columns=T.StructType.fromJson(contract["schema"]).json()).transform(rows)


# --- score -------------------------------------------------------------------
def split_by_width(rows: DataFrame, values: str, features: list[str], request: str | None = None) -> DataFrame:
    """Adds ``message`` (null when the width fits) and ``accepted``.

    With ``request`` one bad row refuses its whole request.
    """
    out = rows.withColumn("message", S.width_message(F.col(values), features))
    if request is None:
        return out.withColumn("accepted", F.col("message").isNull())
    bad = out.filter(F.col("message").isNotNull()).select(F.col(request), F.lit(True).alias("_bad")).distinct()
    return out.join(bad, request, "left").withColumn("accepted", F.col("_bad").isNull()).drop("_bad")


def spread_values(rows: DataFrame, values: str, features: Sequence[str]) -> DataFrame:
    """Array entries as named feature columns."""
    return rows.select("*", *[F.get(F.col(values), i).cast("double").alias(f) for i, f in enumerate(features)])


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """``prediction`` index, ``label`` and ``confidence`` beside the given columns.

    Confidence is the probability of the predicted class, null for a model without.
    """
    scored = model.transform(rows)
    index = F.col("prediction").cast("int")
    has = "probability" in scored.columns
    confidence = F.get(vector_to_array("probability"), index) if has else F.lit(None).cast("double")
    keep = [c for c in rows.columns if c not in features]
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    return scored.select(
        *keep,
        F.array(*features).alias("row"),
        index.alias("prediction"),
        S.decode_class(names, index).alias("label"),
        confidence.alias("confidence"),
    )
