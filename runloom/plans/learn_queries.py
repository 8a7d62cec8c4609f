"""Split, train, compare, gate, register, score; streams; user functions."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S
from runloom.operators import learn, select, serve, steps
from runloom.operators.contract import contract_of
from runloom.operators.state import target_filter
from runloom.plans.catalog import query
from runloom.session import local_table, new_dir
from runloom.sources import files, registry, traces
from runloom.sources import tables as V
from runloom.streaming import streams

FEATURES = V.FEATURES
_LETTER_COLS = ", ".join(f"f.{c}" for c in FEATURES)
DAG_ID = "languages"
RUN_ID = "languages__run"
MODEL_NAME = "language-classifier"


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    classes: list[str]


def prepare(spark: SparkSession, sf: str, label: str = "lang") -> Prepared:
    """Split written to files by class, then read back split by split."""
    documents = V.table(spark, sf, "documents").select("doc_id", label)
    bounds = learn.split_bounds(documents, "doc_id", label)
    # One row per class is on the driver: the vocabulary the model carries.
    found = sorted(bounds.collect(), key=lambda r: r[label])
    classes = [r[label] for r in found]
    rows = learn.class_index(V.doc_features(spark, sf), label, classes=classes)
    path = new_dir(spark, "split")
    files.write_split(learn.stratified_split(rows, "doc_id", label, bounds=bounds), path, RUN_ID)
    train = files.read_split(spark, path, rows.schema, RUN_ID, "train")
    test = files.read_split(spark, path, rows.schema, RUN_ID, "test")
    n_train = sum(r["quota"] for r in found)
    return Prepared(train, test, n_train, sum(r["size"] for r in found) - n_train, classes)


def estimators(p: Prepared) -> dict:
    return {"train_logreg": learn.logreg(p.n_train), "train_tree": learn.tree()}


def fit_one(spark: SparkSession, sf: str, task: str) -> tuple[Prepared, learn.Candidate]:
    p = prepare(spark, sf)
    return p, learn.fit_candidates(p.train, FEATURES, {task: estimators(p)[task]})[0]


def scored_test(spark: SparkSession, sf: str, task: str) -> DataFrame:
    p, c = fit_one(spark, sf, task)
    return judged(learn.predict(c.model, p.test, FEATURES, p.classes), p.classes)


LEAST_ACCURACY = 0.85  # a fitted model below this is broken; the gate asks for more
_TEST_ROWS = "SELECT doc_id, lang, true AS known_label, true AS sure, true AS accurate FROM doc_split WHERE split = 'test'"


def judged(scored: DataFrame, classes: list[str], at_least: float = LEAST_ACCURACY) -> DataFrame:
    """What SQL can know of scored rows, where learned numbers only pass or fail.

    Which rows they are, that each label is a class and each confidence is possible for the
    best of k classes, and that the model as a whole is right often enough.
    """
    hits = scored.agg(F.avg((F.col("label") == F.col("lang")).cast("double"))).first()[0]
    return scored.select(
        "doc_id",
        "lang",
        F.col("label").isin(classes).alias("known_label"),
        F.col("confidence").between(1 / len(classes) - 1e-9, 1 + 1e-9).alias("sure"),
        F.lit(hits is not None and hits >= at_least).alias("accurate"),
    )


# --- sources and splits ------------------------------------------------------
@query(
    "scan_features",
    "S1",
    f"SELECT f.doc_id, {_LETTER_COLS}, CAST(dense_rank() OVER (ORDER BY f.lang) - 1 AS INT) AS target FROM doc_features f",
    "doc_features",
)
def scan_features(spark: SparkSession, sf: str) -> DataFrame:
    return learn.class_index(V.doc_features(spark, sf), "lang").drop("lang")


@query(
    "split_io",
    "S2",
    f"""
SELECT f.doc_id, f.lang, {_LETTER_COLS}, s.split FROM doc_features f JOIN doc_split s ON s.doc_id = f.doc_id WHERE s.split = 'test'""",
    "doc_features doc_split",
)
def split_io(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "split")
    rows = V.doc_features(spark, sf)
    files.write_split(learn.stratified_split(rows, "doc_id", "lang"), path, RUN_ID)
    return files.read_split(spark, path, rows.schema, RUN_ID, "test").withColumn("split", F.lit("test"))


@query("split_counts", "A2", "SELECT split, count(*) AS n FROM doc_split GROUP BY split", "doc_split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select("doc_id", "lang")
    return select.split_counts(learn.stratified_split(rows, "doc_id", "lang"))


@query("stratified_split", "W5", "SELECT doc_id, lang, split FROM doc_split", "doc_split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select("doc_id", "lang")
    return learn.stratified_split(rows, "doc_id", "lang")


# --- training ----------------------------------------------------------------
@query("train_logreg", "M1", _TEST_ROWS, "doc_split")
def train_logreg(spark: SparkSession, sf: str) -> DataFrame:
    return scored_test(spark, sf, "train_logreg")


@query("train_tree", "M2", _TEST_ROWS, "doc_split")
def train_tree(spark: SparkSession, sf: str) -> DataFrame:
    return scored_test(spark, sf, "train_tree")


_PARAMS = {
    "train_logreg": {"standardization": "True", "featuresCol": "features", "labelCol": "target", "maxIter": "500", "tol": "0.0001", "family": "multinomial"},
    "train_tree": {"featuresCol": "features", "labelCol": "target", "seed": "0", "maxDepth": "3", "impurity": "gini"},
}
_KINDS = {"train_logreg": "LogisticRegression", "train_tree": "DecisionTreeClassifier"}
_LOGGED = ", ".join(
    f"('{t}', '{k}', '{v}', '{kind}')"
    for t, params in _PARAMS.items()
    for k, v, kind in [*[(k, v, "param") for k, v in params.items()], ("train_accuracy", "passed", "metric"), ("kind", _KINDS[t], "tag")]
)


@query(
    "fit_candidates",
    "M3",
    f"""
SELECT '{RUN_ID}.' || task_id AS tracking_run, '{DAG_ID}' AS dag_id, '{RUN_ID}' AS run_id, task_id, "key", "value", 0 AS step, kind FROM (
  SELECT * FROM (VALUES {_LOGGED}) AS v(task_id, "key", "value", kind)
  UNION ALL SELECT 'train_logreg', 'regParam', CAST(CAST(1 AS DOUBLE) / count(*) AS VARCHAR), 'param' FROM doc_split WHERE split = 'train') l""",
    "doc_split",
)
def fit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf)
    found = learn.fit_candidates(p.train, FEATURES, estimators(p))
    entries = [
        registry.log_rows(
            spark,
            f"{RUN_ID}.{c.task_id}",
            {"dag_id": DAG_ID, "run_id": RUN_ID, "task_id": c.task_id},
            params=c.params,
            metrics={"train_accuracy": c.train_accuracy},
            tags={"kind": c.kind},
        )
        for c in found
    ]
    path = new_dir(spark, "tracking")
    registry.append_log(select.union_scores(entries), path)
    logged = registry.read_log(spark, path).drop("logged_at")
    passed = (F.col("kind") == "metric") & (F.col("value").try_cast("double") >= LEAST_ACCURACY)
    return logged.withColumn("value", F.when(passed, "passed").otherwise(F.col("value")))


_GRID = {"tree.maxDepth=2": "2", "tree.maxDepth=5": "5", "flat.regParam=0.001": "-", "flat.regParam=1.0": "-"}


@query(
    "grid_search",
    "M3",
    f"""
WITH folds AS (SELECT doc_id, CAST('0x' || substr(md5('0:' || doc_id), 1, 8) AS BIGINT) % 3 AS fold FROM documents)
SELECT t.task_id, CAST(f.fold AS INT) AS fold, f.n, true AS trusted, true AS won
FROM (SELECT fold, count(*) AS n FROM folds GROUP BY fold) f, (VALUES {", ".join(f"('{t}')" for t in _GRID)}) AS t(task_id)""",
)
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two depths of a tree and two penalties of a regression over three folds: each score, and how many rows it is of.

    ``trusted``: a candidate is right more often than the largest language alone would be, but for the over-penalised one;
    ``won``: the winner has the best mean of all.
    """
    p = prepare(spark, sf)
    rows = p.train.unionByName(p.test)
    flat = learn.logreg(p.n_train, max_iter=30)
    found = learn.grid_search(rows, FEATURES, "doc_id", learn.grid("tree", learn.tree(), maxDepth=[2, 5]) | learn.grid("flat", flat, regParam=[1e-3, 1.0]))
    # Guessing the largest language of a fold is right for that language's share of it.
    by_class = rows.groupBy(learn.fold_of("doc_id", 3).alias("fold"), "target").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_class.groupBy("fold").agg(F.sum("k").alias("n"), F.max("k").alias("_most"))
    means = found.scores.groupBy("task_id").agg(F.avg("accuracy").alias("mean"))
    best = means.agg(F.max("mean").alias("best"))
    top = means.filter(F.col("task_id") == found.winner.task_id).first()["mean"]
    beats = F.col("accuracy") > F.col("_most") / F.col("n")
    return found.scores.join(sizes, "fold").select(
        "task_id", "fold", "n", (beats | F.col("task_id").endswith("=1.0")).alias("trusted"), F.lit(top == best.first()["best"]).alias("won")
    )


@query(
    "evaluate",
    "M4",
    f"""
SELECT '{RUN_ID}' AS run_id, task_id, kind, true AS fitted, true AS passed
FROM (VALUES {", ".join(f"('{t}', '{k}')" for t, k in _KINDS.items())}) AS v(task_id, kind)""",
)
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf)
    found = learn.fit_candidates(p.train, FEATURES, estimators(p))
    scores = learn.score_table(spark, RUN_ID, found, learn.evaluate(p.test, {c.task_id: c.model for c in found}))
    good = lambda c: F.coalesce(F.col(c).between(LEAST_ACCURACY, 1), F.lit(False))
    return scores.select("run_id", "task_id", "kind", good("train_accuracy").alias("fitted"), good("accuracy").alias("passed"))


def train_and_register(spark: SparkSession, sf: str, base: str) -> tuple[Prepared, learn.Candidate, DataFrame]:
    """Split, fit two, compare on the held-out rows, gate, register the better one.

    Every step logs its parameters, metrics and tags below ``base/tracking``, the comparison its ranked list
    below ``base/bakeoff``; a model that the gate refuses has left these, but no version.
    """
    p = prepare(spark, sf)
    found = learn.fit_candidates(p.train, FEATURES, estimators(p))
    accuracy = learn.evaluate(p.test, {c.task_id: c.model for c in found})
    scores = learn.score_table(spark, RUN_ID, found, accuracy)
    best = select.best_candidate(scores).first()
    winner = next(c for c in found if c.task_id == best["task_id"])

    def logged(task: str, params: dict = {}, metrics: dict = {}, tags: dict = {}) -> DataFrame:
        ids = {"dag_id": DAG_ID, "run_id": RUN_ID, "task_id": task}
        return registry.log_rows(spark, f"{RUN_ID}.{task}", ids, params, metrics, tags)

    held_out = {f"test_accuracy.{t}": a for t, a in accuracy.items()}
    entries = [
        logged("prep", {"test_size": fixed.TEST_SHARE, "stratified": True, "random_state": 0}, {"train_rows": p.n_train, "test_rows": p.n_test}),
        *[logged(c.task_id, c.params, {"train_accuracy": c.train_accuracy}, {"kind": c.kind}) for c in found],
        logged("select_best", metrics={**held_out, "best_accuracy": best["accuracy"]}, tags={"winner": best["task_id"]}),
    ]
    registry.append_log(select.union_scores(entries), f"{base}/tracking")
    files.write_json(select.bake_off(scores), f"{base}/bakeoff")
    tags = spark.range(1).select(
        registry.version_tags(
            F.lit(RUN_ID),
            F.lit(DAG_ID),
            F.lit(best["accuracy"]),
            F.lit(best["kind"]),
            S.list_tag(FEATURES),
            S.list_tag(p.classes),
        ).alias("tags")
    )
    version = registry.register(winner.model, base, MODEL_NAME, best["accuracy"], tags)
    number = version.first()["version"]
    registry.append_log(
        logged("register", metrics={"registered_accuracy": best["accuracy"]}, tags={"registered_model": MODEL_NAME, "registered_version": number}),
        f"{base}/tracking",
    )
    return p, winner, version


_STEPS = ", ".join(
    f"('{task}', '{kind}', '{key}', '{value}')"
    for task, kind, key, value in [
        ("prep", "param", "test_size", "0.25"), ("prep", "param", "stratified", "True"), ("prep", "param", "random_state", "0"),
        *[(t, "param", k, v) for t, params in _PARAMS.items() for k, v in params.items()],
        *[(t, "metric", "train_accuracy", "passed") for t in _KINDS], *[(t, "tag", "kind", v) for t, v in _KINDS.items()],
        *[("select_best", "metric", f"test_accuracy.{t}", "passed") for t in _KINDS], ("select_best", "metric", "best_accuracy", "passed"),
        ("select_best", "tag", "winner", "known"), *[("select_best", "bakeoff", t, v) for t, v in _KINDS.items()],
        ("register", "metric", "registered_accuracy", "passed"), ("register", "tag", "registered_model", MODEL_NAME), ("register", "tag", "registered_version", "1"),
    ]
)


@query(
    "training_log",
    "M10",
    f"""
SELECT '{RUN_ID}.' || task_id AS tracking_run, '{RUN_ID}' AS run_id, task_id, kind, "key", "value" FROM (
  SELECT * FROM (VALUES {_STEPS}) AS v(task_id, kind, "key", "value")
  UNION ALL SELECT 'train_logreg', 'param', 'regParam', CAST(CAST(1 AS DOUBLE) / count(*) AS VARCHAR) FROM doc_split WHERE split = 'train'
  UNION ALL SELECT 'prep', 'metric', split || '_rows', CAST(count(*) AS VARCHAR) FROM doc_split GROUP BY split) l""",
    "doc_split",
)
def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """What the training job has written about itself: every step's entries and the ranked list of candidates."""
    base = new_dir(spark, "registry")
    train_and_register(spark, sf, base)
    entries = registry.read_log(spark, f"{base}/tracking").select("tracking_run", "run_id", "task_id", "kind", "key", "value")
    learned = (F.col("kind") == "metric") & F.col("key").contains("accuracy")
    passed = learned & F.col("value").try_cast("double").between(LEAST_ACCURACY, 1)
    won = (F.col("key") == "winner") & F.col("value").isin(list(_KINDS))
    listed = spark.read.json(f"{base}/bakeoff").select("run_id", F.explode("candidates").alias("c")).select(
        F.concat_ws(".", "run_id", F.lit("select_best")).alias("tracking_run"), "run_id", F.lit("select_best").alias("task_id"),
        F.lit("bakeoff").alias("kind"), F.col("c.task_id").alias("key"), F.col("c.kind").alias("value"),
    )
    return entries.withColumn("value", F.when(passed, "passed").when(won, "known").otherwise(F.col("value"))).unionByName(listed)


@query(
    "register",
    "M6",
    f"""
SELECT '{MODEL_NAME}' AS name, 1 AS version, 'models:/{MODEL_NAME}/1' AS uri, tag_key, tag_value FROM (
  SELECT * FROM (VALUES ('run_id', '{RUN_ID}'), ('dag_id', '{DAG_ID}'), ('accuracy', 'passed'), ('kind', 'known'),
    ('features', '{json.dumps(FEATURES, separators=(",", ":"))}')) AS v(tag_key, tag_value)
  UNION ALL SELECT 'classes', '[' || string_agg('"' || lang || '"', ',' ORDER BY lang) || ']' FROM (SELECT DISTINCT lang FROM documents) d) t""",
)
def register(spark: SparkSession, sf: str) -> DataFrame:
    _, _, version = train_and_register(spark, sf, new_dir(spark, "registry"))
    tags = version.select("name", "version", "uri", F.explode("tags").alias("tag_key", "tag_value"))
    passed = (F.col("tag_key") == "accuracy") & (F.col("tag_value").try_cast("double") >= fixed.MIN_ACCURACY)
    known = (F.col("tag_key") == "kind") & F.col("tag_value").isin(list(_KINDS.values()))
    return tags.withColumn("tag_value", F.when(passed, "passed").when(known, "known").otherwise(F.col("tag_value")))


@query("input_contract", "M7", f"SELECT {_LETTER_COLS}, f.doc_id FROM doc_features f", "doc_features")
def input_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Columns arrive in another order and leave in the contract's."""
    rows = V.doc_features(spark, sf).drop("lang")
    contract = learn.input_contract(rows, FEATURES)
    return learn.meet_contract(rows.select(*reversed(rows.columns)), contract)


_REFUSED = ", ".join(
    f"('without {f}', 'missing columns: {f}', CAST(NULL AS BIGINT)), ('{f} as text', '{f} is string, not double', NULL)" for f in FEATURES
)
_PLACES = ", ".join(f"('column', '{f}', {i})" for i, f in enumerate([*FEATURES, "lang", "doc_id"]))


@query(
    "model_contract",
    "M7",
    f"""
SELECT variant, found, CAST(number AS BIGINT) AS number FROM (VALUES {_REFUSED}, {_PLACES}) AS v(variant, found, number)
UNION ALL SELECT 'reversed', lang, count(*) FROM documents GROUP BY lang""",
)
def model_contract(spark: SparkSession, sf: str) -> DataFrame:
    """A stored model, loaded again: what it refuses, the order its columns leave in, and rows given in reverse order.

    A row per refused shape of the input, a row per column with its position after the contract, and per language
    the rows whose prediction is the same whichever order the columns come in (all of them).
    """
    p, c = fit_one(spark, sf, "train_tree")
    base = new_dir(spark, "registry")
    tags = spark.range(1).select(F.create_map(F.lit("kind"), F.lit(c.kind)).alias("tags"))
    registry.register(c.model, base, MODEL_NAME, 1.0, tags)
    _, model = registry.load_model(spark, base, MODEL_NAME)
    rows = p.train.unionByName(p.test).select("doc_id", "lang", *FEATURES)
    turned = rows.select(*reversed(rows.columns))
    contract = contract_of(model)
    wrong = {f"without {f}": rows.drop(f) for f in FEATURES} | {f"{f} as text": rows.withColumn(f, F.col(f).cast("string")) for f in FEATURES}
    told = [(name, contract.refusal(variant.schema), None) for name, variant in wrong.items()]
    told += [("column", name, i) for i, name in enumerate(contract.transform(turned).columns)]
    straight = model.transform(rows).select("doc_id", "lang", F.col("prediction").alias("p"))
    reverse = model.transform(turned).select("doc_id", F.col("prediction").alias("q"))
    same = straight.join(reverse, "doc_id").filter("p = q").groupBy("lang").agg(F.count(F.lit(1)).alias("number"))
    return local_table(spark, told, "variant string, found string, number bigint").unionByName(
        same.select(F.lit("reversed").alias("variant"), F.col("lang").alias("found"), "number")
    )


_WIDE = f"expected {len(FEATURES)} values ({', '.join(FEATURES)}), got 3"


@query(
    "predict_requests",
    "M9",
    f"""
WITH asked AS (SELECT DISTINCT doc_id // 4 AS request_id FROM documents), named AS (
  SELECT request_id, CASE request_id % 6 WHEN 3 THEN 'no such model' ELSE '{MODEL_NAME}' END AS name,
    CASE request_id % 5 WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '9' END AS version FROM asked
), checked AS (
  SELECT n.request_id, d.doc_id, n.name, coalesce(n.version, CASE WHEN n.name = '{MODEL_NAME}' THEN '2' END) AS version,
    CASE WHEN n.name = 'no such model' AND n.version IS NULL THEN 'no registered model ''no such model'''
      WHEN n.name = 'no such model' OR n.version = '9' THEN 'no version ''' || n.version || ''' of model ''' || n.name || ''''
      WHEN d.doc_id IS NULL THEN 'nothing to predict' WHEN d.doc_id % 10 = 0 THEN '{_WIDE}' END AS message
  FROM named n LEFT JOIN documents d ON d.doc_id // 4 = n.request_id AND n.request_id % 17 <> 0
), refused AS (SELECT request_id, min(message) AS refusal FROM checked WHERE message IS NOT NULL GROUP BY request_id)
SELECT c.request_id, c.doc_id, c.name, c.version, r.refusal, r.refusal IS NULL AS answered, r.refusal IS NULL AS known_label, r.refusal IS NULL AS sure
FROM checked c LEFT JOIN refused r ON r.request_id = c.request_id""",
)
def predict_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of up to four rows over two registered versions: answers, and refusals with their reasons."""
    p = prepare(spark, sf)
    base = new_dir(spark, "registry")
    for c in sorted(learn.fit_candidates(p.train, FEATURES, estimators(p)), key=lambda c: c.kind):
        tags = registry.version_tags(F.lit(RUN_ID), F.lit(DAG_ID), F.lit(c.train_accuracy), F.lit(c.kind), S.list_tag(FEATURES), S.list_tag(p.classes))
        registry.register(c.model, base, MODEL_NAME, c.train_accuracy, spark.range(1).select(tags.alias("tags")), LEAST_ACCURACY)
    texts = p.train.unionByName(p.test)
    k, r = F.expr("doc_id div 4"), F.col("request_id")
    name = F.when(r % 6 == 1, " String ").when(r % 6 == 2, "NONE").when(r % 6 == 3, "no such model").when(r % 6 > 3, f"  {MODEL_NAME} ")
    version = F.when(r % 5 == 0, "").when(r % 5 == 1, " null").when(r % 5 == 4, "9").otherwise((r % 5 - 1).cast("string"))
    requests = texts.select(k.alias("request_id")).distinct().select("request_id", name.alias("name"), version.alias("version"))
    values = F.when(F.col("doc_id") % 10 == 0, F.array(*FEATURES[:3])).otherwise(F.array(*FEATURES))
    rows = texts.filter(k % 17 != 0).select(k.alias("request_id"), F.col("doc_id").alias("row_id"), values.alias("row_values"))
    answers = serve.answer(spark, base, requests, rows, MODEL_NAME)
    there = lambda c: F.coalesce(c, F.lit(False))
    return answers.select(
        "request_id", F.col("row_id").alias("doc_id"), "name", "version", "refusal",
        there(F.col("prediction").between(0, len(p.classes) - 1)).alias("answered"), there(F.col("label").isin(p.classes)).alias("known_label"),
        there(F.col("confidence").between(1 / len(p.classes) - 1e-9, 1 + 1e-9)).alias("sure"),
    )


@query("predict", "M9", "SELECT doc_id, lang, true AS known_label, true AS sure, true AS accurate FROM documents")
def predict(spark: SparkSession, sf: str) -> DataFrame:
    base = new_dir(spark, "registry")
    p, _, _ = train_and_register(spark, sf, base)
    info, model = registry.load_model(spark, base, MODEL_NAME)
    rows = p.train.unionByName(p.test)  # the features of every document, as the split has stored them
    return judged(learn.predict(model, rows.drop("target"), info["features"], info["classes"]), info["classes"])


@query(
    "train_gate_register",
    "M10",
    f"SELECT t.*, 'models:/{MODEL_NAME}/1' AS uri, true AS known_kind, true AS gated FROM ({_TEST_ROWS}) t",
    "doc_split",
)
def train_gate_register(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: split, train two, select, gate, register, score with the winner."""
    p, winner, version = train_and_register(spark, sf, new_dir(spark, "registry"))
    scored = learn.predict(winner.model, p.test, FEATURES, p.classes)
    kept = version.select("uri", F.col("tags.kind").alias("kind"), F.col("tags.accuracy").alias("accuracy")).first()
    stored = float(kept["accuracy"])
    rows = judged(scored, p.classes, at_least=stored - 1e-4)  # the version's own accuracy, four digits of it
    gated, known = stored >= fixed.MIN_ACCURACY, kept["kind"] in _KINDS.values()
    return rows.select("*", F.lit(kept["uri"]).alias("uri"), F.lit(known).alias("known_kind"), F.lit(gated).alias("gated"))


@query("trace_sink", "S10", "SELECT 'models:/candidate' AS model_uri, count(*) AS n, true AS agree FROM documents")
def trace_sink(spark: SparkSession, sf: str) -> DataFrame:
    p, c = fit_one(spark, sf, "train_tree")
    out = new_dir(spark, "scored")
    scored = learn.predict(c.model, V.doc_features(spark, sf).drop("lang"), FEATURES, p.classes)
    traces.write_scored(scored, f"{out}/predictions", "models:/candidate", FEATURES, f"{out}/traces")
    traced = spark.read.parquet(f"{out}/traces").select("model_uri", "outputs.prediction", "outputs.label")
    made = spark.read.parquet(f"{out}/predictions").groupBy("prediction", "label").agg(F.count(F.lit(1)).alias("_made"))
    counted = traced.groupBy("model_uri", "prediction", "label").agg(F.count(F.lit(1)).alias("_n"))
    both = counted.join(made, ["prediction", "label"], "full")
    return both.groupBy("model_uri").agg(F.sum("_n").alias("n"), F.bool_and(F.col("_n").eqNullSafe(F.col("_made"))).alias("agree"))


# --- streams -----------------------------------------------------------------
def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table's own path as a stream: a single file or a folder of part files."""
    schema = V.table(spark, sf, table).schema
    if files.is_folder(spark, f"{sf}/{table}.parquet"):
        return streams.file_stream(spark, f"{sf}/{table}.parquet", "*", schema)
    return streams.file_stream(spark, sf, f"{table}.parquet", schema)


def _changes(events: DataFrame) -> DataFrame:
    """Events as a change feed: the user is the run, the event type its state."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.when(kind == "signup", fixed.PENDING)
        .when(kind == "view", fixed.RUNNING)
        .when(kind == "error", fixed.FAILED)
        .otherwise(fixed.SUCCESS)
        .alias("state"),
        F.col("event_id").alias("seq"),
        V.epoch("ts").cast("bigint").alias("changed_at"),
    )


_STATE_SQL = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'success' END"""
_LAST_EVENT = f"""(SELECT user_id AS run_id, {_STATE_SQL} AS state, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS changed_at FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"""


@query("stream_score", "R1", "SELECT doc_id, true AS same FROM documents")
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    p, c = fit_one(spark, sf, "train_logreg")
    out = new_dir(spark, "stream")
    feed = V.letter_shares(_stream(spark, sf, "documents")).drop("lang")
    q = streams.score(feed, c.model, FEATURES, p.classes, out, new_dir(spark, "cp"), "models:/candidate")
    q.awaitTermination()
    batch = learn.predict(c.model, V.doc_features(spark, sf).drop("lang"), FEATURES, p.classes)
    streamed = spark.read.parquet(f"{out}/predictions").select("doc_id", F.col("label").alias("_label"), F.col("confidence").alias("_sure"))
    same = (F.col("label") == F.col("_label")) & (F.abs(F.col("confidence") - F.col("_sure")) < 1e-9)
    return batch.join(streamed, "doc_id", "full").select("doc_id", F.coalesce(same, F.lit(False)).alias("same"))


@query("stream_state", "R2", f"SELECT run_id, state, seq, changed_at FROM {_LAST_EVENT} e")
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    feed = _changes(_stream(spark, sf, "events"))
    out = new_dir(spark, "stream")
    streams.track_state(feed, ["run_id"], "seq", out, new_dir(spark, "cp")).awaitTermination()
    return streams.read_state(spark, out, feed.schema, ["run_id"])


@query(
    "stream_stuck",
    "R3",
    f"""
SELECT * FROM (SELECT *, max(changed_at) OVER () - changed_at AS stuck_for FROM {_LAST_EVENT} e) s WHERE state = 'running' AND stuck_for > 900""",
)
def stream_stuck(spark: SparkSession, sf: str) -> DataFrame:
    feed = _changes(_stream(spark, sf, "events"))
    out = new_dir(spark, "stream")
    streams.flag_stuck(feed, fixed.REAP_AFTER_SECONDS, out, new_dir(spark, "cp")).awaitTermination()
    return streams.read_stuck(spark, out, feed.schema)


RECONCILED = """
SELECT r.app_name, r.desired, CASE WHEN coalesce(bool_and(a.state = 'success'), true) THEN r.desired ELSE r.applied END AS applied,
  coalesce(bool_and(a.state = 'success'), true) AS in_sync,
  CASE WHEN coalesce(bool_and(a.state = 'success'), true) THEN 'synced' ELSE 'failed' END AS action, count(a.run_id) AS n_runs
FROM revisions r LEFT JOIN (SELECT * FROM app_runs WHERE dag_id = '1-URGENT') a ON a.app_name = r.app_name
WHERE r.desired IS DISTINCT FROM r.applied GROUP BY r.app_name, r.desired, r.applied"""


@query("stream_reconcile", "R4", RECONCILED, "revisions app_runs")
def stream_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    feed = V.revision_rows(_stream(spark, sf, "customer")).select("app_name", "dag_id", "desired")
    applied = V.revisions(spark, sf).filter("applied IS NOT NULL").select("app_name", F.col("applied").alias("revision"))
    only = local_table(spark, [("1-URGENT",)], "dag_id string")
    out = new_dir(spark, "stream")
    q = streams.reconcile(feed, applied, V.app_runs(spark, sf), out, new_dir(spark, "cp"), only)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/actions").drop("batch_id")


@query("stream_outcomes", "R4", RECONCILED, "revisions app_runs")
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The same reconciling beside outcomes that are kept up to date over several micro-batches of run changes."""
    only = local_table(spark, [("1-URGENT",)], "dag_id string")
    runs = target_filter(V.app_runs(spark, sf), only).select("app_name", "run_id", "state")
    places = [new_dir(spark, name) for name in ("feed", "outcomes", "cp", "stream", "cp")]
    # every run starts, ends, and is then reported late as waiting
    for state, seq in ((F.lit(fixed.RUNNING), 1), (F.col("state"), 3), (F.lit(fixed.PENDING), 2)):
        told = runs.select("app_name", "run_id", state.alias("state"), F.lit(seq).cast("long").alias("seq"))
        told.write.mode("append").parquet(places[0])
        changes = streams.file_stream(spark, places[0], "*.parquet", told.schema)
        streams.track_outcomes(changes, places[1], places[2]).awaitTermination()
    feed = V.revision_rows(_stream(spark, sf, "customer")).select("app_name", "dag_id", "desired")
    applied = V.revisions(spark, sf).filter("applied IS NOT NULL").select("app_name", F.col("applied").alias("revision"))
    streams.reconcile(feed, applied, None, places[3], places[4], outcomes=places[1]).awaitTermination()
    return spark.read.parquet(f"{places[3]}/actions").drop("batch_id")


# --- user functions ----------------------------------------------------------
@query(
    "step_function",
    "U1",
    """
SELECT req_id, l_linenumber, CAST(split_part(raw, ',', 1) AS DOUBLE) * 2.5 AS value FROM raw_rows""",
    "raw_rows",
)
def step_function(spark: SparkSession, sf: str) -> DataFrame:
    def ingest(upstream: dict[str, DataFrame]) -> DataFrame:
        return V.raw_rows(spark, sf)

    def scale(upstream: dict[str, DataFrame], factor: float) -> DataFrame:
        first = F.get(S.parse_row(F.col("raw")), F.lit(0))
        return upstream["ingest"].select("req_id", "l_linenumber", (first * factor).alias("value"))

    rows = steps.run_step(ingest, {})
    return steps.run_step(scale, {"ingest": rows}, factor=2.5)


@query(
    "row_function",
    "U2",
    """
SELECT req_id, l_linenumber, strpos(raw, 'abc') = 0 AS ok,
  CASE WHEN strpos(raw, 'abc') = 0 THEN CAST(split_part(raw, ',', 1) AS DOUBLE)
    + CAST(split_part(split_part(raw, ', ', 2), ' ', 1) AS DOUBLE) + l_linenumber END AS result,
  CASE WHEN strpos(raw, 'abc') > 0 THEN 'ValueError: could not convert string to float: ''abc''' END AS error
FROM raw_rows""",
    "raw_rows",
)
def row_function(spark: SparkSession, sf: str) -> DataFrame:
    def add_up(raw: str) -> float:
        return sum(float(t) for t in raw.replace(",", " ").split())

    return steps.row_function(V.raw_rows(spark, sf), add_up, ["req_id", "l_linenumber"], ["raw"], "double")


@query(
    "group_function",
    "U3",
    """
SELECT g.*, (sy - slope * sx) / n AS intercept FROM (
  SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM (
    SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS sx, sum(l_quantity) AS sy,
      CAST(sum(l_linenumber * l_linenumber) AS DOUBLE) AS sxx, sum(l_linenumber * l_quantity) AS sxy
    FROM lineitem GROUP BY l_returnflag) s) g""".replace("g.*", "l_returnflag, n, slope"),
)
def group_function(spark: SparkSession, sf: str) -> DataFrame:
    """A straight line fitted per return flag; sums travel, rows do not."""

    def sums(g: pd.DataFrame) -> list[float]:
        x, y = g["l_linenumber"].astype("float64"), g["l_quantity"]
        return [len(g), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()]

    def line(s: list[float]) -> list[float]:
        n, sx, sy, sxx, sxy = s
        slope = (n * sxy - sx * sy) / (n * sxx - sx * sx) if n * sxx != sx * sx else float("nan")
        return [n, slope, (sy - slope * sx) / n]

    rows = V.table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    return steps.group_function(rows, ["l_returnflag"], sums, line, 5, ["n", "slope", "intercept"])


@query(
    "group_logistic",
    "U3",
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, true AS converged, true AS better FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Which lines hold more than 25 pieces, by a logistic regression per return flag and line status, all fitted in the same rounds.

    ``better``: the group's log loss is below that of its base rate.
    """
    keys, inputs = ["l_returnflag", "l_linestatus"], ["price", "discount", "tax"]
    rows = V.table(spark, sf, "lineitem").select(
        *keys, (F.col("l_extendedprice") / 50_000).cast("double").alias("price"), (10 * F.col("l_discount")).cast("double").alias("discount"),
        (10 * F.col("l_tax")).cast("double").alias("tax"), (F.col("l_quantity") > 25).cast("double").alias("large"),
    )
    fitted = steps.group_rounds(rows, keys, steps.logistic(inputs, "large", penalty=1e-3))
    margin = F.get("weights", F.lit(0))
    for i, c in enumerate(inputs):
        margin = margin + F.get("weights", F.lit(i + 1)) * F.col(c)
    loss = F.avg(F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - F.col("large") * margin)
    rate = F.avg("large")
    base = -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))
    scored = rows.join(fitted, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and("converged").alias("converged"), loss.alias("l"), base.alias("b"))
    return scored.select(*keys, "n", "converged", F.coalesce(F.col("l") <= F.col("b"), F.col("b").isNull()).alias("better"))
