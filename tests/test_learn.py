from __future__ import annotations

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from runloom.functions import scalars as S
from runloom.operators import learn, select, serve
from runloom.operators.contract import contract_of
from runloom.plans import learn_queries as Q
from runloom.sources import registry, traces
from runloom.sources import tables as V

SF = "/root/testdata/sf0.001"


def quotas_of(spark, sizes, share):
    table = spark.createDataFrame(list(sizes.items()), "kind string, size long")
    return {r["kind"]: r["quota"] for r in learn.train_quotas(table, "kind", share).collect()}


@pytest.mark.parametrize("share", ["0.25", "0.1", "0.5", "1", "0"])
@pytest.mark.parametrize("seed", range(3))
def test_quotas_add_up(spark, share, seed):
    rng = random.Random(seed)
    sizes = {f"c{i}": rng.randint(1, 50) for i in range(rng.randint(1, 6))}
    quotas = quotas_of(spark, sizes, share)
    n = sum(sizes.values())
    n_test = {"0.25": -(-n // 4), "0.1": -(-n // 10), "0.5": -(-n // 2), "1": n, "0": 0}[share]
    assert sum(quotas.values()) == n - n_test
    for c, q in quotas.items():
        exact = sizes[c] * (n - n_test) / n
        assert int(exact) <= q <= ceil(exact) and q <= sizes[c]


def test_ties_go_to_the_first_class(spark):
    assert quotas_of(spark, {"a": 1, "b": 1}, "0.5") == {"a": 1, "b": 0}
    assert quotas_of(spark, {"b": 1, "a": 1, None: 1}, "0.5") == {None: 1, "a": 0, "b": 0}
    assert quotas_of(spark, {"a": 3_000_000_000_000, "b": 5_000_000_000_001}, "0.25") == {"a": 2_250_000_000_000, "b": 3_750_000_000_000}


@pytest.mark.parametrize("small", [None, 0])
def test_a_label_of_many_values(spark, small):
    """100,000 classes of one to three rows: quotas, bounds and numbers stay tables."""
    rows = spark.range(200_000).select("id", (F.col("id") % 100_000 + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).cast("string").alias("kind"))
    bounds = learn.split_bounds(rows, "id", "kind", small=small)
    split = learn.stratified_split(rows, "id", "kind", bounds=bounds)
    assert split.filter("split = 'test'").count() == 50_000
    per = split.groupBy("kind").agg(F.count_if(F.col("split") == "train").alias("trains")).join(bounds, "kind")
    assert per.filter("trains <> quota").isEmpty() and per.count() == bounds.count()
    places = learn.class_index(rows, "kind").groupBy("kind").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    want = sorted(r["kind"] for r in bounds.select("kind").collect())
    assert {r["kind"]: (r["low"], r["high"]) for r in places.collect()} == {k: (i, i) for i, k in enumerate(want)}


def skewed_rows(spark, n=900):
    kind = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 4))
    return spark.range(n).select("id", kind.alias("kind"))


def test_bucket_path_equals_small_path(spark):
    rows = skewed_rows(spark)
    small = {r["kind"]: tuple(r) for r in learn.split_bounds(rows, "id", "kind").collect()}
    large = {r["kind"]: tuple(r) for r in learn.split_bounds(rows, "id", "kind", small=0).collect()}
    assert small == large and None in small


def test_split_is_balanced_whole_and_repeatable(spark):
    rows = skewed_rows(spark)
    once = learn.stratified_split(rows, "id", "kind")
    again = learn.stratified_split(rows.repartition(7), "id", "kind")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert once.count() == 900 and once.filter("split = 'test'").count() == 225
    per = once.groupBy("kind").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect()
    assert all(abs(r["share"] - 0.25) < 0.02 for r in per)


def test_another_seed_is_another_split(spark):
    rows = skewed_rows(spark)
    a, b = (learn.stratified_split(rows, "id", "kind", seed=s) for s in (0, 1))
    assert a.filter("split = 'test'").join(b.filter("split = 'test'"), "id").count() < 225


@pytest.mark.parametrize("share,split", [("1", "test"), ("0", "train")])
def test_all_or_nothing_splits(spark, share, split):
    out = learn.stratified_split(skewed_rows(spark, 60), "id", "kind", share)
    assert [r["split"] for r in out.select("split").distinct().collect()] == [split]


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("registry"))
    p, winner, version = Q.train_and_register(spark, SF, base)
    return base, p, winner, version.first()


def test_the_winner_passes_the_gate_and_is_registered(spark, trained):
    base, p, winner, row = trained
    assert row["version"] == 1 and float(row["tags"]["accuracy"]) >= 0.9
    info, model = registry.load_model(spark, base, Q.MODEL_NAME, " String ")
    assert info["features"] == V.FEATURES and info["classes"] == p.classes and info["experiment"] == Q.DAG_ID
    a, b = (learn.predict(m, p.test, V.FEATURES, p.classes).select("doc_id", "prediction") for m in (model, winner.model))
    assert sorted(a.collect()) == sorted(b.collect())


def test_a_second_promotion_is_version_two(spark, trained):
    base, _, winner, row = trained
    tags = spark.createDataFrame([({"kind": "x"},)], "tags map<string,string>")
    new = registry.register(winner.model, base, Q.MODEL_NAME, 0.95, tags).first()
    assert new["version"] == row["version"] + 1
    info, _ = registry.load_model(spark, base, Q.MODEL_NAME)
    assert info["version"] == str(new["version"]) and info["classes"] == []
    info, _ = registry.load_model(spark, base, Q.MODEL_NAME, "1")
    assert info["version"] == "1"


def test_a_refused_model_leaves_nothing(spark, trained, folder):
    _, _, winner, _ = trained
    tags = spark.createDataFrame([({},)], "tags map<string,string>")
    with pytest.raises(ValueError, match="accuracy 0.8999 below threshold 0.9 "):
        registry.register(winner.model, folder, "m", 0.8999, tags)
    assert registry.read_versions(spark, f"{folder}/versions").isEmpty()
    registry.register(winner.model, folder, "m", 0.9, tags)
    assert registry.read_versions(spark, f"{folder}/versions").count() == 1


@pytest.mark.parametrize("name,version", [("nobody", None), (Q.MODEL_NAME, "9999"), ("string", "")])
def test_unknown_models_are_named(spark, trained, name, version):
    with pytest.raises(LookupError, match="no (registered model|version)"):
        registry.load_model(spark, trained[0], name, version)


def test_probabilities(spark, trained):
    _, p, winner, _ = trained
    scored = learn.predict(winner.model, p.test, V.FEATURES, p.classes).collect()
    assert all(1 / len(p.classes) <= r["confidence"] <= 1 for r in scored)
    assert all(r["label"] == p.classes[r["prediction"]] for r in scored)
    short = learn.predict(winner.model, p.test, V.FEATURES, p.classes[:1]).select("prediction", "label").collect()
    assert all((r["label"] is None) == (r["prediction"] > 0) for r in short)


def test_both_candidates_learn_and_scores_do_not_depend_on_partitions(spark):
    p = Q.prepare(spark, SF)
    found = learn.fit_candidates(p.train, V.FEATURES, Q.estimators(p))
    assert [c.task_id for c in found] == ["train_logreg", "train_tree"]
    assert all(c.train_accuracy > 0.85 for c in found)
    assert found[0].params["maxIter"] == 500 and found[1].params["maxDepth"] == 3
    models = {c.task_id: c.model for c in found}
    assert learn.evaluate(p.test, models) == learn.evaluate(p.test.repartition(9), models)
    one = {t: select.accuracy(learn.predict(m, p.test, V.FEATURES, p.classes), "label", "lang").first()["accuracy"] for t, m in models.items()}
    assert one == learn.evaluate(p.test, models)


def test_labels_that_cannot_be_learned_are_refused(spark, folder):
    rows = learn.spread_values(V.table(spark, SF, "embeddings"), "embedding", [f"x{i}" for i in range(64)])
    rows = rows.withColumn("target", F.col("label").cast("int"))
    split = learn.stratified_split(rows, "vec_id", "target")
    train, test = (split.filter(F.col("split") == s) for s in ("train", "test"))
    found = learn.fit_candidates(train, [f"x{i}" for i in range(64)], {"train_tree": learn.tree()})[0]
    accuracy = learn.evaluate(test, {"t": found.model})["t"]
    tags = spark.createDataFrame([({},)], "tags map<string,string>")
    with pytest.raises(ValueError, match="refusing to register"):
        registry.register(found.model, folder, "m", accuracy, tags)


def test_contract(spark):
    rows = spark.createDataFrame([(1.0, 2, "k")], "a double, b int, k string")
    contract = learn.input_contract(rows, ["a", "b"])
    assert contract["example"] == [{"a": 1.0, "b": 2}]
    assert learn.meet_contract(rows.select("k", "b", "a"), contract).columns == ["a", "b", "k"]
    with pytest.raises(ValueError, match="missing columns: b"):
        learn.meet_contract(rows.drop("b"), contract)
    with pytest.raises(ValueError, match="b is string, not int"):
        learn.meet_contract(rows.withColumn("b", F.lit("x")), contract)


def test_a_loaded_model_carries_its_contract(spark, trained):
    base, p, _, _ = trained
    info, model = registry.load_model(spark, base, Q.MODEL_NAME)
    contract = contract_of(model)
    assert contract.schema().names == info["features"] == V.FEATURES and len(contract.example_rows()) == 3
    shuffled = p.test.select(*reversed(p.test.columns))
    one, other = (model.transform(rows).select("doc_id", "prediction") for rows in (p.test, shuffled))
    assert sorted(one.collect()) == sorted(other.collect())
    with pytest.raises(ValueError, match="missing columns: f_b, f_q"):
        model.transform(p.test.drop("f_b", "f_q"))
    with pytest.raises(ValueError, match="f_a is string, not double"):
        model.transform(p.test.withColumn("f_a", F.lit("x")))


def test_requests_are_routed_by_version(spark, trained, folder):
    _, p, winner, _ = trained
    tags = spark.createDataFrame([({"features": '["a"]', "classes": '["x"]'},)], "tags map<string,string>")
    for _ in range(2):
        registry.register(winner.model, folder, "m", 0.95, tags)
    good = [0.0] * 26
    requests = spark.createDataFrame(
        [(1, "m", "1"), (2, None, None), (3, "m", "7"), (4, "nobody", ""), (5, "m", None), (6, "m", "2"), (7, "m", "1")],
        "request_id int, name string, version string",
    )
    rows = spark.createDataFrame(
        [(1, 1, good), (1, 2, [1.0]), (2, 1, good), (3, 1, good), (5, 1, [0.0, 1.0]), (5, 2, good), (6, 1, None), (8, 1, good)],
        "request_id int, row_id int, row_values array<double>",
    )
    versions = registry.read_versions(spark, f"{folder}/versions")
    routed = {(r["request_id"], r["row_id"]): r["refusal"] for r in serve.route(requests, rows, versions, "m").collect()}
    wide = "expected 1 values (a), got %d"
    assert routed == {
        (1, 1): wide % 26, (1, 2): wide % 26, (2, 1): wide % 26, (3, 1): "no version '7' of model 'm'", (4, None): "no registered model 'nobody'",
        (5, 1): wide % 2, (5, 2): wide % 2, (6, 1): wide % 0, (7, None): "nothing to predict",
    }
    tags = spark.range(1).select(F.create_map(F.lit("features"), S.list_tag(V.FEATURES), F.lit("classes"), S.list_tag(p.classes)).alias("tags"))
    registry.register(winner.model, folder, "m", 0.95, tags)
    out = serve.answer(spark, folder, requests.filter("request_id IN (2, 4)"), rows, "m").orderBy("request_id").collect()
    assert [(r["request_id"], r["version"], r["refusal"]) for r in out] == [(2, "3", None), (4, None, "no registered model 'nobody'")]
    assert out[0]["label"] in p.classes and out[1]["prediction"] is None


def test_one_bad_row_refuses_its_request(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0])], "request_id int, v array<double>"
    )
    got = learn.split_by_width(rows, "v", ["a", "b"], "request_id").orderBy("request_id").collect()
    assert [r["accepted"] for r in got] == [False, False, True]
    alone = learn.split_by_width(rows, "v", ["a", "b"])
    assert alone.filter("accepted").count() == 2


def test_a_broken_trace_never_costs_an_answer(spark, trained, folder):
    _, p, winner, _ = trained
    scored = learn.predict(winner.model, p.test, V.FEATURES, p.classes)
    blocked = f"{folder}/file"
    open(blocked, "w").close()
    kept, traced = traces.write_scored(scored, f"{folder}/out", "uri", V.FEATURES, f"{blocked}/traces")
    assert kept.count() == p.test.count() and not traced
    kept, traced = traces.write_scored(scored, f"{folder}/out2", "uri", V.FEATURES, f"{folder}/traces")
    rows = spark.read.parquet(f"{folder}/traces")
    assert traced and rows.count() == kept.count()
    first = rows.first()
    assert len(first["inputs"]["row"]) == 26 and first["inputs"]["features"] == V.FEATURES
    assert traces.write_scored(scored, f"{folder}/out3", "uri", V.FEATURES)[1] is False


def test_best_candidate_rules(spark):
    rows = spark.createDataFrame(
        [("r", "train_b", "T", 0.9), ("r", "train_a", "T", 0.9), ("r", "prep", "X", 1.0), ("r", "train_c", "T", 0.5)],
        "run_id string, task_id string, kind string, accuracy double",
    )
    assert select.best_candidate(rows).first()["task_id"] == "train_a"
    lists = select.bake_off(rows).first()["candidates"]
    assert [c["task_id"] for c in lists] == ["train_a", "train_b", "train_c"]


def test_versions_compare_as_numbers(spark):
    v = spark.createDataFrame([("m", "2"), ("m", "10"), ("m", "9")], "name string, version string")
    assert select.latest_version(v).first()["version"] == "10"
    batch = spark.createDataFrame([("m", 2), ("m", 1), ("n", 3)], "name string, at int")
    got = {(r["name"], r["at"]): r["version"] for r in select.next_version(v, batch, [F.col("at")]).collect()}
    assert got == {("m", 1): 11, ("m", 2): 12, ("n", 3): 1}
    assert select.latest_version(v.filter("name = 'x'")).isEmpty()


def test_tags_of_a_version(spark):
    df = spark.range(1).select(
        registry.version_tags(
            F.lit("r"), F.lit(None).cast("string"), F.lit(0.97777), F.lit("K"), S.list_tag(["a"]), S.list_tag([])
        ).alias("t")
    )
    assert df.first()["t"] == {"run_id": "r", "accuracy": "0.9778", "kind": "K", "features": '["a"]', "classes": "[]"}


def test_null_labels_are_a_class_and_null_scores_never_win(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, kind string")
    assert {r["id"]: r["target"] for r in learn.class_index(rows, "kind").collect()} == {2: 0, 3: 1, 1: 2}
    scores = spark.createDataFrame(
        [("r", "train_a", "x", None), ("r", "train_b", "y", 0.5), ("q", "train_z", "z", None)],
        "run_id string, task_id string, kind string, accuracy double",
    )
    assert {r["run_id"]: r["task_id"] for r in select.best_candidate(scores).collect()} == {"r": "train_b", "q": "train_z"}
    wide = {r["run_id"]: r for r in select.metrics_wide(scores).collect()}
    assert wide["r"]["winner"] == "train_b" and wide["r"]["test_accuracy.train_b"] == 0.5 and "test_accuracy.train_z" in wide["r"]
    assert {(r["task_id"], r["winner"]) for r in select.metrics_long(scores).collect() if r["run_id"] == "r"} == {("train_a", "train_b"), ("train_b", "train_b")}


def test_grid_search_scores_every_fold_and_reads_once(spark):
    p = Q.prepare(spark, SF)
    rows = p.train.unionByName(p.test)
    estimators = learn.grid("tree", learn.tree(), maxDepth=[1, 4], impurity=["gini", "entropy"])
    assert sorted(estimators)[0] == "tree.impurity=entropy.maxDepth=1" and len(estimators) == 4
    found = learn.grid_search(rows, V.FEATURES, "doc_id", estimators, folds=3)
    scores = {(r["task_id"], r["fold"]): r["accuracy"] for r in found.scores.collect()}
    assert len(scores) == 12 and all(0 <= a <= 1 for a in scores.values())
    mean = {t: sum(scores[t, f] for f in range(3)) / 3 for t in estimators}
    assert found.winner.task_id == min(mean, key=lambda t: (-mean[t], t)) and "maxDepth=4" in found.winner.task_id
    held_out = rows.filter(learn.fold_of("doc_id", 3) == 1)
    t = found.winner.task_id
    again = learn.fit_candidates(rows.filter(learn.fold_of("doc_id", 3) != 1), V.FEATURES, {t: estimators[t]})[0]
    assert learn.evaluate(held_out, {"x": again.model})["x"] == scores[t, 1]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_grid_search_trusts_what_beats_the_largest_language(spark, monkeypatch):
    """Trusted: right more often than guessing each fold's largest language, not a fixed bar."""
    import types

    p = Q.prepare(spark, SF)
    rows = p.train.unionByName(p.test).withColumn("fold", learn.fold_of("doc_id", 3))
    shares = {r["fold"]: r["s"] for r in rows.groupBy("fold", "target").count().groupBy("fold").agg((F.max("count") / F.sum("count")).alias("s")).collect()}
    assert min(shares.values()) < 0.59 and max(shares.values()) > 0.61
    tasks = ["flat.regParam=0.001", "tree.maxDepth=2"]
    found = [(t, f, shares[f] + (0.01 if t.startswith("tree") else -0.01)) for t in tasks for f in range(3)]
    scores = spark.createDataFrame(found, "task_id string, fold int, accuracy double")
    monkeypatch.setattr(learn, "grid_search", lambda *a, **k: learn.Search(scores, types.SimpleNamespace(task_id="tree.maxDepth=2")))
    got = {(r["task_id"], r["fold"]): r["trusted"] for r in Q.grid_search(spark, SF).collect()}
    assert got == {(t, f): t.startswith("tree") for t in tasks for f in range(3)}
