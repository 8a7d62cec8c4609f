"""Streams over files that arrive one by one."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators import learn
from runloom.plans import learn_queries as Q
from runloom.sources import tables as V
from runloom.streaming import streams

SF = "/root/testdata/sf0.001"
CHANGE = "run_id string, state string, seq long, changed_at long"


def put(spark, folder, name, rows, schema):
    """One more file in the watched folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def feed(spark, folder, name, schema):
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}")


def test_late_changes_lose(spark, folder):
    def run():
        changes = feed(spark, folder, "in", CHANGE)
        streams.track_state(changes, ["run_id"], "seq", f"{folder}/out", f"{folder}/cp").awaitTermination()
        got = streams.read_state(spark, f"{folder}/out", changes.schema, ["run_id"]).collect()
        return {r["run_id"]: (r["state"], r["seq"]) for r in got}

    put(spark, folder, "in", [("a", "running", 5, 50), ("b", "pending", 1, 10)], CHANGE)
    assert run() == {"a": ("running", 5), "b": ("pending", 1)}
    put(spark, folder, "in", [("a", "pending", 3, 30), ("b", "success", 2, 20)], CHANGE)
    assert run() == {"a": ("running", 5), "b": ("success", 2)}
    assert run() == {"a": ("running", 5), "b": ("success", 2)}


def test_stuck_runs_come_and_go(spark, folder):
    def run():
        changes = feed(spark, folder, "in", CHANGE)
        streams.flag_stuck(changes, 900, f"{folder}/out", f"{folder}/cp").awaitTermination()
        return {r["run_id"]: r["stuck_for"] for r in streams.read_stuck(spark, f"{folder}/out", changes.schema).collect()}

    put(spark, folder, "in", [("a", "running", 1, 0), ("b", "running", 2, 100), ("c", "success", 3, 1000)], CHANGE)
    assert run() == {"a": 1000}
    put(spark, folder, "in", [("d", "pending", 4, 1001)], CHANGE)
    assert run() == {"a": 1001, "b": 901}
    put(spark, folder, "in", [("a", "failed", 5, 1002), ("b", "success", 6, 1003)], CHANGE)
    assert run() == {}


def test_each_change_is_acted_on_once(spark, folder):
    schema = "app_name long, dag_id string, desired string, seq long"
    applied = spark.createDataFrame([(1, "v1"), (2, "v0")], "app_name long, revision string")
    runs = spark.createDataFrame([(1, "d", "success"), (3, "d", "failed")], "app_name long, dag_id string, state string")

    def run():
        rows = feed(spark, folder, "in", schema)
        streams.reconcile(rows, applied, runs, f"{folder}/out", f"{folder}/cp", seq="seq").awaitTermination()
        acted = spark.read.parquet(f"{folder}/out/actions").select("batch_id", "app_name", "desired", "action")
        return sorted(map(tuple, acted.collect()))

    put(spark, folder, "in", [(1, "d", "v1", 1), (2, "d", "v1", 2), (3, "d", "v1", 3)], schema)
    first = [(0, 2, "v1", "synced"), (0, 3, "v1", "failed")]
    assert run() == first
    put(spark, folder, "in", [(2, "d", "v1", 4), (1, "d", "v2", 5), (1, "d", "v3", 6), (3, "d", "v1", 7)], schema)
    second = [*first, (1, 1, "v3", "synced"), (1, 3, "v1", "failed")]
    assert run() == second
    put(spark, folder, "in", [(1, "d", "v3", 8)], schema)
    assert run() == second


RUN_CHANGE = "app_name string, run_id long, state string, seq long"


def test_outcomes_follow_run_changes(spark, folder, monkeypatch):
    """Seven micro-batches with late, repeated and unusable changes, one application with most runs; the last batch replayed."""
    monkeypatch.setattr(streams, "FAN", 2)
    best: dict = {}
    for i in range(7):
        rows = [("hot", r, "success" if (r + i) % 3 else "failed", (7 * i + r) % 11) for r in range(60)]
        rows += [("a", 1, "running", i), ("b", i, "success", 1), ("b", 0, "failed", 1 if i else 0), ("late", 5, f"s{i}", 9 - i), ("late", 5, "success", 8)]
        rows += [(None, 1, "failed", 1), ("a", None, "failed", 1), ("a", 2, "failed", None), ("quiet", 1, None, i)]
        put(spark, folder, "in", rows, RUN_CHANGE)
        for app, run, state, seq in rows:
            if None not in (app, run, seq) and ((app, run) not in best or seq > best[app, run][0]):
                best[app, run] = (seq, state)

        def outcomes():
            changes = feed(spark, folder, "in", RUN_CHANGE)
            streams.track_outcomes(changes, f"{folder}/out", f"{folder}/cp").awaitTermination()
            return {r.app_name: (r.ok, r.n) for r in streams.read_outcomes(spark, f"{folder}/out", T.StringType()).collect()}

        want = {}
        for (app, _), (_, state) in best.items():
            ok, n = want.get(app, (True, 0))
            want[app] = (ok and state in ("success", None), n + 1)
        assert outcomes() == want
    for name in ("6", ".6.crc"):  # as if the writer was lost before it could commit
        os.remove(f"{folder}/cp/commits/{name}")
    assert outcomes() == want
    assert streams.read_outcomes(spark, f"{folder}/none", T.StringType()).count() == 0


def test_reconcile_takes_one_source_of_outcomes(spark, folder):
    with pytest.raises(ValueError, match="either"):
        streams.reconcile(None, None, None, folder, folder)


@pytest.mark.parametrize("trace", [True, False])
def test_stream_scores_equal_batch_scores(spark, folder, trace):
    p, c = Q.fit_one(spark, SF, "train_tree")
    documents = V.table(spark, SF, "documents")
    halves = [documents.filter(F.col("doc_id") % 2 == i) for i in (0, 1)]
    out = f"{folder}/out"
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = V.letter_shares(feed(spark, folder, "in", documents.schema)).drop("lang")
        streams.score(rows, c.model, V.FEATURES, p.classes, out, f"{folder}/cp", "uri", trace).awaitTermination()
    columns = ["doc_id", "prediction", "label", "confidence"]
    got = spark.read.parquet(f"{out}/predictions").select(*columns)
    want = learn.predict(c.model, V.doc_features(spark, SF).drop("lang"), V.FEATURES, p.classes).select(*columns)
    assert sorted(got.collect()) == sorted(want.collect())
    if trace:
        assert spark.read.parquet(f"{out}/traces").count() == got.count()


def test_state_over_many_batches(spark, folder, monkeypatch):
    """Ten micro-batches with late and repeated changes: few folders are read, each state is the newest."""
    monkeypatch.setattr(streams, "FAN", 3)
    best: dict = {}
    for i in range(10):
        rows = [("hot", f"s{i}", 2 * i, i), ("late", f"s{i}", 100 - i, i), (f"only{i}", "done", i, i), ("same", "x", 7, 7)]
        put(spark, folder, "in", rows, CHANGE)
        for run, state, seq, _ in rows:
            best[run] = max(best.get(run, (-1, "")), (seq, state))
        changes = feed(spark, folder, "in", CHANGE)
        streams.track_state(changes, ["run_id"], "seq", f"{folder}/out", f"{folder}/cp").awaitTermination()
    read = streams.read_state(spark, f"{folder}/out", changes.schema, ["run_id"])
    assert {r["run_id"]: (r["seq"], r["state"]) for r in read.collect()} == best
    assert {f.split("/out/")[1].rsplit("/", 1)[0] for f in read.inputFiles()} == {"level=2/upto=8", "level=0/upto=9"}


@pytest.mark.parametrize("newest", range(30))
def test_folders_cover_every_batch_once(newest, monkeypatch):
    monkeypatch.setattr(streams, "FAN", 3)
    held = [b for level, upto in streams._folders(newest) for b in range(upto - 3**level + 1, upto + 1)]
    assert held == list(range(newest + 1))


def test_tables_held_as_folders_of_parts_stream_whole(spark, folder):
    """A table may be a folder of part files, as Spark writes it, not one file."""
    V.table(spark, SF, "events").repartition(3).write.parquet(f"{folder}/events.parquet")
    want = sorted(Q.stream_state(spark, SF).collect())
    got = sorted(Q.stream_state(spark, folder).collect())
    assert len(got) > 0 and got == want
