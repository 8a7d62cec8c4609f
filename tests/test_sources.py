from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.operators import keyed
from runloom.session import small_table, stage, work_dir
from runloom.sources import files, logs, registry, store
from runloom.sources import tables as V


def put_log(folder, run, name, text):
    path = f"{folder}/{run}/logs"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


def test_newest_log_is_chosen_by_number(spark, folder):
    for n in (1, 9, 10):
        put_log(folder, "r1", f"a.{n}.log", f"try {n}\nline two")
    put_log(folder, "r1", "a.b.1.log", "dotted")
    put_log(folder, "r2", "a.1.log", "other run")
    got = {(r["run_dir"].split("/")[-2], r["task_id"]): r["text"] for r in logs.read_log_files(spark, folder).collect()}
    assert got == {("r1", "a"): "try 10\nline two", ("r1", "a.b"): "dotted", ("r2", "a"): "other run"}
    assert logs.read_log_files(spark, folder, "a", all_tries=True).count() == 4
    with pytest.raises(FileNotFoundError, match="no logs for task 'zz'"):
        logs.require_logs(logs.read_log_files(spark, folder, "zz"), "zz")


def test_log_lines_of_the_newest_attempt(spark, folder):
    rows = [("r", "a", n, f"line {n}") for n in (1, 9, 10)] + [("r", "b", 1, "x"), ("r", "b", 1, "y"), ("s", "a", 2, "other run")]
    lines = spark.createDataFrame(rows, "run_id string, task_id string, attempt long, line string")
    logs.write_log_lines(lines, f"{folder}/l")
    assert sorted(r["line"] for r in logs.read_log_lines(spark, f"{folder}/l").collect()) == ["line 10", "other run", "x", "y"]
    assert logs.read_log_lines(spark, f"{folder}/l", all_tries=True).count() == 6
    assert [r["line"] for r in logs.read_log_lines(spark, f"{folder}/l", run_id="r", task_id="a").collect()] == ["line 10"]
    assert logs.read_log_lines(spark, f"{folder}/l", run_id="zz").isEmpty()


RESULT = "run_id string, v int"


def test_a_run_replaces_its_own_rows_only(spark, folder):
    path = f"{folder}/out"
    first = spark.createDataFrame([(f"r{i}", i) for i in range(20)], RESULT)
    files.write_runs(first, path, buckets=3)
    files.write_runs(spark.createDataFrame([("r1", 100), ("r1", 101), ("new", 7)], RESULT), path, buckets=3)
    got = sorted((r["run_id"], r["v"]) for r in files.read_runs(spark, path, first.schema).collect())
    want = [(f"r{i}", i) for i in range(20) if i != 1] + [("r1", 100), ("r1", 101), ("new", 7)]
    assert got == sorted(want)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_of_two_runs_live_side_by_side(spark, folder, fmt):
    rows = spark.createDataFrame([(1, 0.5, "train"), (2, 1.5, "test"), (3, 2.5, "test")], "id long, x double, split string")
    files.write_split(rows, f"{folder}/s", "one", fmt)
    files.write_split(rows.filter("id > 2"), f"{folder}/s", "two", fmt)
    back = files.read_split(spark, f"{folder}/s", rows.schema, "one", "test", fmt)
    assert sorted(map(tuple, back.collect())) == [(2, 1.5), (3, 2.5)]
    assert files.read_split(spark, f"{folder}/s", rows.schema, "two", "test", fmt).count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_scan_names_the_numeric_columns(spark, folder):
    spark.createDataFrame([(0.1, 0.2, 1, "n")], "a double, b double, target int, note string").write.parquet(f"{folder}/t")
    assert files.scan_features(spark, f"{folder}/t")[1] == ["a", "b"]


def test_numbers_of_a_text_file(spark, folder):
    spark.createDataFrame([(" 42 ",), ("-3",), ("x",)], "value string").write.text(f"{folder}/n")
    assert sorted(str(r["value"]) for r in files.read_scale(spark, f"{folder}/n").collect()) == ["-6", "84", "None"]


def test_store_keeps_the_newest_version_of_a_row(spark, folder):
    store.create_store(spark, folder)
    run = spark.createDataFrame(
        [("r", "d", "running", "manual", 1.0, None, "/r", 0)],
        "run_id string, dag_id string, state string, trigger string, created_at double, finished_at double, run_dir string, seq int",
    )
    store.append(run, folder, "runs")
    store.append(run.withColumns({"state": F.lit("success"), "finished_at": F.lit(9.0), "seq": F.lit(1)}), folder, "runs")
    store.create_store(spark, folder)
    rows = store.read(spark, folder, "runs").collect()
    assert [(r["state"], r["finished_at"]) for r in rows] == [("success", 9.0)]
    for name in store.SCHEMAS:
        assert store.read(spark, folder, name).columns == [f.name for f in store.schema_of(name)][:-1]


def test_store_refuses_rows_without_their_key(spark, folder):
    store.create_store(spark, folder)
    bad = spark.createDataFrame([(None, 1.0, 0)], "dag_id string, last_run_at double, seq int")
    with pytest.raises(Exception, match="a required column is null"):
        store.append(bad, folder, "schedules")


def test_tracking_rows_are_found_by_their_run(spark, folder):
    for task in ("prep", "train"):
        ids = {"dag_id": "d", "run_id": "r1" if task == "prep" else "r2", "task_id": task}
        rows = registry.log_rows(spark, f"t-{task}", ids, {"max_iter": 500}, {"accuracy": 0.97}, {"kind": "K"})
        registry.append_log(rows, f"{folder}/log")
    log = registry.read_log(spark, f"{folder}/log")
    assert log.count() == 6
    found = log.filter((F.col("run_id") == "r1") & (F.col("kind") == "metric")).collect()
    assert [(r["task_id"], r["key"], r["value"]) for r in found] == [("prep", "accuracy", "0.97")]


def test_last_metric_value_wins(spark):
    rows = spark.createDataFrame(
        [("t", "m", 1.0, 1, 5), ("t", "m", 2.0, 2, 5), ("t", "m", 3.0, 9, 4)],
        "tracking_run string, metric_key string, metric_value double, step int, logged_at int",
    )
    assert registry.current_metrics(rows).first()["metric_value"] == 2.0
    runs = spark.createDataFrame([("t", "success"), ("u", "failed")], "run_id string, state string")
    assert [tuple(r) for r in registry.runs_with_metrics(runs, rows).collect()] == [("t", "success", "m", 2.0)]


def test_find_by_tag(spark):
    rows = spark.createDataFrame([("a", '{"k": "7"}'), ("b", '{"k": 8}'), ("c", None)], "id string, tags string")
    assert [r["id"] for r in registry.find_by_tag(rows, "tags", "k", "8").collect()] == ["b"]


def test_small_tables_become_local_and_large_ones_are_staged(spark):
    df = spark.range(50)
    assert small_table(df).count() == 50
    assert small_table(df, limit=10).count() == 50
    assert "LocalRelation" in small_table(df)._jdf.queryExecution().optimizedPlan().toString()


def test_work_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or work_dir(spark).startswith(base)


RUN_COLUMNS = "run_id string, dag_id string, state string, trigger string, created_at double, finished_at double, run_dir string"


def run_rows(spark, ids, state, seq):
    rows = [(str(i), "d", state, "manual", 1.0, None, "/r") for i in ids]
    return spark.createDataFrame(rows, RUN_COLUMNS).withColumn("seq", F.lit(seq))


def states(df):
    return {r["run_id"]: r["state"] for r in df.collect()}


def test_compaction_folds_and_later_batches_win(spark, folder):
    store.create_store(spark, folder)
    store.append(run_rows(spark, range(50), "pending", 0), folder, "runs")
    store.append(run_rows(spark, range(10), "running", 1), folder, "runs")
    store.compact(spark, folder, "runs")
    store.append(run_rows(spark, [3, 60], "success", 2), folder, "runs")
    store.append(run_rows(spark, [5], "late", 0), folder, "runs")  # an older version never wins
    want = {str(i): "running" if i < 10 else "pending" for i in range(50)} | {"3": "success", "60": "success"}
    assert states(store.read(spark, folder, "runs")) == want
    store.compact(spark, folder, "runs")
    gone = store.vacuum(spark, folder, "runs")
    assert states(store.read(spark, folder, "runs")) == want and len([g for g in gone if g.startswith("batch")]) == 5
    assert [n for n in files.list_names(spark, f"{folder}/runs") if n.startswith("batch")] == []
    store.append(run_rows(spark, [5], "success", 3), folder, "runs")
    assert states(store.read(spark, folder, "runs", {"run_id": "5"})) == {"5": "success"}


def test_one_run_reads_one_bucket(spark, folder):
    store.create_store(spark, folder)
    store.append(run_rows(spark, range(2000), "pending", 0), folder, "runs")
    store.compact(spark, folder, "runs")
    store.vacuum(spark, folder, "runs")
    one = store.read(spark, folder, "runs", {"run_id": "77"})
    assert states(one) == {"77": "pending"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(run_id,77)" in plan
    with pytest.raises(ValueError, match="state: not a key of runs"):
        store.read(spark, folder, "runs", {"state": "x"})


def test_failed_writers_and_rival_compactions_lose_nothing(spark, folder, monkeypatch):
    store.create_store(spark, folder)
    store.append(run_rows(spark, range(5), "pending", 0), folder, "runs")
    # a writer that died: a folder with rows, but not finished
    run_rows(spark, [99], "pending", 0).write.parquet(f"{folder}/runs/batch-dead")
    files.drop_path(spark, f"{folder}/runs/batch-dead/_SUCCESS")
    assert set(states(store.read(spark, folder, "runs"))) == set("01234")

    def lost(*_):
        raise OSError("lost")

    # a compaction that died before its live file
    monkeypatch.setattr(store, "write_new_text_file", lost)
    with pytest.raises(OSError):
        store.compact(spark, folder, "runs")
    monkeypatch.undo()
    assert set(states(store.read(spark, folder, "runs"))) == set("01234")
    # two at once: a rival finishes first, the other must not replace it
    real = store.write_new_text_file

    def overtaken(*a):
        monkeypatch.undo()
        store.append(run_rows(spark, [7], "pending", 0), folder, "runs")
        store.compact(spark, folder, "runs")
        real(*a)

    monkeypatch.setattr(store, "write_new_text_file", overtaken)
    with pytest.raises(Exception, match="exists"):
        store.compact(spark, folder, "runs")
    assert set(states(store.read(spark, folder, "runs"))) == set("012347")


def test_only_the_chosen_logs_are_read(spark, folder):
    os.makedirs(f"{folder}/r1/logs")
    for name, text in {"a.1.log": "old", "a.10.log": "new", "a.9.log": "nine", "b.1.log": "", "notes.txt": "no"}.items():
        with open(f"{folder}/r1/logs/{name}", "w") as f:
            f.write(text)
    listed = {(r["task_id"], r["attempt"]): r["length"] for r in logs.list_log_files(spark, folder, all_tries=True).collect()}
    assert listed == {("a", 1): 3, ("a", 9): 4, ("a", 10): 3}  # a file without a byte is not listed
    texts = logs.read_log_files(spark, folder)
    assert {r["task_id"]: r["text"] for r in texts.collect()} == {"a": "new"}
    plan = texts._jdf.queryExecution().executedPlan()
    scan = next(n for n in str(plan.toString()).split("\n") if "FileScan text" in n)
    assert "file_path" in scan.split("PartitionFilters")[1] or "file_path" in scan.split("DataFilters")[1]


def test_asked_logs_name_what_is_missing(spark, folder):
    lines = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "a", 2, "z"), (2, "b", 1, "w")], "run_id int, task_id string, attempt int, line string")
    logs.write_log_lines(lines, f"{folder}/l")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a"), (1, "a")], "run_id int, task_id string")
    found = logs.find_log_lines(spark, f"{folder}/l", asked).collect()
    got = sorted(((r["run_id"], r["task_id"], r["line"], r["problem"]) for r in found), key=str)
    assert got == [(1, "a", "y", None), (1, "a", "z", None), (1, "b", None, "no logs for task 'b' in 1"), (3, "a", None, "no logs for task 'a' in 3")]


def test_asked_logs_deal_no_table_twice(spark, folder):
    """Lines, asked tasks and index are shuffled once for the found logs; the latter two once for those without."""
    lines = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (2, "b", 1, "w")], "run_id int, task_id string, attempt int, line string")
    logs.write_log_lines(lines, f"{folder}/l")
    asked = spark.createDataFrame([(1, "a"), (3, "a")], "run_id int, task_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = logs.find_log_lines(spark, f"{folder}/l", asked)
        plan = str(found._jdf.queryExecution().executedPlan().toString())
        assert plan.count("Exchange hashpartitioning") <= 5
        assert sorted((r["run_id"], r["line"]) for r in found.collect()) == [(1, "y"), (3, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_log_index_names_the_attempts_that_were_written(spark, folder, monkeypatch):
    """Lines that are not the same when worked out again: index and table still agree, in one round or several."""
    keys = spark.range(500).selectExpr("id % 90 AS run_id", "concat('t', id % 7) AS task_id", "id")
    lines = keys.select("run_id", "task_id", F.floor(F.rand() * 9).alias("attempt"), F.col("id").cast("string").alias("line"))
    for name, size in (("one", logs.ROUND_BYTES), ("more", 1)):
        monkeypatch.setattr(logs, "ROUND_BYTES", size)
        logs.write_log_lines(lines, f"{folder}/{name}")
        written = logs.read_log_lines(spark, f"{folder}/{name}", all_tries=True).collect()
        assert sorted(int(r["line"]) for r in written) == list(range(500))
        index = {tuple(r) for r in spark.read.parquet(f"{folder}/{name}/attempts").select("run_id", "task_id", "attempt").collect()}
        assert index == {(r["run_id"], r["task_id"], r["attempt"]) for r in written}
        last = {}
        for r in written:
            last[r["run_id"], r["task_id"]] = max(r["attempt"], last.get((r["run_id"], r["task_id"]), -1))
        newest = logs.read_log_lines(spark, f"{folder}/{name}").collect()
        assert sorted(newest) == sorted(r for r in written if r["attempt"] == last[r["run_id"], r["task_id"]])


def test_log_tables_are_written_in_rounds(spark, folder, monkeypatch):
    """A filter of folders reaches the table below a rank, but not below another window: then the lines are copied first."""
    spark.range(3000).selectExpr("id % 400 AS run_id", "concat('t', id % 3) AS task_id", "id * 7919 % 3000 AS v").write.parquet(f"{folder}/t")
    rows = spark.read.parquet(f"{folder}/t")
    by_key = keyed.rank_rows(rows, ["run_id", "task_id"], [F.col("v")], "attempt")
    by_value = rows.withColumn("attempt", F.row_number().over(Window.partitionBy(F.col("v") % 5).orderBy("v")))
    monkeypatch.setattr(logs, "ROUND_BYTES", 1)
    copies = []
    monkeypatch.setattr(logs, "stage", lambda df, label, path: copies.append(path) or stage(df, label, path))
    for name, ranked in (("parts", by_key), ("whole", by_value)):
        lines = ranked.select("run_id", "task_id", "attempt", F.col("v").cast("string").alias("line"))
        logs.write_log_lines(lines, f"{folder}/{name}")
        assert len(copies) == (name == "whole")
        assert sorted(logs.read_log_lines(spark, f"{folder}/{name}", all_tries=True).collect()) == sorted(lines.collect())
    assert not os.path.exists(copies[0])


def test_a_run_is_replaced_without_touching_others(spark, folder):
    path = f"{folder}/runs"
    first = spark.createDataFrame([(f"r{i}", i) for i in range(2000)], RESULT)
    files.write_runs(first, path, buckets=8)
    files.write_runs(spark.createDataFrame([("r1", 100)], RESULT), path, buckets=8)
    writes = sorted(files.list_names(spark, f"{path}/data"), key=lambda n: int(n.removeprefix("write=").split("-")[0]))
    assert [spark.read.parquet(f"{path}/data/{w}").count() for w in writes] == [2000, 1]  # bytes follow the replaced run
    # a writer that died before its live file, and one that lost the race for it
    monkey = spark.createDataFrame([("r2", 200)], RESULT)
    real = files.write_new_text_file

    def die(*_):
        raise OSError("lost")

    files.write_new_text_file = die
    try:
        with pytest.raises(OSError):
            files.write_runs(monkey, path, buckets=8)
        files.write_new_text_file = lambda s, p, text: (real(s, p, "3-rival"), real(s, p, text))
        with pytest.raises(Exception, match="exists"):
            files.write_runs(monkey, path, buckets=8)
    finally:
        files.write_new_text_file = real
    got = {r["run_id"]: r["v"] for r in files.read_runs(spark, path, first.schema).collect()}
    assert got == {f"r{i}": i for i in range(2000)} | {"r1": 100}
    files.write_runs(first.filter("v <> 1"), f"{folder}/other", buckets=8)
    files.write_runs(first, f"{folder}/other", buckets=8)
    assert len(files.vacuum_runs(spark, f"{folder}/other", first.schema)) == 1  # the first write holds no run any more
    assert files.read_runs(spark, f"{folder}/other", first.schema).count() == 2000
    assert files.read_runs(spark, f"{folder}/none", first.schema).isEmpty()


def test_letters_are_counted_whole(spark):
    texts = ["aAbB zZ", "", None, "éÀkK", "x" * 100_000, "漢字 İi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("lang", F.lit("x"))
    got = {r["doc_id"]: r for r in V.letter_shares(docs.coalesce(1)).collect()}
    for i, t in enumerate(texts):
        for c in V.LETTERS:
            want = None if t is None else round(t.lower().count(c) / max(1, len(t)), 9)
            assert got[i][f"f_{c}"] == want
