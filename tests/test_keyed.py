"""Ranking and lists per key, with the sliced path forced."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from runloom.operators import keyed
from runloom.session import shuffles_dropped


def skewed(spark, n=3000, seed=1):
    """One key holds a third of the rows, another is null."""
    rng = random.Random(seed)
    keys = [None, "hot", "hot", *[f"k{i}" for i in range(40)]]
    rows = [(rng.choice(["hot", rng.choice(keys), rng.choice(keys)]), rng.randrange(10**6), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v long, id long").repartition(6)


def test_sliced_rank_equals_window_rank(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.col("id")]
    plain = keyed.rank_rows(df, ["k"], order, "n")
    sliced = keyed.rank_rows(df, ["k"], order, "n", slice_rows=100)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.collect()), key=str)


def test_no_slice_holds_a_whole_hot_key(spark, monkeypatch):
    """One key at 0.5 % and one at 40 % of the rows: no (key, slice) group is over the limit by much."""
    kinds = F.when(F.col("id") % 5 < 2, "forty").when(F.col("id") % 200 == 3, "half").otherwise(F.col("id").cast("string"))
    df = spark.range(20_000).withColumn("k", kinds).withColumn("v", F.col("id") % 3)  # order with many ties
    seen = {}
    stage = keyed.stage
    monkeypatch.setattr(keyed, "stage", lambda df, label: seen.setdefault(label, stage(df, label)))
    out = keyed.rank_rows(df, ["k"], [F.col("v")], "n", slice_rows=500)
    assert out.groupBy("k").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d"), F.count("*").alias("c")).filter("m <> d OR m <> c").isEmpty()
    assert out.filter("k = 'forty'").agg(F.max("n")).first()[0] == 8000
    rows = seen["slices"][0]
    assert rows.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 1000


def test_a_table_without_hot_keys_is_ranked_and_folded_in_one_shuffle(spark, folder, monkeypatch):
    """Nothing is copied, and the newest row per key needs no shuffle beside that of the rank."""
    spark.range(5000).selectExpr("id % 1700 AS k", "id * 7919 % 5000 AS v", "id").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    plain = sorted(map(tuple, keyed.rank_rows(df, ["k"], [F.col("v")], "n").collect()))
    monkeypatch.setattr(keyed, "SLICE_BYTES", 0)
    monkeypatch.setattr(keyed, "SLICE_ROWS", 1000)
    monkeypatch.setattr(keyed, "stage", lambda *_: pytest.fail("the table was copied"))
    ranked = keyed.rank_rows(df, ["k"], [F.col("v")], "n")
    assert sorted(map(tuple, ranked.collect())) == plain
    newest = keyed.latest(ranked, ["k"], ["n"])
    assert newest.count() == 1700
    plan = str(newest._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1


@pytest.mark.parametrize("keys", [["k"], []])
def test_only_crowded_keys_are_cut_into_slices(spark, monkeypatch, keys):
    df = skewed(spark).where("k <> 'k7' OR k IS NULL")
    seen = {}
    stage = keyed.stage
    monkeypatch.setattr(keyed, "stage", lambda df, label: seen.setdefault(label, stage(df, label)))
    order = [F.desc("v"), F.col("id")]
    got = keyed.rank_rows(df, keys, order, "n", slice_rows=400)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, keyed.rank_rows(df, keys, order, "n").collect()), key=str)
    assert {r["k"] for r in seen["slices"][0].select("k").distinct().collect()} == ({"hot"} if keys else {r["k"] for r in df.select("k").distinct().collect()})


def test_rank_of_two_keys_keeps_every_row(spark):
    df = skewed(spark).withColumn("h", F.col("id") % 2)
    out = keyed.rank_rows(df, ["k", "h"], [F.col("id")], "n", slice_rows=200)
    assert out.count() == df.count()
    worst = out.groupBy("k", "h").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert worst.filter("c <> m OR c <> d").isEmpty()


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle_")}


def test_a_write_can_drop_its_shuffle_files(spark):
    df = spark.range(2000).groupBy((F.col("id") % 300).alias("k")).count()
    before = shuffle_files(spark)
    with shuffles_dropped(spark):
        back, n = keyed.stage(df, "dropped")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:  # executors do it a little later
        time.sleep(0.2)
    assert not left and n == 300 and sorted(back.collect()) == sorted(df.collect())


def test_lists_copy_their_items_alone(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id % 300 AS k", "id").groupBy("k", "id").agg(F.repeat(F.lit("x"), 100).alias("text"), F.max("id").alias("v"))
    plain = sorted(map(tuple, keyed.nest(df, ["k"], [F.desc("id")], F.struct("id", "v"), "items").collect()))
    copied = {}
    stage = keyed.stage
    monkeypatch.setattr(keyed, "SLICE_BYTES", 0)
    monkeypatch.setattr(keyed, "SLICE_ROWS", 500)
    monkeypatch.setattr(keyed, "stage", lambda df, label: copied.setdefault(label, stage(df, label)))
    rows = keyed.nest(df, ["k"], [F.desc("id")], F.struct("id", "v"), "items")
    assert copied["unranked"][0].columns == ["k", "id", "_item"]
    assert sorted(map(tuple, rows.collect())) == plain


def test_long_lists_go_on_in_chunks(spark):
    df = spark.range(25).withColumn("k", F.lit("a"))
    rows = keyed.nest(df, ["k"], [F.col("id")], F.col("id"), "ids", chunk=10).orderBy("chunk").collect()
    assert [len(r["ids"]) for r in rows] == [10, 10, 5]
    assert [x for r in rows for x in r["ids"]] == list(range(25))
    forced = keyed.nest(df, ["k"], [F.col("id")], F.col("id"), "ids", chunk=10, slice_rows=4).orderBy("chunk").collect()
    assert forced == rows


def test_latest_keeps_nulls_of_the_newest_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "y")], "k string, seq int, v string")
    got = {r["k"]: (r["seq"], r["v"]) for r in keyed.latest(df, ["k"], ["seq"]).collect()}
    assert got == {"a": (2, None), "b": (5, "y")}


def test_upsert_replaces_adds_and_keeps(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    got = {r["k"]: r["v"] for r in keyed.upsert(old, new, ["k"]).collect()}
    assert got == {"a": 1, "b": None, "c": 3}


def test_upsert_into_an_empty_table(spark):
    old = spark.createDataFrame([], "k string, v int")
    assert keyed.upsert(old, spark.createDataFrame([Row(k="a", v=1)], "k string, v int"), ["k"]).count() == 1
