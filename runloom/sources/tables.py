"""Reading the given tables and deriving the workflow tables from them.

Each view has a Spark builder here and the same view as SQL text in
``runloom/plans/view_sql.py`` for the checks.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.keyed import rank_rows, spread
from runloom.session import local_table

NOW = 1706745600  # the fixed clock of every query over the given tables
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEATURES = [f"f_{c}" for c in LETTERS]
TASK_RETRIES = {"t1": 0, "t2": 1, "t3": 1, "t4": 0, "t5": 4, "t6": 0, "t7": 2}
DAG_IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DAG_EDGES = {
    "1-URGENT": "t1>t2 t2>t3 t3>t4 t4>t5 t5>t6 t6>t7",
    "2-HIGH": "t1>t2 t1>t3 t2>t4 t3>t4 t4>t5",
    "3-MEDIUM": "t1>t2 t2>t3 t2>t5 t3>t4 t5>t6",
    "4-NOT SPECIFIED": "t1>t2 t1>t3 t1>t4 t1>t5 t1>t6 t1>t7",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(c: str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(F.to_date(c)).cast("bigint")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    created = epoch("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("dag_id"),
        F.when(F.col("o_orderstatus") == "O", "running")
        .when(F.col("o_orderstatus") == "F", "success")
        .otherwise("failed")
        .alias("state"),
        F.when(F.col("o_custkey") % 4 == 0, "manual")
        .when(F.col("o_custkey") % 4 == 1, "schedule")
        .when(F.col("o_custkey") % 4 == 2, "gitops")
        .otherwise("api")
        .alias("trigger"),
        created.alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", created + 60 + F.col("o_custkey") % 3600).alias("finished_at"),
        F.concat(F.lit("/runs/"), F.col("o_orderkey").cast("string")).alias("run_dir"),
    )


def app_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs started for an application (one application per customer)."""
    return runs(spark, sf).join(
        table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("app_name")
        ),
        "run_id",
    )


ATTEMPT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def attempt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line items behind the attempts, by the keys of these."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("task_id"),
        *ATTEMPT_ORDER,
        "l_returnflag",
        "l_linestatus",
    )


def attempt_columns() -> list[Column]:
    ok = F.concat(F.lit('{"ok": true, "result": {"value": '), F.col("l_partkey").cast("string"), F.lit("}}"))

    def bad(text: str) -> Column:
        return F.lit('{"ok": false, "error": "' + text + '"}')

    kind = F.col("l_partkey") % 4
    return [
        epoch("l_shipdate").alias("started_at"),
        (epoch("l_shipdate") + F.col("l_quantity").cast("bigint")).alias("finished_at"),
        F.col("l_linestatus").alias("line_status"),
        F.when(F.col("l_returnflag") != "R", ok)
        .when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, bad("ConnectionError: upstream API returned 503"))
        .when(kind == 2, bad("GitError: git fetch failed: Permission denied (publickey)"))
        .otherwise(bad("RuntimeError: failed on purpose"))
        .alias("envelope"),
    ]


def attempt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts without their number."""
    lines = attempt_lines(spark, sf)
    return lines.select("run_id", "task_id", *attempt_columns(), F.struct(*ATTEMPT_ORDER).alias("_order"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered as narrow line items; texts are made of the ranked rows, so none is shuffled."""
    ranked = rank_rows(attempt_lines(spark, sf), ["run_id", "task_id"], [F.col(c) for c in ATTEMPT_ORDER], "attempt")
    return ranked.select("run_id", "task_id", "attempt", *attempt_columns())


def tasks(spark: SparkSession) -> DataFrame:
    """Task list of the five DAGs: 35 fixed rows."""
    rows = [(d, t, r) for d in DAG_IDS for t, r in TASK_RETRIES.items()]
    return local_table(spark, rows, "dag_id string, task_id string, retries int")


def run_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Every task of every run."""
    return spread(runs(spark, sf).select("run_id", "dag_id")).join(tasks(spark), "dag_id")


def edges(spark: SparkSession) -> DataFrame:
    """Edges of the five DAGs: 22 fixed rows."""
    rows = [(d, *e.split(">")) for d, text in DAG_EDGES.items() for e in text.split()]
    return local_table(spark, rows, "dag_id string, upstream string, downstream string")


def latest_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Last attempt of each task and its number, from one fold."""
    return (
        spread(attempt_rows(spark, sf), "run_id", "task_id")
        .groupBy("run_id", "task_id")
        .agg(
            F.count(F.lit(1)).alias("attempt"),
            F.max_by(
                F.struct("started_at", "finished_at", "line_status", "envelope"), "_order"
            ).alias("l"),
        )
        .select("run_id", "task_id", "attempt", "l.*")
    )


def task_states(spark: SparkSession, sf: str) -> DataFrame:
    l = latest_attempts(spark, sf)
    r = spread(runs(spark, sf).select("run_id", "dag_id", F.col("state").alias("run_state")))
    ok = F.coalesce(F.col("envelope").startswith('{"ok": true'), F.lit(False))
    open_line = (F.col("run_state") == "running") & (F.col("line_status") == "O") & ~ok
    return (
        r.join(tasks(spark).drop("retries"), "dag_id")
        .join(l, ["run_id", "task_id"], "left")
        .select(
            "run_id",
            "dag_id",
            "task_id",
            F.when(F.col("attempt").isNull(), "pending")
            .when(ok, "success")
            .when(open_line, "running")
            .otherwise("failed")
            .alias("state"),
            F.coalesce("attempt", F.lit(0)).cast("bigint").alias("try_number"),
            "started_at",
            F.when(~F.coalesce(open_line, F.lit(False)), F.col("finished_at")).alias("finished_at"),
        )
    )


def run_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each customer numbered 1, 2, ...: the tasks of one DAG per customer."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dag_id"), F.col("o_orderkey").alias("task_id")
    )
    return rank_rows(o, ["dag_id"], [F.col("task_id")], "i")


def edges_big(spark: SparkSession, sf: str) -> DataFrame:
    """Heap parent of each task plus some fan-in; acyclic, one DAG per customer."""
    n = run_steps(spark, sf)
    child = n.select(
        "dag_id",
        F.col("task_id").alias("downstream"),
        F.explode(
            F.array_distinct(
                F.when(F.col("i") % 3 == 0, F.array(F.expr("i div 2"), F.col("i") - 1)).otherwise(
                    F.array(F.expr("i div 2"))
                )
            )
        ).alias("i"),
    )
    return child.join(n.withColumnRenamed("task_id", "upstream"), ["dag_id", "i"]).select(
        "dag_id", "upstream", "downstream"
    )


def edges_faulty(spark: SparkSession, sf: str) -> DataFrame:
    """``edges_big`` with back edges, self loops and unknown parents in some DAGs."""
    n = run_steps(spark, sf)
    second = n.filter("i = 2").select("dag_id", F.col("task_id").alias("downstream"))
    back = (
        n.filter("dag_id % 7 = 0 AND i = 4")
        .select("dag_id", F.col("task_id").alias("upstream"))
        .join(second, "dag_id")
        .select("dag_id", "upstream", "downstream")
    )
    loops = n.filter("dag_id % 11 = 0 AND i = 3").select(
        "dag_id", F.col("task_id").alias("upstream"), F.col("task_id").alias("downstream")
    )
    unknown = n.filter("dag_id % 13 = 0 AND i = 1").select(
        "dag_id", (-1 - F.col("task_id")).alias("upstream"), F.col("task_id").alias("downstream")
    )
    return edges_big(spark, sf).unionByName(back).unionByName(loops).unionByName(unknown)


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 11 == 0, "30s")
    for i, s in enumerate(["5m", "2h", "1d", "@hourly", "@daily", "@weekly", "@once", " 1.5h ", "*/5 * * * *"], 1):
        text = text.when(k % 11 == i, s)
    return table(spark, sf, "customer").select(
        k.alias("dag_id"),
        text.alias("schedule"),
        F.when(k % 7 != 0, F.lit(NOW) - k * 60).alias("last_run_at"),
    )


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    return revision_rows(table(spark, sf, "customer"))


def revision_rows(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    head = F.md5(F.concat(F.lit("head"), k.cast("string")))
    old = F.md5(F.concat(F.lit("old"), k.cast("string")))
    return customers.select(
        k.alias("app_name"),
        F.col("c_mktsegment").alias("dag_id"),
        head.alias("desired"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 < 3, head).otherwise(old).alias("applied"),
    )


def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    s = F.col("p_size")
    return rank_rows(p, ["p_brand"], [F.col("p_partkey")], "v").select(
        F.col("p_brand").alias("name"),
        F.col("v").cast("string").alias("version"),
        F.when(s % 5 != 0, F.col("p_type")).alias("kind"),
        (s.cast("double") / 50.0).alias("accuracy"),
        F.when(s % 3 == 0, F.lit(None).cast("string")).when(s % 3 == 1, "").otherwise("iris").alias("experiment_tag"),
        F.col("p_partkey").alias("source_run"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber", "l_returnflag")
        .agg(F.max("l_quantity").alias("q"))
        .select(
            F.col("l_orderkey").alias("run_id"),
            F.concat(F.lit("train_"), F.col("l_linenumber").cast("string")).alias("task_id"),
            F.col("l_returnflag").alias("kind"),
            (F.col("q").cast("int").cast("double") / 50.0).alias("accuracy"),
        )
    )


def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tracking_run"),
        F.col("event_type").alias("metric_key"),
        F.col("value").alias("metric_value"),
        F.col("event_id").alias("step"),
        F.col("ts").alias("logged_at"),
        "props",
    )


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    return letter_shares(spread(table(spark, sf, "documents").select("doc_id", "lang", "text")))


def letter_shares(documents: DataFrame) -> DataFrame:
    """Share of each letter in the whole text.

    One Arrow-batched pass counts all letters, over the bytes of a batch of texts as they lie; 26 ``replace``
    expressions walk the text 26 times and take about seven times as long.
    """
    first, last = ord(LETTERS[0]), ord(LETTERS[-1])

    @F.arrow_udf("array<int>")
    def letter_counts(texts: pa.Array) -> pa.Array:
        low = pc.utf8_lower(texts.cast(pa.large_string()))
        bounds = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1].tolist()
        raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)
        counts = [np.bincount(raw[a:b], minlength=last + 1)[first : last + 1] for a, b in pairwise(bounds)]
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *counts]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * len(LETTERS)), flat)
        return pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type))

    counted = documents.select(
        "doc_id", "lang", F.greatest(F.length("text"), F.lit(1)).alias("n"), letter_counts("text").alias("c")
    )
    shares = [F.round(F.get("c", F.lit(i)).cast("double") / F.col("n"), 9).alias(f) for i, f in enumerate(FEATURES)]
    return counted.select("doc_id", "lang", *shares)


def score_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to score, four to a request; every tenth is cut to three values."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 4").alias("request_id"),
        "vec_id",
        F.expr("CASE WHEN vec_id % 10 = 0 THEN slice(embedding, 1, 3) ELSE embedding END").alias("row_values"),
    )


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("req_id"),
        "l_linenumber",
        F.concat(
            F.col("l_partkey").cast("string"),
            F.lit(", "),
            F.col("l_suppkey").cast("string"),
            F.lit(" "),
            F.when(F.col("l_partkey") % 9 == 0, "abc").otherwise(F.col("l_linenumber").cast("string")),
        ).alias("raw"),
    )


def name_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Model requests with the blanks and fillers that callers send."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("request_id"),
        F.when(k % 6 == 0, F.lit(None).cast("string"))
        .when(k % 6 == 1, " String ")
        .when(k % 6 == 2, "NONE")
        .when(k % 6 == 3, "no such model")
        .otherwise(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")))
        .alias("name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, " null").otherwise(F.col("p_size").cast("string")).alias("version"),
    )


def step_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Function references in the shapes callers write."""
    k = F.col("p_partkey")
    mod = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    return table(spark, sf, "part").select(
        k.alias("part_key"),
        F.when(k % 4 == 0, mod)
        .when(k % 4 == 1, F.concat(mod, F.lit(":"), F.col("p_type")))
        .when(k % 4 == 2, F.concat(mod, F.lit(":"), F.col("p_type"), F.lit(".run")))
        .otherwise(F.concat(mod, F.lit(":a:b")))
        .alias("ref"),
    )


def chain_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One dependency chain per line item, several per DAG."""
    n = F.col("l_linenumber")
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    t = F.concat(F.lit("t"), n.cast("string"))
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("dag_id"),
        F.when(n % 4 == 0, F.concat(t, F.lit(" >> ["), p, F.lit(", "), s, F.lit("] >> end")))
        .when(n % 4 == 1, F.concat(F.lit("["), p, F.lit(","), s, F.lit("] >> "), t))
        .when(n % 4 == 2, F.concat(F.lit("["), p, F.lit(", "), s, F.lit("] >> ["), t, F.lit(", end]")))
        .otherwise(F.concat(p, F.lit(" >> "), t))
        .alias("chain"),
    )
