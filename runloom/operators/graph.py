"""Dependency-graph jobs over one edge table ``(dag_id, upstream, downstream)``.

All DAGs advance together.  Each round is one Spark job whose result is written
to the shared work folder, so plans stay short and a lost executor costs a re-read.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions import fixed
from runloom.operators.keyed import nest, rank_rows
from runloom.session import new_dir, stage, stage_counted


def expand_edges(chains: DataFrame) -> DataFrame:
    """Edges of chains ``a >> [b, c] >> d``; the edges of a DAG are a set.

    ``chains(dag_id, chain)``.  A list directly after a list has no meaning: such a
    chain gives no edge but is a row of ``refused_chains``; ``expand_or_refuse`` gives both.
    """
    steps = F.split(F.col("chain"), r">>")
    links = F.arrays_zip(F.slice(steps, 1, F.size(steps) - 1).alias("up"), F.slice(steps, 2, F.size(steps)).alias("down"))
    return (
        chains.filter(~_has_list_after_list(F.col("chain")))
        .filter(F.col("chain").contains(">>"))
        .select("dag_id", F.explode(links).alias("l"))
        .select("dag_id", F.explode(_names(F.col("l.up"))).alias("upstream"), "l.down")
        .select("dag_id", "upstream", F.explode(_names(F.col("down"))).alias("downstream"))
        .filter("upstream <> '' AND downstream <> ''")
        .distinct()
    )


def refused_chains(chains: DataFrame) -> DataFrame:
    return chains.filter(_has_list_after_list(F.col("chain")))


def expand_or_refuse(chains: DataFrame) -> DataFrame:
    """The edges, and each chain that is refused with its text in ``refused`` and no ends."""
    none = F.lit(None).cast("string")
    refused = refused_chains(chains).select("dag_id", none.alias("upstream"), none.alias("downstream"), F.col("chain").alias("refused"))
    return expand_edges(chains).withColumn("refused", none).unionByName(refused)


def _has_list_after_list(chain: Column) -> Column:
    return chain.rlike(r"\]\s*>>\s*\[")


def _names(step: Column) -> Column:
    """One name, or the names of ``[a, b]``."""
    return F.split(F.btrim(step, F.lit(" []")), r"\s*,\s*")


def unknown_refs(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """Edge ends that name no task: ``(dag_id, task_id, unknown)``."""
    known = tasks.select("dag_id", F.col("task_id").alias("unknown"))
    ends = edges.select("dag_id", F.col("upstream").alias("unknown"), F.col("downstream").alias("task_id")).unionByName(
        edges.select("dag_id", F.col("downstream").alias("unknown"), F.col("upstream").alias("task_id"))
    )
    return ends.join(known, ["dag_id", "unknown"], "left_anti").select("dag_id", "task_id", "unknown").distinct()


def roots(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks with nothing upstream."""
    below = edges.select("dag_id", F.col("downstream").alias("task_id"))
    return tasks.join(below, ["dag_id", "task_id"], "left_anti")


def adjacency(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted parent list per task, empty for roots: ``(dag_id, task_id, chunk, upstream)``."""
    parents = nest(
        edges.select("dag_id", F.col("downstream").alias("task_id"), "upstream").distinct(),
        ["dag_id", "task_id"],
        [F.col("upstream")],
        F.col("upstream"),
        "parents",
    )
    empty = F.array().cast(parents.schema["parents"].dataType)
    return tasks.select("dag_id", "task_id").join(parents, ["dag_id", "task_id"], "left").select(
        "dag_id",
        "task_id",
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        F.coalesce("parents", empty).alias("upstream"),
    )


def ancestors(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """All transitive parents: ``(dag_id, task_id, ancestor)``.

    Without ``of`` every task is answered. Round k adds the pairs that are more than 2^k and at most
    2^(k+1) edges apart: a shortest path that long begins with one of exactly 2^k edges, so only those pairs
    are joined with what is known. A pair is written once, when it is found, and a DAG of depth d takes about
    log2(d) rounds. With ``of(dag_id, task_id)`` only those tasks are followed, one edge per round. Both stop on cycles.
    """
    if of is not None:
        return _follow(edges, of)
    spark = edges.sparkSession
    base = new_dir(spark, "reach")
    pairs = edges.select("dag_id", F.col("downstream").alias("task_id"), F.col("upstream").alias("ancestor")).distinct()
    fresh = pairs.withColumn("apart", F.lit(1).cast("bigint"))
    schema = fresh.schema
    for k in count():
        _, n = stage(fresh, path=f"{base}/round={k}")
        known = spark.read.schema(schema).parquet(base)
        if n == 0:
            return known.select("dag_id", "task_id", "ancestor")
        far = known.filter(F.col("apart") == 1 << k).select("dag_id", "task_id", F.col("ancestor").alias("_at"))
        step = known.select("dag_id", F.col("task_id").alias("_at"), "ancestor", "apart")
        fresh = (
            far.join(step, ["dag_id", "_at"])
            .groupBy("dag_id", "task_id", "ancestor")
            .agg((F.min("apart") + (1 << k)).alias("apart"))
            .join(known.drop("apart"), ["dag_id", "task_id", "ancestor"], "left_anti")
            .select(*schema.names)
        )


def _follow(edges: DataFrame, of: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    base = new_dir(spark, "follow")
    up = edges.select("dag_id", F.col("downstream").alias("_at"), F.col("upstream").alias("ancestor"))
    start = of.select("dag_id", "task_id").distinct().withColumn("_at", F.col("task_id"))
    step = start.join(up, ["dag_id", "_at"]).select("dag_id", "task_id", "ancestor").distinct()
    schema = step.schema
    for i in count():
        _, n = stage(step, path=f"{base}/round={i}")
        known = spark.read.schema(schema).parquet(base)
        if n == 0:
            return known.select("dag_id", "task_id", "ancestor")
        last = spark.read.schema(schema).parquet(f"{base}/round={i}")
        step = (
            last.withColumnRenamed("ancestor", "_at")
            .join(up, ["dag_id", "_at"])
            .select("dag_id", "task_id", "ancestor")
            .distinct()
            .join(known.select("dag_id", "task_id", "ancestor"), ["dag_id", "task_id", "ancestor"], "left_anti")
        )


def topo_order(tasks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drain the graphs level by level; returns ``(order, stuck)``.

    ``order(dag_id, task_id, level, position)``: level is the longest path from a
    root; inside a level tasks come in the order of their last-placed parent, then
    by id, which is the order of a first-in-first-out drain with sorted children.
    ``stuck(dag_id, task_id)`` is what never drains: cycle members and all below.
    """
    spark = edges.sparkSession
    e = edges.select("dag_id", "upstream", "downstream").distinct()
    need = e.groupBy("dag_id", "downstream").agg(F.count(F.lit(1)).alias("need"))
    links, _ = stage(e.join(need, ["dag_id", "downstream"]), "links")

    base = new_dir(spark, "topo")
    zero = F.lit(0).cast("bigint")
    arrived = roots(tasks.select("dag_id", "task_id").distinct(), links).select(
        "dag_id", "task_id", zero.alias("seen"), zero.alias("need"), zero.alias("last")
    )
    for level in count():  # every level drains a task, so this ends
        # One job per level: who is complete now, and their rank inside the level.
        flagged = arrived.withColumn("done", F.col("seen") == F.col("need"))
        ranked = rank_rows(flagged, ["dag_id", "done"], [F.col("last"), F.col("task_id")], "rank")
        here, seen = stage_counted(ranked, {"done": F.count_if("done")}, path=f"{base}/level={level}")
        if seen["done"] == 0:
            break
        hit = (
            here.filter("done")
            .select("dag_id", F.col("task_id").alias("upstream"), F.col("rank").alias("last"))
            .join(links, ["dag_id", "upstream"])
            .select("dag_id", F.col("downstream").alias("task_id"), F.lit(1).cast("bigint").alias("seen"), "need", "last")
        )
        waiting = here.filter("NOT done").select("dag_id", "task_id", "seen", "need", zero.alias("last"))
        arrived = (
            hit.unionByName(waiting)
            .groupBy("dag_id", "task_id")
            .agg(F.sum("seen").alias("seen"), F.max("need").alias("need"), F.max("last").alias("last"))
        )

    schema = T.StructType([*here.schema.fields, T.StructField("level", T.IntegerType())])
    drained = spark.read.schema(schema).parquet(base).filter("done").select("dag_id", "task_id", "level", "rank")
    before = Window.partitionBy("dag_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        drained.groupBy("dag_id", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("dag_id", "level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    order = drained.join(offsets, ["dag_id", "level"]).select(
        "dag_id", "task_id", "level", (F.col("_before") + F.col("rank")).alias("position")
    )
    stuck = tasks.select("dag_id", "task_id").distinct().join(drained, ["dag_id", "task_id"], "left_anti")
    return order, stuck


def spread_failure(states: DataFrame, edges: DataFrame, now: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Pending tasks below a failed one become ``upstream_failed``, naming it.

    ``states(run_id, dag_id, task_id, state, finished_at, ...)`` comes back whole
    with an ``error`` column, and with ``now`` as the end of the tasks that were hit.
    The first failure by (finished_at, task_id) is named. Who lies below whom comes from ``index``, the
    ``ancestors`` of the DAGs (worked out here if not given), which all runs of a DAG share: the blame of
    all runs is one join and one fold, whatever the depth.
    """
    below = ancestors(edges) if index is None else index
    key = ["run_id", "dag_id", "task_id"]
    failed = states.filter(F.col("state") == fixed.FAILED).select(
        "run_id", "dag_id", F.col("task_id").alias("ancestor"), F.struct("finished_at", F.col("task_id").alias("seed")).alias("_first")
    )
    blame = failed.join(below, ["dag_id", "ancestor"]).groupBy(*key).agg(F.min("_first")["seed"].alias("blamed"))
    out = states if "error" in states.columns else states.withColumn("error", F.lit(None).cast("string"))
    hit = (F.col("state") == fixed.PENDING) & F.col("blamed").isNotNull()
    ended = F.col("finished_at") if now is None else F.when(hit, now).otherwise(F.col("finished_at"))
    return (
        out.join(blame, key, "left")
        .withColumn("error", F.when(hit, F.format_string(fixed.UPSTREAM, "blamed")).otherwise(F.col("error")))
        .withColumn("finished_at", ended)
        .withColumn("state", F.when(hit, fixed.UPSTREAM_FAILED).otherwise(F.col("state")))
        .select(*out.columns)
    )


def validate(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that is wrong with the DAGs: ``(dag_id, problem, task_id, detail)``, no row where all is well.

    ``duplicate``: a task that is listed more than once; ``unknown``: a task with an edge from or to one that is not
    listed (``detail``); ``cycle``: a task on a cycle, i.e. above itself; ``stuck``: one that never runs since a cycle or an unknown
    task is above it. Ends of edges that name no task count as given for the order, so that each fault is told once.
    """
    keys = ["dag_id", "task_id"]
    text = lambda c: F.col(c).cast("string")
    row = lambda problem, detail: ["dag_id", F.lit(problem).alias("problem"), text("task_id").alias("task_id"), detail.cast("string").alias("detail")]
    none = F.lit(None)
    twice = tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*row("duplicate", F.col("n")))
    unknown = unknown_refs(edges, tasks).select(*row("unknown", F.col("unknown")))
    reach = ancestors(edges)
    circling = reach.filter(F.col("task_id") == F.col("ancestor")).select(*keys)
    cycle = circling.select(*row("cycle", none))
    listed = tasks.select("dag_id", F.col("task_id").alias("ancestor")).distinct()
    lost = reach.join(listed, ["dag_id", "ancestor"], "left_anti").select(*keys)
    below = reach.join(circling.select("dag_id", F.col("task_id").alias("ancestor")), ["dag_id", "ancestor"]).select(*keys)
    stuck = lost.unionByName(below).distinct().join(circling, keys, "left_anti").join(tasks.select(*keys).distinct(), keys, "left_semi")
    return reduce(DataFrame.unionByName, [twice, unknown, cycle, stuck.select(*row("stuck", none))])
