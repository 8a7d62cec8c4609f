"""Ranking and list building per key that stay whole when one key is hot.

A window or ``collect_list`` puts a whole key into one task.  Here rows are counted
per group of keys first.  Groups that fit into a task go through the plain window, one
shuffle; the rows of crowded groups are cut into range slices by (key, order) of a fixed
number of rows, ranked slice by slice and shifted by the rows before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.session import shuffles_dropped, stage

SMALL_INPUT_BYTES = 256 << 20  # below this one task can sort the whole input
SLICE_BYTES = 64 << 20  # an input that reads no more is one slice
SLICE_ROWS = 1_000_000  # rows of a slice, about
KEY_GROUPS = 1 << 14  # groups of keys that are counted to find the crowded ones
LIST_CHUNK = 10_000  # longest list put into one row


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables the plan reads, by Catalyst's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return input_bytes(df) <= (SMALL_INPUT_BYTES if limit is None else limit)


def spread(df: DataFrame, *keys: str, small: int | None = None) -> DataFrame:
    """Rows of a small input dealt over all cores (by ``keys`` if given) before heavy work.

    A small file is one split and would keep one core busy; a large table has
    splits enough and is left alone, so that it is combined before it is shuffled.
    """
    if not is_small(df, small):
        return df
    return df.repartition(*keys) if keys else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def gather(df: DataFrame, per_task: int = 4 << 20) -> DataFrame:
    """Few bytes in few tasks, for fits that run a job per step; large tables stay as they are."""
    tasks = max(1, -(-input_bytes(df) // per_task))
    return df.coalesce(tasks) if tasks < df.sparkSession.sparkContext.defaultParallelism else df


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, slice_rows: int | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as bigint ``name``.

    No task ranks more than about ``slice_rows`` rows of a key, whatever share of them
    it has.  An input that is more than a scan is worked out once (staged).  Rows with
    equal keys and order may lie in several slices: a hash of the row breaks such ties.
    """
    keys = list(keys)
    plain = Window.partitionBy(*keys).orderBy(*order)
    if slice_rows is None and is_small(df, SLICE_BYTES):
        return df.withColumn(name, F.row_number().over(plain).cast("bigint"))
    if not is_scan(df):
        with shuffles_dropped(df.sparkSession):
            df = stage(df, "unranked")[0]
    limit = slice_rows or SLICE_ROWS
    group = F.pmod(key_hash(keys), F.lit(KEY_GROUPS)) if keys else F.lit(0)
    n, crowded = _crowded(df, group, limit)
    parts = max(1, -(-n // limit))
    if parts == 1:
        return df.withColumn(name, F.row_number().over(plain).cast("bigint"))
    there = group.isin([g for g, _ in crowded])
    rest = df.where(~there) if crowded else df
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) and keys:
        rest = rest.repartition(parts, *keys)
    ranked = rest.withColumn(name, F.row_number().over(plain).cast("bigint"))
    if not crowded:
        return ranked
    sliced = _rank_sliced(df.where(there), keys, order, name, max(1, -(-sum(m for _, m in crowded) // limit)))
    return ranked.unionByName(sliced) if keys else sliced


def is_scan(df: DataFrame) -> bool:
    """Does the plan only read a table, row by row?  Then reading twice is cheaper than a copy."""
    return row_by_row(df._jdf.queryExecution().optimizedPlan())


def row_by_row(plan) -> bool:
    """``is_scan`` of a logical plan."""
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    return plan.children().isEmpty() and plan.nodeName() in ("LogicalRelation", "LocalRelation")


def _crowded(df: DataFrame, group: Column, limit: int) -> tuple[int, list[tuple[int, int]]]:
    """How many rows there are, and the groups that have more than ``limit`` of them, with their rows."""
    counts = df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_rows"))
    over = F.when(F.col("_rows") > limit, F.struct("_g", "_rows"))
    found = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"), F.collect_list(over).alias("over")).first()
    return found["n"], [(r["_g"], r["_rows"]) for r in found["over"]]


def _rank_sliced(df: DataFrame, keys: list[str], order: Sequence[Column], name: str, parts: int) -> DataFrame:
    tie = F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    sliced, _ = stage(
        df.withColumn("_tie", tie)
        .repartitionByRange(parts, *[F.col(k) for k in keys], *order, F.col("_tie"))
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order, F.col("_tie"))
    ranked = sliced.withColumn("_rn", F.row_number().over(local)).alias("r")
    o = offsets.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_before")
    cond = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"_k_{i}"))
    out = ranked.join(o, cond).withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
    return out.select(*[F.col(f"r.{c}") for c in df.columns], name)


def nest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    item: Column,
    name: str,
    chunk: int = LIST_CHUNK,
    slice_rows: int | None = None,
) -> DataFrame:
    """One ordered array per key, in rows of at most ``chunk`` entries.

    ``chunk`` 0 is the whole list for every key that fits; longer lists go on in
    chunk 1, 2, ... so no entry is dropped and no task holds an unbounded list.
    """
    kept = dict.fromkeys([*keys, *_sorted_by(df, order)])
    ranked = rank_rows(df.select(*kept, item.alias("_item")), keys, order, "_n", slice_rows)
    return (
        ranked.groupBy(*keys, F.expr(f"(_n - 1) div {chunk}").alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("_n", "_item"))).alias("_list"))
        .select(*keys, "chunk", F.transform("_list", lambda x: x["_item"]).alias(name))
    )


def _sorted_by(df: DataFrame, order: Sequence[Column]) -> list[str]:
    """The columns that ``order`` refers to."""
    sorts = df.sort(*order)._jdf.queryExecution().analyzed().order()
    used = [sorts.apply(i).references().toSeq() for i in range(sorts.size())]
    return [attributes.apply(i).name() for attributes in used for i in range(attributes.size())]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by ``order``; ``max_by`` folds map-side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with the new rows put in their place by key; new keys are added."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    return o.join(n, list(keys), "full_outer").select(
        *keys,
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
            for c in rest
        ],
    )
