"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into lists, each a table of its own that knows part of every score.

1. Every block of a list gives its k best partial scores per query. The parts of these few that the other lists hold are
   looked up there; the k-th best whole score of them bounds each query's k-th best score from below.
2. That cut-off is sent to the lists, spread evenly below their best values. By the pigeonhole
   principle a vector that reaches it has a partial score at or over some list's share, so the entries over it suffice.
3. The missing parts of these entries are looked up in the other lists, and the whole scores are ranked. (With uniform shares
   an entry over its own always could reach the cut-off, so there is nothing to drop before.)

Queries come in blocks, one after the other: a block is small enough to be sent to every task, vectors stay where they lie,
and the entries of one block of queries are all that is on disk at once. All lists cut the vectors into the same blocks, so
entries travel packed, to the blocks that hold their other parts. The work is that of all pairs of query and vector.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import drop_dir, new_dir, shuffles_dropped, stage, stage_counted

K = 10
LISTS = 2
SCALE = 1024
ROW_BLOCK, QUERY_BLOCK = 4096, 1024
ROUND_PAIRS, ROUND_BYTES = 1 << 28, 8 << 20  # pairs of query and vector in a block of queries, and its bytes; 64 queries at least
ENTRIES = 1 << 18  # in a row of packed entries


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as ``floor(scale * x)``; vectors with null or non-finite components are left out.

    Rows that share a vec_id count once (the smallest vector).
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = vectors.where("vec_id IS NOT NULL").where(fine)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _slice(v: str, lists: int, j: int):
    return F.filter(v, lambda _, i: i % lists == j)


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each block of a list in a partition as one row, its vectors by vec_id; shorter ones are padded with zeros."""
    numbers, ids, rows = [], [], []
    for batch in batches:
        numbers += batch.column("block").to_pylist()
        ids += batch.column("vec_id").to_pylist()
        rows += batch.column("v").to_pylist()
    numbers, ids = np.array(numbers, np.int32), np.array(ids, np.int64)
    for block in np.unique(numbers).tolist():
        at = np.flatnonzero(numbers == block)
        at = at[np.argsort(ids[at])]
        matrix = np.zeros((len(at), width), np.int64)
        for line, i in zip(matrix, at.tolist()):
            line[: len(rows[i])] = rows[i]
        columns = [pa.array([block], pa.int32()), pa.array([ids[at]], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())]
        yield pa.record_batch(columns, names=["block", "ids", "matrix"])


def _partial(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact, else modulo 2^64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if top < 2**53 else q @ x.T


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Each pair of blocks of one list: its row, query ids, vector ids, the partial scores and who is whose own."""
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, ids = np.array(row["q_ids"], np.int64), np.array(row["ids"], np.int64)
            q = np.frombuffer(row["q_matrix"], np.int64).reshape(len(q_ids), -1)
            x = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), -1)
            yield row, q_ids, ids, _partial(q, x), q_ids[:, None] == ids


_FIRST = "query_id long, list int, vec_id long, part long, low long"


def _local_lists(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k best partial scores of each query in a block of a list, and the block's least."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for row, q_ids, ids, part, own in _blocks(batches):
        low = np.where(own, most, part).min(axis=1)
        masked = np.where(own, least, part)
        n = min(k, len(ids))
        best = np.argpartition(-masked, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(q_ids), 1))
        at = np.repeat(np.arange(len(q_ids)), n)
        best = best.ravel()
        keep = ~own[at, best]
        at, best = at[keep], best[keep]
        m = len(at)
        columns = [q_ids[at], np.full(m, row["list"], np.int32), ids[best], part[at, best], low[at]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "list", "vec_id", "part", "low"])


_ENTRIES = "list int, block int, ids binary, q binary, v binary, part binary"


def _entries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Phase 2: the entries of a block of a list that are at or over the query's cut-off for that list, packed by place in their blocks."""
    for row, q_ids, ids, part, own in _blocks(batches):
        known = {t["query_id"]: t["cut"] for t in row["thresholds"]}
        at = np.flatnonzero([i in known for i in q_ids.tolist()])
        cuts = np.array([known[i] for i in q_ids[at].tolist()], np.int64)
        q, v = np.nonzero((part[at] >= cuts[:, None]) & ~own[at])
        for i in range(0, len(q), most):
            some, there = at[q[i : i + most]], v[i : i + most]
            packed = [ids, some.astype(np.int32), there.astype(np.int32), part[some, there]]
            columns = [pa.array([row["list"]], pa.int32()), pa.array([row["block"]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]]
            yield pa.record_batch(columns, names=["list", "block", "ids", "q", "v", "part"])


_SCORE = "query_id long, vec_id long, score long"


def _wholes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 3: packed entries with the parts that the other lists hold of them; the k best whole scores of each query among these."""
    for batch in batches:
        for row in batch.to_pylist():
            q, v = np.frombuffer(row["q"], np.int32), np.frombuffer(row["v"], np.int32)
            score = np.frombuffer(row["part"], np.int64).copy()
            q_ids, ids = np.array(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            asked = {x["list"]: np.frombuffer(x["q_matrix"], np.int64).reshape(len(q_ids), -1) for x in row["asked"]}
            for x in row["others"] or []:
                mine, theirs = asked[x["list"]], np.frombuffer(x["matrix"], np.int64).reshape(len(ids), -1)
                for i in range(0, len(q), ROW_BLOCK):
                    some = slice(i, i + ROW_BLOCK)
                    score[some] += np.einsum("ij,ij->i", mine[q[some]], theirs[v[some]])
            order = np.lexsort((ids[v], ~score, q))  # ~ turns the order round without overflow
            q, v, score = q[order], v[order], score[order]
            new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            best = place < k
            yield pa.record_batch([pa.array(c) for c in (q_ids[q[best]], ids[v[best]], score[best])], names=["query_id", "vec_id", "score"])


def _looked_up(known: DataFrame, slices: DataFrame, lists: int) -> DataFrame:
    """``known`` (query_id, list, vec_id, part) and the parts of the same pairs that other lists hold, fetched from there by a join."""
    pairs = known.groupBy("query_id", "vec_id").agg(F.collect_set("list").alias("_has"))
    every = F.array(*[F.lit(j) for j in range(lists)])
    missing = pairs.select("query_id", "vec_id", F.explode(F.array_except(every, "_has")).alias("list"))
    theirs = slices.select("list", "vec_id", F.col("v").alias("_x"))
    mine = slices.select("list", F.col("vec_id").alias("query_id"), F.col("v").alias("_q"))
    product = F.aggregate(F.zip_with("_q", "_x", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    fetched = missing.join(theirs, ["list", "vec_id"]).join(mine, ["list", "query_id"])
    return known.unionByName(fetched.select("query_id", "list", "vec_id", product.alias("part")))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS) -> DataFrame:
    """``vectors``: (vec_id, v) of integers; ``queries``: one column of vec_ids among them.

    Per query its k highest inner products with other vectors (all, if fewer): query_id,
    rank, vec_id, score; ties go to the smaller vec_id. Vectors of other lengths count as
    padded with zeros.
    """
    rows, n = stage(vectors.select("vec_id", "v"), "vectors")
    wanted = queries.select(F.col(queries.columns[0]).alias("vec_id")).distinct()
    width = max(1, rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    cut_up = rows.select("vec_id", F.posexplode(F.array(*[_slice("v", lists, j) for j in range(lists)])).alias("list", "v"))
    slices = stage_counted(cut_up, {"rows": F.count(F.lit(1))}, "slices", partition_by=["list"])[0]  # a table per list
    asked, n_asked = stage(slices.join(wanted, "vec_id"), "queries")
    at_once = max(64, min(ROUND_PAIRS // max(1, n), ROUND_BYTES // (8 * width)))
    n_rows, n_rounds = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_asked // lists // min(QUERY_BLOCK, at_once)))

    def blocks(of: DataFrame, parts: int, label: str) -> DataFrame:
        kind = "block int, ids array<long>, matrix binary"
        packed = [
            of.where(F.col("list") == j).select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("block"), "vec_id", "v").repartition(parts, "block")
            .mapInArrow(functools.partial(_pack, width=len(range(j, width, lists))), kind).withColumn("list", F.lit(j))
            for j in range(lists)
        ]
        return stage(functools.reduce(DataFrame.unionAll, packed), label)[0]

    spark = vectors.sparkSession
    with shuffles_dropped(spark):
        mine, theirs = blocks(slices, n_rows, "rows"), blocks(asked, n_rounds, "asked")
        out = new_dir(spark, "topk")
        for i in range(n_rounds):
            some = theirs.where(F.col("block") == i).select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
            held: list[str] = []
            _round(mine, some, slices, k, lists, held).write.mode("append").parquet(out)
            for path in held:
                drop_dir(spark, path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def _round(mine: DataFrame, theirs: DataFrame, slices: DataFrame, k: int, lists: int, held: list[str]) -> DataFrame:
    """The three phases for one block of queries; ``held`` gets the folders that may go once the result is written."""

    def put(df: DataFrame, label: str) -> DataFrame:
        held.append(new_dir(df.sparkSession, label))
        return stage(df, label, held[-1])[0]

    first = put(mine.join(F.broadcast(theirs), "list").mapInArrow(functools.partial(_local_lists, k=k), _FIRST), "first")
    of_list = put(first.groupBy("query_id", "list").agg(F.max("part").alias("best"), F.min("low").alias("low")), "lists")
    ranked = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id")
    tops = first.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k).select("query_id", "list", "vec_id", "part")
    wholes = _looked_up(put(tops, "tops"), slices, lists).groupBy("query_id", "vec_id").agg(F.sum("part").alias("whole"))
    place = Window.partitionBy("query_id").orderBy(F.desc("whole"), "vec_id")
    reached = wholes.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).where(F.col("_r") == k).select("query_id", F.col("whole").alias("reached"))
    bases = of_list.groupBy("query_id").agg(F.sum("best").alias("top"))
    spread = F.col("best") + F.floor((F.col("reached") - F.col("top")) / lists)
    cuts = of_list.join(bases, "query_id").join(reached, "query_id", "left").withColumn("cut", F.coalesce(spread, F.col("low")))
    sent = put(cuts.groupBy("list").agg(F.collect_list(F.struct("query_id", "cut")).alias("thresholds")), "cuts")
    found = mine.join(F.broadcast(theirs.join(sent, "list")), "list").mapInArrow(functools.partial(_entries, most=ENTRIES), _ENTRIES)
    every = F.array(*[F.lit(j) for j in range(lists)])
    elsewhere = mine.select(F.explode(F.array_remove(every, F.col("list"))).alias("_of"), "block", F.struct("list", "matrix").alias("_part"))
    others = elsewhere.groupBy(F.col("_of").alias("list"), "block").agg(F.collect_list("_part").alias("others"))
    whole_queries = theirs.agg(F.first("q_ids").alias("q_ids"), F.collect_list(F.struct("list", "q_matrix")).alias("asked"))
    fetched = put(found, "entries").join(others, ["list", "block"], "left").crossJoin(F.broadcast(whole_queries))
    scored = fetched.mapInArrow(functools.partial(_wholes, k=k), _SCORE).distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
