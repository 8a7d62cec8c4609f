"""Resharding by minimum-cost flow: from the files of a table to shards of given capacities, moving the fewest bytes.

The files of a Parquet table, in path order, are its old shards. Block transfers are runs of
rows of a file. One narrow pass measures every row; sums by file and by thousand rows place every
cut. The flow itself is between shards only: an old shard sends what the flow says to each new
one, and staying costs nothing. Since a file's rows keep their order, the whole plan is a short list of runs per
file, each with its shard and first slot: a row finds its place without a sort or a shuffle, and only
files that lose or gain rows are written anew; the others stay as they are.

Rows too large to balance with (over ``1 / LARGE`` of a capacity, so at most ``LARGE`` per shard) are
placed singly before the flow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import new_dir, stage

SHARDS = 40
ROW_COST = 16
LARGE = 256
OLD_SHARDS = 64
"""Old shards at most; a table of more files has several neighbouring ones in each."""
RUN = 1024
"""Rows of a file that are summed together before a cut is sought among them."""


# -- the flow, between shards only


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """How much each old shard sends to each new one, at least total cost; all supply must fit.

    Successive shortest paths over reduced costs. ``cost``: a non-negative number per unit, old by new.
    """
    left, room = np.array(supply, dtype=object), np.array(capacity, dtype=object)
    if left.sum() > room.sum():
        raise ValueError(f"{left.sum()} do not fit into {room.sum()}")
    n, m = len(left), len(room)
    flow = np.zeros((n, m), dtype=object)
    up, down = np.zeros(n), np.zeros(m)  # potentials: cost + up - down is never negative, and 0 where there is flow
    while left.any():
        old, new = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        by_old, by_new = np.full(n, -1), np.full(m, -1)
        old_done, new_done = np.zeros(n, bool), np.zeros(m, bool)
        reduced = np.maximum(cost + up[:, None] - down[None], 0)
        while True:
            a, b = np.where(old_done, np.inf, old), np.where(new_done, np.inf, new)
            i, j = int(a.argmin()), int(b.argmin())
            if not np.isfinite(min(a[i], b[j])):
                break
            if a[i] <= b[j]:
                old_done[i] = True
                better = ~new_done & (old[i] + reduced[i] < new)
                new[better], by_new[better] = old[i] + reduced[i][better], i
            else:
                new_done[j] = True
                back = np.array([f > 0 for f in flow[:, j]]) & ~old_done & (new[j] < old)
                old[back], by_old[back] = new[j], j
        ends = np.where([r > 0 for r in room], new, np.inf)
        at = int(ends.argmin())
        best = ends[at]
        up += np.minimum(old, best)
        down += np.minimum(new, best)
        amount, steps, j = room[at], [], at
        while True:
            i = int(by_new[j])
            steps.append((i, j, 1))
            if by_old[i] < 0:
                amount = min(amount, left[i])
                break
            j = int(by_old[i])
            steps.append((i, j, -1))
            amount = min(amount, flow[i, j])
        for i, j, sign in steps:
            flow[i, j] += sign * amount
        left[steps[-1][0]] -= amount
        room[at] -= amount
    return flow


def level(filled: Sequence[int], total: int) -> list[int]:
    """What each shard takes of ``total`` so that the least filled end as equal as whole bytes allow."""
    n = len(filled)
    order = sorted(range(n), key=lambda j: (filled[j], j))
    out, reached = [0] * n, 0
    for k in range(1, n + 1):
        reached += filled[order[k - 1]]
        height = (total + reached) // k
        if k == n or height <= filled[order[k]]:
            break
    spare = total + reached - height * k
    for place, j in enumerate(order[:k]):
        out[j] = height - filled[j] + (place < spare)
    return out


def place_large(rows: Sequence[tuple[int, int]], n_new: int, goal: int) -> list[int]:
    """Shards of large rows ``(old shard, size)``: at home while there is room, else in the emptiest; then evened out."""
    filled, where = [0] * n_new, [0] * len(rows)
    heap = [(0, j) for j in range(n_new)]
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][1], k)):
        home, size = rows[k]
        if not (home < n_new and filled[home] + size <= goal):
            while heap[0][0] != filled[heap[0][1]]:  # an entry from before its shard grew
                heapq.heapreplace(heap, (filled[heap[0][1]], heap[0][1]))
            home = heap[0][1]
        where[k] = home
        filled[home] += size
    held: list[list[int]] = [[] for _ in range(n_new)]
    for k, j in enumerate(where):
        held[j].append(k)
    for _ in range(8 * len(rows)):
        full, empty = max(range(n_new), key=lambda j: filled[j]), min(range(n_new), key=lambda j: filled[j])
        gap = filled[full] - filled[empty]
        fits = [k for k in held[full] if rows[k][1] < gap]
        if filled[full] <= goal or not fits:
            break
        k = min(fits, key=lambda k: abs(2 * rows[k][1] - gap))
        held[full].remove(k)
        held[empty].append(k)
        where[k] = empty
        filled[full] -= rows[k][1]
        filled[empty] += rows[k][1]
    return where


# -- the plan


@dataclass(frozen=True)
class Plan:
    """Runs of rows per file, as parallel arrays by rising first row: a run ends where the next begins."""

    files: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    kept: list[str]

    def locate(self, file: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, shard, slot = self.files[file]
        at = np.searchsorted(first, rows, "right") - 1
        return shard[at], slot[at] + rows - first[at]


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_COST


def measure(docs: DataFrame) -> DataFrame:
    """(file, row, size) of every row of a table read from Parquet files: UTF-8 bytes of the text and ``ROW_COST``."""
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), _size().alias("size"))


def make_plan(docs: DataFrame, n_new: int = SHARDS, capacities: Sequence[int] | None = None) -> Plan:
    """Where each row of ``docs`` goes, so that the new shards are filled evenly (or up to ``capacities``).

    The driver holds numbers per file and per cut, and at most ``LARGE`` large rows per shard.
    """
    ledger, n_rows = stage(measure(docs), "ledger")
    if not n_rows:
        return Plan({}, [])
    per_file = sorted(tuple(r) for r in ledger.groupBy("file").agg(F.sum("size"), F.count(F.lit(1))).collect())
    total = sum(r[1] for r in per_file)
    if capacities is not None and sum(capacities) < total:
        raise ValueError(f"{total} bytes do not fit into {sum(capacities)}")
    names = [r[0] for r in per_file]
    n_old = min(len(names), OLD_SHARDS)
    old_of = {name: k * n_old // len(names) for k, name in enumerate(names)}
    goal = total // n_new
    large_from = goal // LARGE + 1
    large = sorted(tuple(r) for r in ledger.where(F.col("size") >= large_from).select("file", "row", "size").collect())  # LARGE per shard at most
    where = place_large([(old_of[f], s) for f, _, s in large], n_new, goal)
    filled = [0] * n_new
    for (_, _, s), j in zip(large, where):
        filled[j] += s
    small = [0] * n_old
    for name, size, _ in per_file:
        small[old_of[name]] += size
    for f, _, s in large:
        small[old_of[f]] -= s
    room = level(filled, sum(small)) if capacities is None else [max(0, c - f) for c, f in zip(capacities, filled)]
    if sum(room) < sum(small):
        room = [r + s for r, s in zip(room, level([f - c for f, c in zip(filled, capacities)], sum(small) - sum(room)))]
    away = np.ones((n_old, n_new))
    for i in range(min(n_old, n_new)):
        away[i, i] = 0
    flow = min_cost_flow(small, room, away)
    cuts = _cuts(ledger, large_from, per_file, old_of, large, flow)
    return _runs(per_file, old_of, large, where, cuts, n_new)


def _cuts(ledger: DataFrame, large_from: int, per_file, old_of, large, flow) -> dict[str, list[tuple[int, int]]]:
    """For each file where small rows change their shard: (first row, shard), by row. Each file begins with one.

    An old shard's small rows go to its new shards in stretches, the one that stays first. A stretch ends at the
    row whose middle lies beyond its bytes.
    """
    large_bytes: dict[str, int] = {}
    for f, _, s in large:
        large_bytes[f] = large_bytes.get(f, 0) + s
    before = [0] * len(flow)
    wanted: list[tuple[str, int, int]] = []  # file, small bytes of the file before the cut, shard after it
    ends = []
    for i, sent in enumerate(flow):
        order = sorted((j for j in range(len(sent)) if sent[j] > 0), key=lambda j: (j != i, j))
        ends.append((order, np.cumsum([int(sent[j]) for j in order]).tolist()))
    for name, size, _ in per_file:
        i, own = old_of[name], size - large_bytes.get(name, 0)
        order, bounds = ends[i]
        for k, j in enumerate(order):
            start = bounds[k - 1] if k else 0
            if start <= before[i] < bounds[k] or before[i] < start < before[i] + own:
                wanted.append((name, max(0, start - before[i]), j))
        if not order or (own == 0 and not any(w[0] == name for w in wanted)):
            wanted.append((name, 0, order[-1] if order else min(i, len(flow[0]) - 1)))
        before[i] += own
    found: dict[str, list[tuple[int, int]]] = {}
    inside = [w for w in wanted if w[1] > 0]
    for name, _, j in (w for w in wanted if w[1] == 0):
        found.setdefault(name, []).append((0, j))
    if inside:
        for name, row, j in _first_rows(ledger, large_from, inside):
            found.setdefault(name, []).append((row, j))
    return {name: sorted(cuts, key=lambda c: c[0]) for name, cuts in found.items()}


def _first_rows(ledger: DataFrame, large_from: int, cuts: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The rows at which small bytes of a file pass given amounts. At most a run of rows per cut reaches the driver."""
    spark = ledger.sparkSession
    files = [c[0] for c in cuts]
    small = F.when(F.col("size") < large_from, F.col("size")).otherwise(0)
    runs = ledger.where(F.col("file").isin(sorted(set(files)))).groupBy("file", F.floor(F.col("row") / RUN).alias("run")).agg(F.sum(small).alias("bytes"))

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        """The runs of one file (a thousandth of its rows) that hold its cuts, with the bytes before them."""
        rows = rows.sort_values("run", ignore_index=True)
        name, ends = rows["file"][0], rows["bytes"].to_numpy().cumsum()
        at = sorted({min(int(np.searchsorted(ends, c, "right")), len(rows) - 1) for f, c, _ in cuts if f == name})
        return pd.DataFrame({"at_file": name, "at_run": rows["run"][at].to_numpy(), "before": [int(ends[k] - rows["bytes"][k]) for k in at]})

    places = stage(runs.groupBy("file").applyInPandas(chosen, "at_file string, at_run long, before long"), "cut_runs")[0]
    near = ledger.join(F.broadcast(places), (F.col("file") == F.col("at_file")) & (F.floor(F.col("row") / RUN) == F.col("at_run")))
    held: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in near.select("file", "before", "row", small.alias("small")).collect():
        held.setdefault((r["file"], r["before"]), []).append((r["row"], r["small"]))
    for (name, before), rows in held.items():
        rows.sort()
        bytes_ = np.array([s for _, s in rows], np.int64)
        starts = before + np.cumsum(bytes_) - bytes_
        for f, c, j in cuts:
            if f == name and before <= c and (c < starts[-1] + bytes_[-1] or not _later(held, name, before)):
                at = int(np.searchsorted(starts + bytes_ // 2, c))
                yield name, rows[at][0] if at < len(rows) else rows[-1][0] + 1, j


def _later(held: dict, name: str, before: int) -> bool:
    return any(f == name and b > before for f, b in held)


def _runs(per_file, old_of, large, where, cuts, n_new: int) -> Plan:
    """The runs of every file with their shards and first slots, in path order."""
    singles: dict[str, list[tuple[int, int]]] = {}
    for (f, row, _), j in zip(large, where):
        singles.setdefault(f, []).append((row, j))
    next_slot, files, kept = [0] * n_new, {}, []
    for name, _, n in per_file:
        marks = [(row, j) for row, j in cuts[name] if row < n]
        stretch: dict[int, int] = {}
        for row, j in marks:  # of cuts at one row the last holds
            stretch[row] = j
        own = dict(singles.get(name, []))
        # a single row interrupts its stretch, which goes on after it
        starts = sorted({*stretch, *own, *(r + 1 for r in own if r + 1 < n)})
        first, shard, current = [], [], None
        for row in starts:
            current = stretch.get(row, current)
            now = own.get(row, current)
            if not shard or now != shard[-1]:
                first.append(row)
                shard.append(now)
        slots = []
        for k, row in enumerate(first):
            end = first[k + 1] if k + 1 < len(first) else n
            slots.append(next_slot[shard[k]])
            next_slot[shard[k]] += end - row
        files[name] = (np.array(first, np.int64), np.array(shard, np.int32), np.array(slots, np.int64))
        if len(shard) == 1 and shard[0] == old_of[name]:
            kept.append(name)
    return Plan(files, kept)


# -- the rewriting


def placed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` (read from Parquet files) with ``_shard`` and ``_slot``. Only row numbers go to Python; texts stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def locate(file: pa.Array, row: pa.Array) -> pa.Array:
        numbers = row.to_numpy(zero_copy_only=False)
        shard, slot = np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
        for name in file.unique().to_pylist():
            mine = np.asarray(pa.compute.equal(file, name))
            shard[mine], slot[mine] = shared.value.locate(name, numbers[mine])
        return pa.StructArray.from_arrays([pa.array(shard), pa.array(slot)], names=["shard", "slot"])

    where = F.arrow_udf(locate, "shard int, slot long")(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return docs.select("*", where.alias("_place")).select(*docs.columns, F.col("_place.shard").alias("_shard"), F.col("_place.slot").alias("_slot"))


def rewrite(docs: DataFrame, plan: Plan, path: str) -> DataFrame:
    """Writes the affected files' rows below ``path`` by shard; the new table: rewritten and untouched files together.

    A task's rows are neighbours, so it writes to few shards and nothing is shuffled.
    """
    spark, kept = docs.sparkSession, plan.kept
    affected = docs.where(~F.col("_metadata.file_path").isin(kept)) if kept else docs
    placed(affected, plan).write.partitionBy("_shard").parquet(path)
    written = spark.read.schema(docs.select("*", F.lit(0).cast("long").alias("_slot"), F.lit(0).alias("_shard")).schema).parquet(path)
    if not kept:
        return written
    return written.unionByName(placed(docs.where(F.col("_metadata.file_path").isin(kept)), plan))


def reshard(docs: DataFrame, n_new: int = SHARDS, capacities: Sequence[int] | None = None, path: str | None = None) -> DataFrame:
    """The table in its new shards: all columns, ``_shard`` (0 to ``n_new`` - 1) and ``_slot`` (gapless from 0 in a shard).

    ``docs``: a table read from Parquet files. Rows are told apart by file and number, so repeated rows, null ids
    and null texts (no bytes) are rows like others. An empty table gives no rows.
    """
    plan = make_plan(docs, n_new, capacities)
    return rewrite(docs, plan, path or new_dir(docs.sparkSession, "shards"))


def digests(new: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of a resharded table."""
    return new.select(
        F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
