"""Resharding: the flow is certified by its residual graph, the files by what is read back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from runloom.llm import resharding
from runloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def cheapest(flow, cost, room):
    """No cycle of the residual graph lowers the cost (a spare node takes what new shards have free)."""
    n, m = flow.shape
    far = np.full((n + m + 1, n + m + 1), np.inf)
    far[:n, n : n + m] = cost
    for i in range(n):
        for j in range(m):
            if flow[i, j] > 0:
                far[n + j, i] = -cost[i, j]
    for j in range(m):
        used = sum(flow[:, j])
        if used < room[j]:
            far[n + j, n + m] = 0
        if used > 0:
            far[n + m, n + j] = 0
    for k in range(len(far)):
        far = np.minimum(far, far[:, k, None] + far[None, k])
    return far.diagonal().min() > -1e-9


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_of_least_cost(seed):
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 7), rnd.randint(1, 7)
    supply = [rnd.choice([0, rnd.randint(1, 10**13)]) for _ in range(n)]
    room = resharding.level([rnd.choice([0, rnd.randint(1, 10**12)]) for _ in range(m)], sum(supply))
    room = [r + rnd.choice([0, 5]) for r in room]
    cost = np.array([[rnd.choice([0, 1, 1, 2, 7]) for _ in range(m)] for _ in range(n)], float)
    flow = resharding.min_cost_flow(supply, room, cost)
    assert [sum(r) for r in flow] == supply and all(sum(flow[:, j]) <= room[j] for j in range(m)) and (flow >= 0).all()
    assert cheapest(flow, cost, room)


def test_flow_refuses_what_does_not_fit():
    with pytest.raises(ValueError, match="do not fit"):
        resharding.min_cost_flow([3, 4], [5, 1], np.ones((2, 2)))


def test_level_fills_the_lowest_first():
    assert resharding.level([5, 0, 3], 5) == [0, 4, 1]
    assert resharding.level([100, 0, 0], 7) == [0, 4, 3]
    assert resharding.level([0], 9) == [9]
    assert sum(resharding.level([7, 7, 7, 9], 1001)) == 1001


def table(spark, folder, rows, files):
    """Documents in ``files`` files; extra columns have clashing names."""
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        df = spark.createDataFrame([(i, t, "f", 5, "s") for i, t in part], "doc_id long, text string, file string, row long, shard string")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def sizes(text):
    return resharding.ROW_COST + len((text or "").encode())


def shards(new):
    """Rows by shard, checked: slots without gaps; and the shard sizes."""
    rows = new.select("doc_id", "text", "_shard", "_slot").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["_shard"], []).append((r["_slot"], r["doc_id"], r["text"]))
    for of in found.values():
        assert sorted(s for s, _, _ in of) == list(range(len(of)))
    return rows, {j: sum(sizes(t) for _, _, t in of) for j, of in found.items()}


def texts(seed, n):
    rnd = random.Random(seed)
    return [(i, "é" * rnd.choice([1, 5, 20, 50]) + "x" * rnd.randint(0, 200)) for i in range(n)]


def test_query_keeps_the_law(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op13_resharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((r.doc_id, sizes(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    filled = [0] * 40
    slots: dict = {}
    for r in rows:
        filled[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert max(filled) - min(filled) <= max(r.size for r in rows) and max(filled) < 1.02 * min(filled)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


@pytest.mark.parametrize("files, n_new", [(1, 5), (4, 7), (9, 3), (5, 5)])
def test_moves_the_fewest_bytes(spark, folder, files, n_new):
    rows = texts(files, 6000)
    docs = table(spark, f"{folder}/t", rows, files)
    new = resharding.reshard(docs, n_new)
    assert new.columns == [*docs.columns, "_slot", "_shard"] or set(new.columns) == {*docs.columns, "_slot", "_shard"}
    found, filled = shards(new)
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows)
    mean = sum(filled.values()) / n_new
    assert len(filled) == n_new and max(abs(f - mean) for f in filled.values()) <= 600
    names = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    old = {r.doc_id: names.index(r.file_path) for r in docs.select("doc_id", "_metadata.file_path").collect()}
    home = [0] * files
    stayed = 0
    for r in found:
        home[old[r.doc_id]] += sizes(r.text)
        stayed += sizes(r.text) * (old[r.doc_id] == r["_shard"])
    most = sum(min(home[i], mean) for i in range(min(files, n_new)))
    assert stayed >= most - 600 * n_new


def test_files_that_fit_are_left_alone(spark, folder):
    docs = table(spark, f"{folder}/t", [(i, "x" * 100) for i in range(4000)], 4)
    plan = resharding.make_plan(docs, 4)
    assert len(plan.kept) == 4
    plan = resharding.make_plan(docs, 5, [116_000, 200_000, 100_000, 48_000, 0])
    assert len(plan.kept) == 2  # the second shard only gains, in new files
    found, filled = shards(resharding.rewrite(docs, plan, f"{folder}/new"))
    assert len(found) == 4000 and filled == pytest.approx({0: 116_000, 1: 200_000, 2: 100_000, 3: 48_000}, abs=116)
    assert spark.read.parquet(f"{folder}/new").where("_shard = 0").isEmpty()
    with pytest.raises(ValueError, match="do not fit"):
        resharding.make_plan(docs, 2, [10, 10])


def test_odd_rows(spark, folder):
    rows = [(None, "no id"), (1, None), (1, None), (2, ""), (3, "long " * 100_000), *[(7, "the same text, often")] * 900, *texts(3, 300)]
    docs = table(spark, f"{folder}/t", rows, 3)
    found, filled = shards(resharding.reshard(docs, 6))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in found], key=key) == sorted(rows, key=key)
    rest = sorted(filled.values())[:-1]  # one row is larger than all others together
    assert max(rest) - min(rest) <= 600


def test_fewer_rows_than_shards_and_none(spark, folder):
    found, filled = shards(resharding.reshard(table(spark, f"{folder}/a", [(1, "a"), (2, "b"), (3, None)], 1), 40))
    assert len(found) == 3 and len(filled) == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{folder}/b")
    assert resharding.reshard(spark.read.parquet(f"{folder}/b"), 40).collect() == []
