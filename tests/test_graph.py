"""Graph jobs on small shapes and against brute force on random graphs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import graph, keyed, state

EDGE = "dag_id string, upstream string, downstream string"
TASK = "dag_id string, task_id string"


def edges_of(spark, text, dag="d"):
    return spark.createDataFrame([(dag, *e.split(">")) for e in text.split()], EDGE)


def tasks_of(spark, names, dag="d"):
    return spark.createDataFrame([(dag, n) for n in names], TASK)


def order_of(spark, names, text):
    order, stuck = graph.topo_order(tasks_of(spark, names), edges_of(spark, text))
    return [r["task_id"] for r in order.orderBy("position").collect()], {r["task_id"] for r in stuck.collect()}


def check_order(rows, names, edges):
    """What an order must hold: all names once, in levels, and inside a level by last parent, then name."""
    place = {r["task_id"]: r["position"] for r in rows}
    level = {r["task_id"]: r["level"] for r in rows}
    assert sorted(place) == sorted(names) and sorted(place.values()) == list(range(1, len(names) + 1))
    parents = {n: [u for u, d in edges if d == n] for n in names}
    assert all(level[n] == max((level[p] + 1 for p in parents[n]), default=0) for n in names)
    by_rule = sorted(names, key=lambda n: (level[n], max((place[p] for p in parents[n]), default=0), n))
    assert by_rule == sorted(names, key=place.get)


def closure(names, edges):
    """Pairs (task, ancestor) by squaring the matrix of edges until it stands still."""
    at = {n: i for i, n in enumerate(sorted(names))}
    reach = np.zeros((len(at), len(at)), bool)
    for u, d in edges:
        reach[at[d], at[u]] = True
    while (grown := reach | (reach.astype(int) @ reach.astype(int) > 0)).sum() > reach.sum():
        reach = grown
    known = sorted(names)
    return {(known[i], known[j]) for i, j in zip(*np.nonzero(reach))}


def test_diamond_order(spark):
    assert order_of(spark, "abcd", "a>b a>c b>d c>d") == (["a", "b", "c", "d"], set())


def test_cycle_members_and_all_below_are_stuck(spark):
    assert order_of(spark, "abcde", "a>b b>c c>b c>d") == (["a", "e"], {"b", "c", "d"})


def test_nothing_drains_when_all_is_a_cycle(spark):
    assert order_of(spark, "ab", "a>b b>a") == ([], {"a", "b"})


def test_self_loop(spark):
    assert order_of(spark, "ab", "a>a") == (["b"], {"a"})


def random_graphs(seed, n_dags=12, hot=40):
    rng = random.Random(seed)
    found = {}
    for g in range(n_dags):
        names = [f"n{i:02d}" for i in range(hot if g == 0 else rng.randint(1, 12))]
        rng.shuffle(names)
        edges = {
            (names[i], names[j]) for j in range(len(names)) for i in range(j) if rng.random() < min(0.4, 4 / len(names))
        }
        found[f"g{g}"] = (names, edges)
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_order_and_ancestors_of_random_graphs(spark, seed):
    graphs = random_graphs(seed)
    tasks = spark.createDataFrame([(g, n) for g, (names, _) in graphs.items() for n in names], TASK).repartition(5)
    edges = spark.createDataFrame([(g, u, d) for g, (_, es) in graphs.items() for u, d in es], EDGE).repartition(5)
    order, stuck = graph.topo_order(tasks, edges)
    rows = order.orderBy("dag_id", "position").collect()
    for g, (names, es) in graphs.items():
        check_order([r for r in rows if r["dag_id"] == g], names, es)
    assert stuck.isEmpty()
    want = {(g, n, a) for g, (names, es) in graphs.items() for n, a in closure(names, es)}
    found = {tuple(r) for r in graph.ancestors(edges).select("dag_id", "task_id", "ancestor").collect()}
    assert found == want
    some = tasks.filter(F.col("task_id").isin("n00", "n05"))
    followed = {tuple(r) for r in graph.ancestors(edges, of=some).collect()}
    assert followed == {w for w in want if w[1] in ("n00", "n05")}


def test_order_of_a_hot_dag_by_slices(spark, monkeypatch):
    """No input is one slice, so the frequent DAG is ranked slice by slice."""
    monkeypatch.setattr(keyed, "SLICE_BYTES", 0)
    monkeypatch.setattr(keyed, "SLICE_ROWS", 20)
    graphs = random_graphs(7, n_dags=4, hot=30)
    tasks = spark.createDataFrame([(g, n) for g, (names, _) in graphs.items() for n in names], TASK)
    edges = spark.createDataFrame([(g, u, d) for g, (_, es) in graphs.items() for u, d in es], EDGE)
    order, stuck = graph.topo_order(tasks, edges)
    rows = order.orderBy("dag_id", "position").collect()
    for g, (names, es) in graphs.items():
        check_order([r for r in rows if r["dag_id"] == g], names, es)
    assert stuck.isEmpty()


def test_ancestors_stop_on_cycles(spark):
    e = edges_of(spark, "a>b b>c c>a c>d")
    want = {(n, a) for n in "abcd" for a in "abc"}
    assert {(r["task_id"], r["ancestor"]) for r in graph.ancestors(e).collect()} == want
    only = graph.ancestors(e, of=tasks_of(spark, "d"))
    assert {r["ancestor"] for r in only.collect()} == set("abc")


def test_ancestors_without_edges(spark):
    assert graph.ancestors(spark.createDataFrame([], EDGE)).isEmpty()
    assert graph.ancestors(spark.createDataFrame([], EDGE), of=tasks_of(spark, "a")).isEmpty()


def test_long_chain(spark):
    names = [f"n{i:03d}" for i in range(70)]
    text = " ".join(f"{a}>{b}" for a, b in zip(names, names[1:]))
    assert graph.ancestors(edges_of(spark, text)).count() == 70 * 69 // 2


@pytest.mark.parametrize(
    "chain,edges",
    [
        ("a >> b", {("a", "b")}),
        ("a >> [b, c] >> d", {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}),
        ("[a, b] >> c", {("a", "c"), ("b", "c")}),
        ("a", set()),
        ("[a] >> b", {("a", "b")}),
        ("a >> [] >> b", set()),
        ("a >> b >> a", {("a", "b"), ("b", "a")}),
    ],
)
def test_chains(spark, chain, edges):
    df = spark.createDataFrame([("d", chain)], "dag_id string, chain string")
    assert {(r["upstream"], r["downstream"]) for r in graph.expand_edges(df).collect()} == edges
    assert graph.refused_chains(df).isEmpty()


def test_list_after_list_is_refused_and_edges_are_a_set(spark):
    df = spark.createDataFrame([("d", "[a, b] >> [c, d]"), ("d", "a >> b"), ("d", "a>>b")], "dag_id string, chain string")
    assert graph.expand_edges(df).count() == 1
    assert graph.refused_chains(df).count() == 1
    assert {(r["upstream"], r["refused"]) for r in graph.expand_or_refuse(df).collect()} == {("a", None), (None, "[a, b] >> [c, d]")}


def test_unknown_refs_and_roots(spark):
    tasks, edges = tasks_of(spark, "ab"), edges_of(spark, "a>b a>zz")
    assert [tuple(r) for r in graph.unknown_refs(edges, tasks).collect()] == [("d", "a", "zz")]
    assert [r["task_id"] for r in graph.roots(tasks, edges).collect()] == ["a"]


def test_adjacency_has_empty_lists_for_roots(spark):
    rows = graph.adjacency(tasks_of(spark, "abc"), edges_of(spark, "b>c a>c a>c")).collect()
    assert {r["task_id"]: r["upstream"] for r in rows} == {"a": [], "b": [], "c": ["a", "b"]}


def test_failure_spreads_to_pending_descendants_only(spark):
    edges = edges_of(spark, "root>bad root>sibling bad>child child>grandchild bad>done done>late other>late")
    rows = [
        ("root", "success", 1), ("bad", "failed", 2), ("sibling", "success", 3), ("child", "pending", None),
        ("grandchild", "pending", None), ("done", "success", 4), ("late", "pending", None), ("other", "failed", 1),
    ]
    states = spark.createDataFrame(
        [("r", "d", *r) for r in rows], "run_id string, dag_id string, task_id string, state string, finished_at int"
    )
    got = {r["task_id"]: (r["state"], r["error"]) for r in graph.spread_failure(states, edges).collect()}
    assert got["child"] == ("upstream_failed", "upstream 'bad' failed")
    assert got["grandchild"] == ("upstream_failed", "upstream 'bad' failed")
    assert got["late"] == ("upstream_failed", "upstream 'other' failed")  # the earlier failure is named
    ended = {r["task_id"]: r["finished_at"] for r in graph.spread_failure(states, edges, F.lit(99)).collect()}
    assert ended["child"] == 99 and ended["late"] == 99 and ended["bad"] == 2 and ended["done"] == 4
    assert got["sibling"] == ("success", None) and got["done"] == ("success", None) and got["bad"] == ("failed", None)


def test_failure_spreads_round_a_cycle_and_stops(spark):
    edges = edges_of(spark, "bad>a a>b b>a")
    rows = [("r", "d", "bad", "failed", 5), ("r", "d", "a", "pending", None), ("r", "d", "b", "pending", None)]
    states = spark.createDataFrame(rows, "run_id string, dag_id string, task_id string, state string, finished_at int")
    got = {r["task_id"]: r["state"] for r in graph.spread_failure(states, edges).collect()}
    assert got == {"bad": "failed", "a": "upstream_failed", "b": "upstream_failed"}


def test_each_pair_is_written_once(spark):
    """A hub of 300 x 300 paths and a chain of 40: log2(depth) rounds, and no pair in more than one of them."""
    hub = [("h", f"u{i}", "hub") for i in range(300)] + [("h", "hub", f"d{i}") for i in range(300)]
    chain = [("c", f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    edges = spark.createDataFrame(hub + chain, EDGE)
    found = graph.ancestors(edges)
    assert found.count() == 600 + 300 * 300 + 41 * 40 // 2 == found.distinct().count()
    base = found.inputFiles()[0].split("/round=")[0]
    written = spark.read.parquet(base)
    assert written.count() == found.count()
    per = {r["round"]: r["n"] for r in written.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [r for r in sorted(per) if per[r]] == [0, 1, 2, 3, 4, 5, 6]  # 1, 2, 4, ... 32, 40 edges


def test_roots_without_a_row_are_ready(spark):
    edges = spark.createDataFrame([("d", "a", "b")], EDGE)
    tasks = spark.createDataFrame([(1, "d", t) for t in "abc"] + [(2, "d", "a")], "run_id int, dag_id string, task_id string")
    seen = spark.createDataFrame([(1, "d", "a", "success")], "run_id int, dag_id string, task_id string, state string")
    got = sorted((r["run_id"], r["task_id"]) for r in state.ready_tasks(seen, edges, tasks).collect())
    assert got == [(1, "b"), (1, "c"), (2, "a")]


def test_validate_tells_every_fault_once(spark):
    edges = edges_of(spark, "a>b b>c c>b c>d x>e e>f g>h")
    tasks = tasks_of(spark, ["a", "b", "c", "d", "e", "f", "g", "h", "h"])
    got = sorted((r["problem"], r["task_id"], r["detail"]) for r in graph.validate(tasks, edges).collect())
    assert got == sorted([
        ("duplicate", "h", "2"), ("unknown", "e", "x"), ("cycle", "b", None), ("cycle", "c", None), ("stuck", "d", None), ("stuck", "e", None), ("stuck", "f", None),
    ])
    assert graph.validate(tasks_of(spark, ["a", "b"]), edges_of(spark, "a>b")).isEmpty()
