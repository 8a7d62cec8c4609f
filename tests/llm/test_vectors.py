"""Vector operators, components and web records against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from runloom.llm import pq, topk, warc
from runloom.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, list string, id string"
NAN, INF = float("nan"), float("inf")
ODD = [(None, [1.0, 0.0]), (9001, None), (9002, []), (9003, [0.0, 0.0]), (9004, [NAN, 1.0]), (9005, [INF, 1.0]), (9006, [None, 1.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "l", "i") for i, v in rows], SCHEMA)


def clustered(n=600, dims=16, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // 12, dims))
    x = centres[rnd.integers(0, len(centres), n)] + rnd.normal(size=(n, dims)) * rnd.choice([0.02, 0.1, 0.25, 0.6], n)[:, None]
    x[n // 2 : n // 2 + 40] = x[3]  # exact copies
    return x.astype(np.float32)


def test_links_counts_and_components(spark):
    x = clustered()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = pq.near_duplicates(table(spark, rows + ODD)).collect()
    assert len(out) == len(rows) + len(ODD)
    got = {r.vec_id: r for r in out}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.97 * close.sum()
    i, j = np.nonzero(close)
    label = pq._roots(len(x), i, j)
    assert sum(got[k].component_id == label[k] for k in range(len(x))) >= 0.99 * len(x)
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    for k, _ in ODD:
        assert got[k].n_links == 0 and got[k].kept and got[k].component_id == k
    assert pq.near_duplicates(table(spark, ODD[:1])).count() == 1


def test_blocks_of_lists_lose_no_pair(spark, monkeypatch):
    """Lists cut in small blocks on both sides give the same links."""
    rows = table(spark, [(i, v.tolist()) for i, v in enumerate(clustered(300))])
    whole = sorted(pq.near_duplicates(rows).collect())
    monkeypatch.setattr(pq, "MEMBER_BLOCK", 7)
    monkeypatch.setattr(pq, "QUERY_BLOCK", 11)
    assert sorted(pq.near_duplicates(rows).collect()) == whole


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_topk_is_exact(spark, lists, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 97)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    x = clustered(400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD + [(9010, [0.5] * 16), (9010, [0.5] * 16), (9011, [3e6] * 16)]
    vectors = topk.integers(table(spark, rows))
    out = topk.search(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), k=10, lists=lists).collect()
    z = {i: np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows if i is not None and v and len(v) == 16}
    z[9002], z[9003] = np.zeros(16, np.int64), np.zeros(16, np.int64)
    want = []
    for q in sorted(z):
        if q % 20 == 0:
            scores = sorted((-int(z[q] @ v), i) for i, v in z.items() if i != q)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, out)) == sorted(want)


def test_topk_sends_queries_in_blocks(spark, monkeypatch):
    """No row of a task's join is a copied block of vectors, and what a block of queries needs on disk goes before the next."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ENTRIES", 7)
    x = clustered(300)
    vectors = topk.integers(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    rounds, gone = [], []
    real, drop = topk._round, topk.drop_dir
    monkeypatch.setattr(topk, "_round", lambda mine, theirs, *rest: rounds.append([len(r["q_ids"]) for r in theirs.collect()]) or real(mine, theirs, *rest))
    monkeypatch.setattr(topk, "drop_dir", lambda spark, path: gone.append(path) or drop(spark, path))
    out = topk.search(vectors, vectors.where("vec_id % 10 = 0").select("vec_id"), k=4)
    assert len(rounds) == 4 and sum(map(sum, rounds)) == 60 and all(len(r) in (0, 2) for r in rounds)
    assert len(gone) == 5 * len(rounds) and not [p for p in gone if os.path.exists(p)]
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 10):
        scores = sorted((-int(z[q] @ v), i) for i, v in enumerate(z) if i != q)[:4]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, out.collect())) == want


def test_topk_of_few(spark):
    vectors = topk.integers(table(spark, [(0, [1.0, -2.0]), (1, [0.5, 0.5]), (2, [-1.0])]))
    out = topk.search(vectors, vectors.where("vec_id = 0").select("vec_id")).collect()
    assert [tuple(r) for r in sorted(out)] == [(0, 1, 1, 1024 * 512 - 2048 * 512), (0, 2, 2, -1024 * 1024)]
    assert topk.search(vectors.limit(0), vectors.select("vec_id")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://a.example/x", "<html><head><title>A &amp; B</title><script>var t='<p>no</p>';</script></head><body><p>One<br>two</p><!-- <p>no</p> --><a href=\"/l\">link</a></body></html>"),
    (2, None, None), (3, "http://b.example/", ""), (None, "u", "<p>é 漢 &lt;b&gt;\r\n\r\nblank</p>"), (1, "http://a.example/x", "<p>same id</p>"),
]


def test_derivatives_link_to_their_responses(spark, folder):
    pages = spark.createDataFrame([(*p, "t", "b") for p in PAGES], "page_id long, url string, html string, title string, body string")
    sources = warc.responses(pages)
    derived = warc.derive(sources)
    rows = derived.collect()
    assert len(rows) == 2 * len(PAGES)
    known = {r.record_id: r for r in sources.collect()}
    for r in rows:
        assert known[r.refers_to].http_headers in [s.http_headers for s in known.values()] and r.content_length == len(r.block.encode())
        assert r.http_headers.startswith("HTTP/1.1 200 OK")
    text = {(r.key, r.block) for r in rows if r.warc_type == "conversion"}
    assert (1, "A & B\nOne\ntwo\nlink") in text and (None, "é 漢 <b>\nblank") in text and (3, "") in text
    meta = next(r.block for r in rows if r.warc_type == "metadata" and "A &amp; B" in r.block)
    assert "outlink: /l\r\n" in meta and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta
    warc.write(derived.repartition(2), f"{folder}/w")
    back = warc.read_records(spark, f"{folder}/w").collect()
    assert sorted((r.fields["WARC-Record-ID"], r.fields["WARC-Refers-To"], r.block) for r in back) == sorted((r.record_id, r.refers_to, r.block) for r in rows)
    assert warc.derive(sources.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [16, 64])
def test_pairs_just_over_the_threshold_are_found(spark, dims):
    """Pairs whose cosine is 0.95 to 0.96, spread over many lists: the hardest to find."""
    rnd = np.random.default_rng(dims)
    x = rnd.normal(size=(1500, dims))
    away = rnd.normal(size=x.shape)
    away -= x * (away * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True)
    turn = np.sqrt(1 - np.square(c := rnd.uniform(0.9505, 0.96, (len(x), 1))))
    y = c * x / np.linalg.norm(x, axis=1, keepdims=True) + turn * away / np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([x, y]).astype(np.float32)
    got = {r.vec_id: r for r in pq.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(both)])).collect()}
    u = both.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    links = np.array([got[i].n_links for i in range(len(both))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.99 * close.sum() and close.sum() >= 3000


def test_vectors_of_an_empty_table(spark):
    assert pq.near_duplicates(table(spark, [])).count() == 0
