"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Coarse centroids cut the unit vectors into lists; what is left of a vector after its
centroid is coded per subspace. A query probes every list whose border lies near enough,
sums table look-ups over a list's codes, and reranks by exact cosine whatever the codes
cannot rule out: a code's own error is known, so the look-up distance loses no pair
of a probed list. Lists are dealt in blocks of bounded size on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.components import components
from runloom.session import stage

LEAST_COSINE = 0.95
SAMPLE = 16_384
"""Vectors that the centroids and code books are fitted on, at most; every vector is indexed."""
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 128, 16, 4096
SUBSPACES, WORDS = 8, 256
PROBE_SIGMAS = 2.0
MEMBER_BLOCK, QUERY_BLOCK = 256, 2048


@dataclass(frozen=True)
class Index:
    """At most ``MOST_LISTS`` centroids and ``SUBSPACES * WORDS`` code words: of bounded size."""

    centroids: np.ndarray
    books: np.ndarray
    width: int

    def units(self, vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Unit vectors in double precision, padded with zeros to the index's width."""
        lengths = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
        values = np.asarray(pc.list_flatten(vectors), dtype=np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros((len(lengths), self.width))
        out[row, column] = values
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(p @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) for p in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        centres[own[order][at]] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def fit(vectors: DataFrame, n: int, width: int) -> Index:
    """Centroids and code books (none, if there are no vectors) from the vectors of the lowest id hashes; ``vectors``: (id, vec)."""
    width = -(-width // SUBSPACES) * SUBSPACES
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    empty = Index(np.zeros((0, width)), np.zeros((SUBSPACES, 0, width // SUBSPACES)), width)
    if not rows.num_rows:
        return empty
    x = empty.units(rows.column("vec"))
    lists = min(MOST_LISTS, max(LEAST_LISTS, 1 << max(0, (n // LIST_ROWS).bit_length())))
    centroids = _kmeans(x, min(lists, len(x)), 8)
    own = (x @ centroids.T - 0.5 * (centroids**2).sum(1)).argmax(1)
    rest = (x - centroids[own]).reshape(len(x), SUBSPACES, -1)
    books = np.stack([_kmeans(rest[:, s], min(WORDS, len(x)), 6) for s in range(SUBSPACES)])
    return Index(centroids, books, width)


def _encode(batches: Iterator[pa.RecordBatch], index, least: float) -> Iterator[pa.RecordBatch]:
    """(id, copies, vec) to what the lists hold, with the lists that each vector probes."""
    ix = index.value
    centroids, norms = ix.centroids, (ix.centroids**2).sum(1)
    between = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * centroids @ centroids.T, 1e-12))
    reach = PROBE_SIGMAS * np.sqrt(2 * (1 - least)) / np.sqrt(ix.width)
    for whole in batches:
        for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
            x = ix.units(batch.column("vec"))
            far = 1 + norms - 2 * x @ centroids.T
            own = far.argmin(1)
            rows = np.arange(len(x))
            border = (far - far[rows, own][:, None]) / (2 * between[own])
            border[rows, own] = 0
            probes = [np.flatnonzero(p).astype(np.int32) for p in border <= reach]
            rest = (x - centroids[own]).reshape(len(x), SUBSPACES, -1)
            codes = np.stack([(rest[:, s] @ b.T - 0.5 * (b**2).sum(1)).argmax(1) for s, b in enumerate(ix.books)], axis=1)
            coded = np.stack([b[codes[:, s]] for s, b in enumerate(ix.books)], axis=1)
            error = np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))
            columns = {
                "id": batch.column("id"), "copies": batch.column("copies"), "vec": batch.column("vec"), "cell": pa.array(own.astype(np.int32)),
                "code": pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), "error": pa.array(error),
                "probes": pa.array(probes, pa.list_(pa.int32())),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is joined with by the pairs."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == old).all():
            return label


def _search(members: pa.Table, queries: pa.Table, index, least: float) -> pa.Table:
    """Links of one block of queries with one block of a list: (id, links, root) of every row that has some."""
    out = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    if not members.num_rows or not queries.num_rows:
        return out.empty_table()
    ix, cell = index.value, members.column("list")[0].as_py()
    y_id, x_id = members.column("id").to_numpy(), queries.column("x_id").to_numpy()
    y_copies, x_copies = members.column("copies").to_numpy(), queries.column("x_copies").to_numpy()
    y, x = ix.units(members.column("vec")), ix.units(queries.column("x_vec"))
    codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(y), SUBSPACES)
    rest = (x - ix.centroids[cell]).reshape(len(x), SUBSPACES, -1)
    far = np.zeros((len(x), len(y)))
    for s, book in enumerate(ix.books):
        table = (rest[:, s] ** 2).sum(1)[:, None] - 2 * rest[:, s] @ book.T + (book**2).sum(1)
        far += table[:, codes[:, s]]
    bound = (np.sqrt(2 * (1 - least)) + members.column("error").to_numpy() + 1e-6) ** 2
    i, j = np.nonzero((far <= bound) & (x_id[:, None] != y_id))
    near = np.concatenate([np.zeros(0, bool), *[
        np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)
    ]])
    i, j = i[near], j[near]
    # a pair counts for its query; for its list member only if the member's own search won't find it
    probed = np.zeros((len(y), len(ix.centroids)), bool)
    for row, p in zip(probed, members.column("probes").to_pylist()):
        row[p] = True
    alone = ~probed[j, queries.column("x_cell").to_numpy()[i]]
    ids = np.unique(np.concatenate([x_id[i], y_id[j]]))
    a, b = np.searchsorted(ids, x_id[i]), np.searchsorted(ids, y_id[j])
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, y_copies[j])
    np.add.at(links, b[alone], x_copies[i][alone])
    return pa.table([pa.array(ids), pa.array(links), pa.array(ids[_roots(len(ids), a, b)])], schema=out)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vectors``: (vec_id, embedding). One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do rows without vec_id (component null, kept). Shorter vectors count as padded with
    zeros. Equal vectors are one entry with a number of copies, each linked with the others.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    alike = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    entries, n = stage(alike.select("id", "copies", F.col("embedding").cast("array<double>").alias("vec"), "embedding"), "entries")
    spark = rows.sparkSession
    width = entries.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]
    index = spark.sparkContext.broadcast(fit(entries, n, width))
    coded = entries.select("id", "copies", "vec").mapInArrow(
        functools.partial(_encode, index=index, least=least),
        "id long, copies long, vec array<double>, cell int, code binary, error double, probes array<int>",
    )
    coded = stage(coded, "coded")[0]
    asking = coded.select("id", "copies", "vec", "cell", F.explode("probes").alias("list"))
    sizes = (
        coded.groupBy(F.col("cell").alias("list")).agg(F.count(F.lit(1)).alias("m"))
        .join(asking.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
        .select("list", F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb"))
    )
    sizes = F.broadcast(stage(sizes, "sizes")[0])  # a row per list: MOST_LISTS at most
    hashed = F.xxhash64("id")
    members = (
        coded.withColumn("list", F.col("cell")).join(sizes, "list")
        .withColumn("mblock", F.pmod(hashed, "mb").cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .select("list", "mblock", "qblock", "id", "copies", "vec", "code", "error", "probes")
    )
    queries = (
        asking.join(sizes, "list")
        .withColumn("qblock", F.pmod(hashed, "qb").cast("int")).withColumn("mblock", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        .select(F.col("list").alias("ql"), F.col("mblock").alias("qm"), F.col("qblock").alias("qq"),
                *[F.col(c).alias(f"x_{c}") for c in ("id", "copies", "vec", "cell")])
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, index, least)

    found = members.groupBy("list", "mblock", "qblock").cogroup(queries.groupBy("ql", "qm", "qq")).applyInArrow(
        search, "id long, links long, root long"
    )
    found = stage(found, "found")[0]
    label = components(found.select("id", "root")).select(F.col("node").alias("id"), "component")
    counted = entries.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(label, "id", "left")
    of_entry = counted.select(
        F.col("embedding").alias("_same"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        F.coalesce("component", "id").alias("_component"),
    )
    joined = rows.withColumn("_usable", usable).join(of_entry, F.col("_usable") & (F.col("embedding") == F.col("_same")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
