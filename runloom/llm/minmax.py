"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so 80 evaluations per shingle make 160 values: 32 bands of 5. Texts with the
same shingle set are one class; classes that share a band are candidates and every
link is confirmed on the full sets. Only what decides the components is tested: first the
members of a bucket are held against its centre; where buckets then still hold several
components, blocks of their members are compared in tasks that give out nothing but links.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import flagged, slices, utf8_bytes
from runloom.llm.components import components
from runloom.session import stage

WORDS = 5
PERCENT = 75
PERMUTATIONS = 80
BAND = 5
BLOCK_MEMBERS, BLOCK_SHINGLES = 64, 65_536
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_TIMES = (_RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1))[:, None]
_PLUS = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]
_FOLD = _RNG.integers(1, 1 << 63, BAND, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles.

    Words are runs of bytes other than white space, A-Z lower-cased. A word's hash is a
    difference of prefix sums over the whole slice; a shingle's hash mixes those of its
    words with their places. Fewer than ``WORDS`` words make one shingle; none, no shingle.
    """
    raw, offsets = utf8_bytes(texts)
    n = len(raw)
    if not n:
        yield from (np.zeros(0, np.uint64) for _ in range(len(texts)))
        return
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    size = 1 << max(16, int(n).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(size, int(_BASE))[:n], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * _powers(size, int(_BASE_INVERSE))[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    m = len(words)
    full = np.zeros(max(0, m - WORDS + 1), np.uint64)
    for k in range(WORDS):
        full += words[k : k + len(full)] * _PLACE[k]
    full = _mix(full)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= WORDS:
            yield np.unique(full[lo : hi - WORDS + 1])
        elif hi > lo:
            k = hi - lo
            yield _mix((words[lo:hi] * _PLACE[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k))
        else:
            yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, under every permutation (``x * a + b`` of mixed hashes)."""
    low, high = [], []
    for at in range(0, len(found), 8192):
        under = found[at : at + 8192] * _TIMES + _PLUS
        low.append(under.min(axis=1))
        high.append(under.max(axis=1))
    return np.concatenate([np.min(low, axis=0), np.max(high, axis=0)])


def _print(found: np.ndarray, k: int) -> np.uint64:
    """A fingerprint of a set, whatever its order."""
    return _mix(found ^ _PLACE[k]).sum(dtype=np.uint64)


_BAND_NUMBER = np.arange(2 * PERMUTATIONS // BAND, dtype=np.uint64)
SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>"
_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
    ]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        n, fp, bands, bits = [], [], [], []
        for found in shingle_sets(batch.column("text")):
            n.append(len(found))
            fp.append([_print(found, k) for k in (0, 1)])
            if len(found):
                values = _mix(signature(found))
                folded = (values.reshape(-1, BAND) * _FOLD).sum(axis=1, dtype=np.uint64)
                bands.append(_mix(folded + _BAND_NUMBER).view(np.int64))
                one = np.zeros(192, np.uint8)
                one[: len(values)] = values & np.uint64(1)
                bits.append(np.packbits(one).view(np.int64))
            else:
                bands.append(np.zeros(0, np.int64))
                bits.append(np.zeros(0, np.int64))
        marks = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64)
        columns = [batch.column("doc_id"), n, marks[:, 0], marks[:, 1], bands, bits]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SIGNED)], schema=_SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        found = list(shingle_sets(batch.column("text")))
        fp1 = [int(_print(s, 0).view(np.int64)) for s in found]
        columns = [batch.column("doc_id"), pa.array(fp1, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["doc_id", "fp1", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return shared.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n") - F.col("i"))).select("a", "b")


def _alike(percent: int):
    """A cheap test that no linked pair fails by size, and next to none by the 160 signature bits.

    A bit agrees with probability (1 + J) / 2; the bound is five standard deviations
    below what the threshold promises.
    """
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col("ba")[k].bitwiseXOR(F.col("bb")[k])) for k in range(3)])
    share = (1 - percent / 100) / 2
    values = 2 * PERMUTATIONS
    most = int(values * share + 5 * (values * share * (1 - share)) ** 0.5) + 1
    return (F.lit(100) * small >= F.lit(percent) * large) & (differ <= most)


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) of every candidate."""
    merged = components(links).withColumnRenamed("node", "rep")
    return stage(nodes.select("rep").join(merged, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels")[0]


def _undecided(members: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame | None:
    """What buckets that still hold several components leave to compare: blocks of clusters, or None.

    Buckets that share members form a cluster. Its members are dealt to blocks of about
    ``BLOCK_MEMBERS`` rows and ``BLOCK_SHINGLES`` shingles, and a row goes to each pair of blocks
    that its own is in.
    """
    held = stage(members.join(label, "rep"), "held")[0]
    keys = held.groupBy("key").agg(F.min("rep").alias("centre"), F.min("component").alias("least"), F.max("component").alias("most"))
    inside, n = stage(held.join(keys.where("least < most").select("key", "centre"), "key").select("rep", "centre").distinct(), "open")
    if not n:
        return None
    cluster = components(inside).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    short = F.transform("shingles", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("shingles")
    rows = stage(
        cluster.join(label, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "cluster", "component", F.size("shingles").alias("n"), short),
        "clustered",
    )[0]
    sizes = rows.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        (F.min("component") < F.max("component")).alias("several"),
    )
    dealt = rows.join(sizes.where("several"), "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    partner = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return partner.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "component", "n", "shingles")


def _compare(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of one pair of blocks, of different components, that are similar enough by 31-bit shingles.

    Shortened hashes can only agree more often than whole ones, so no link is lost.
    """
    rep, component, block = (rows.column(c).to_numpy() for c in ("rep", "component", "block"))
    n, lists = rows.column("n").to_numpy().astype(np.int64), rows.column("shingles").combine_chunks()
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    right = np.flatnonzero(block == hi)
    left = np.flatnonzero(block == lo)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) and len(right) and component.min() < component.max():
        values = [lists[int(i)].values.to_numpy() for i in right]
        flat, owner = np.concatenate(values), np.repeat(np.arange(len(right)), [len(v) for v in values])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i in left.tolist():
            wanted = lists[i].values.to_numpy()
            first, last = np.searchsorted(flat, wanted), np.searchsorted(flat, wanted, "right")
            hits = last - first
            at = np.repeat(first - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
            shared = np.bincount(owner[at], minlength=len(right))
            near = (100 * shared >= percent * (n[i] + n[right] - shared)) & (component[right] != component[i])
            if lo == hi:
                near &= rep[right] > rep[i]
            found = rep[right[near]]
            out_a.append(np.minimum(found, rep[i]))
            out_b.append(np.maximum(found, rep[i]))
    return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows are linked when ``100 * intersection >= percent * union`` of their shingle
    sets. Null and blank texts have no shingles and link with nothing. Rows without a
    doc_id link with nothing either (component null, kept). Rows that share a doc_id but not
    their text are each linked by their own text, as far as their class is not that of
    another row of that id.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(source.mapInArrow(_sign, SIGNED), "signed")[0]
    mark = ["fp1", "fp2", "n_shingles"]
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy(*mark).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = stage(classes, "classes")[0]
    nodes = classes.groupBy("rep").agg(F.min(F.struct("fp1", "n_shingles", "bands", "bits")).alias("c")).select("rep", "c.*")
    banded = nodes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stage(banded.join(shared, "key"), "members")[0]
    sketch = nodes.select("rep", F.col("n_shingles").alias("n"), "bits")
    sketch = stage(sketch.join(members.select("rep").distinct(), "rep"), "sketches")[0]
    wanted = flagged(source, sketch.select("rep"), "doc_id", "wanted").where("wanted").select("doc_id", "text")
    sets = wanted.mapInArrow(_sets, "doc_id long, fp1 long, shingles array<long>").groupBy("doc_id").agg(
        F.min(F.struct("fp1", "shingles"))["shingles"].alias("shingles")
    )
    sets = stage(sets, "sets")[0]
    centres = members.groupBy("key").agg(F.min("rep").alias("centre"))
    stars = members.join(centres, "key").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda x: sketch.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    fit = stage(stars.join(side("a"), "a").join(side("b"), "b").where(_alike(percent)).select("a", "b"), "pairs")[0]
    links = stage(_confirmed(fit, sets, percent), "links")[0]
    label = _labels(sketch, links)
    undecided = _undecided(members, label, sets)
    if undecided is not None:

        def compare(rows: pa.Table) -> pa.Table:
            return _compare(rows, percent)

        close = undecided.groupBy("cluster", "lo", "hi").applyInArrow(compare, "a long, b long")
        more = stage(_confirmed(close.distinct(), sets, percent), "links")[0]
        label = _labels(sketch, links.unionAll(more))
    of_class = classes.select(*mark, "rep").join(label, "rep", "left").select(*mark, F.coalesce("component", "rep").alias("component_id"))
    part = signed.select("doc_id", *mark)
    out = part.join(of_class, mark, "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
