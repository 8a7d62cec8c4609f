"""Quality classifier: interpolated modified Kneser-Ney model, perplexity per document.

The model is over UTF-8 bytes (order 5), so it needs no word list, works for any
script and packs an n-gram into one long. One model per language is trained on the
trusted texts; its counts, and what each block of documents asks of them, are rows
of ordinary tables that meet in joins:

1. each block (the texts of one language in one input split) counts its n-grams;
2. per (language, n-gram) the trusted counts are summed; continuation counts of the
   shorter n-grams follow by grouping, discounts and contexts by windows of at most
   256 rows, probabilities by joins from order 1 up;
3. the answers go back to the blocks that asked and every text is scored there.

Each trusted text is also scored by a model that does not count it, since the threshold is
to hold for texts that no model has seen: the trusted texts are dealt into ``FOLDS`` folds, a
fold's counts are taken off before discounts and probabilities, and its texts are scored by
what is left. The folds are columns of the same rows, filled only where a text of the fold asks.

The blocks lie in a table bucketed by block, so the texts themselves are not shuffled. Each order's
counts and probabilities are tables of their own, so every plan is short; a table goes once the
next one is written.

Repeated ordinary words are cheap to any n-gram model. So a text's novelty, the share of n-grams that are new
within their window of the text, has a language's lower bound as the score has an upper one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import BROADCAST_ROWS, Staged, flagged, utf8_bytes
from runloom.session import new_dir, stage

ORDER = 5
BLOCK_BYTES, RUN_BYTES = 32 << 20, 2 << 20
MERGED_BYTES = 64 << 20
GRAM_ROWS = 1 << 20
"""N-grams of a block that one row holds at most, so that no row is as large as a block's n-grams."""
"""Text that an input partition should bring at least: blocks of little text ask for almost every n-gram anew."""
WINDOW, SLOTS = 1024, 8192
"""Novelty is counted in windows of so many bytes; an n-gram counts as seen if its slot of so many is taken."""
SHRINK_BYTES = 400
"""Pseudo bytes at the language's usual rate that each text is scored with, so that short texts need more evidence."""
QUANTILE = 0.995
MARGIN = 1.02
MIN_TRUSTED = 20
FOLDS = 4
"""Folds of trusted texts, by text, so that exact copies of a text are left out together."""

_EACH = range(1, FOLDS + 1)
PACKED = (
    "block long, lang string, doc_ids array<long>, folds array<int>, ends array<long>, body binary, grams array<long>, "
    + ", ".join(f"n{k} array<int>" for k in _EACH)
)


def _grams(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte; a text starts after ORDER - 1 zero bytes."""
    n, pad = len(raw), ORDER - 1
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    wide = np.zeros(n + pad * len(ends), np.uint8)
    sizes = ends - starts
    place = np.arange(n) + np.repeat(pad * (np.arange(len(ends)) + 1), sizes)
    wide[place] = raw
    keys = np.zeros(n, np.int64)
    for back in range(pad, -1, -1):
        keys = (keys << 8) | wide[place - back]
    return keys


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts lo to hi at a time, of about RUN_BYTES together: n-gram keys take eight bytes per byte of text."""
    lo = 0
    while lo < len(ends):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + RUN_BYTES, "right")))
        yield lo, hi
        lo = hi


def _counted(raw: np.ndarray, ends: np.ndarray, folds: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts lo to hi and how often the trusted texts of each fold have them."""
    first = ends[lo - 1] if lo else 0
    own = ends[lo:hi] - first
    keys = _grams(raw[first : ends[hi - 1]], own)
    found = np.unique(keys)
    fold = np.repeat(folds[lo:hi], np.diff(own, prepend=0))
    counts = np.zeros((FOLDS, len(found)), np.int32)
    for k in _EACH:
        known, times = np.unique(keys[fold == k], return_counts=True)
        counts[k - 1, np.searchsorted(found, known)] = times
    return found, counts


def _novelty(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The share of each text's n-grams whose slot is free in their window; 1 for an empty text."""
    sizes = np.diff(ends, prepend=0)
    windows = -(-sizes // WINDOW)
    base = np.cumsum(windows) - windows
    at = np.arange(len(keys)) - np.repeat(ends - sizes, sizes)
    slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
    taken = np.zeros(int(windows.sum()) * SLOTS, bool)
    taken[(np.repeat(base, sizes) + at // WINDOW) * SLOTS + slot.astype(np.int64)] = True
    new = np.concatenate([[0], np.cumsum(taken.reshape(-1, SLOTS).sum(1))])
    return np.where(sizes > 0, (new[base + windows] - new[base]) / np.maximum(sizes, 1), 1.0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
    counts = [np.bincount(place, np.concatenate([c[k] for _, c in parts]), len(found)).astype(np.int32) for k in range(FOLDS)]
    return found, np.stack(counts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, lang, text, fold) to rows of blocks: one per block and language with its texts, then its n-grams.

    A block's texts are counted and compressed batch by batch as they come, so that a task holds no
    language's text in the clear; its n-grams follow in rows of at most ``GRAM_ROWS`` (``body`` null).
    """
    part, seq = TaskContext.get().partitionId(), 0
    held: dict[str, dict] = {}
    schema = pa.schema(
        [
            ("block", pa.int64()), ("lang", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())),
            ("ends", pa.list_(pa.int64())), ("body", pa.binary()), ("grams", pa.list_(pa.int64())),
            *[(f"n{k}", pa.list_(pa.int32())) for k in _EACH],
        ]
    )

    def listed(values, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)

    def row(block: int, lang: str, doc_ids, folds, ends, body, grams, counts) -> pa.RecordBatch:
        values = [
            pa.array([block], pa.int64()), pa.array([lang], pa.string()), listed(doc_ids, pa.int64()), listed(folds, pa.int32()),
            listed(ends, pa.int64()), pa.array([body], pa.binary()), listed(grams, pa.int64()), *[listed(c, pa.int32()) for c in counts],
        ]
        return pa.record_batch(values, schema=schema)

    def add(lang: str, rows: pa.RecordBatch) -> None:
        block = held.setdefault(
            lang, {"size": 0, "doc_ids": [], "folds": [], "ends": [], "at": 0, "body": [], "zstd": zstandard.ZstdCompressor(level=3).compressobj(), "counted": None}
        )
        raw, offsets = utf8_bytes(rows.column("text"))
        ends, folds = offsets[1:], rows.column("fold").to_numpy(zero_copy_only=False).astype(np.int32)
        parts = [_counted(raw, ends, folds, lo, hi) for lo, hi in _runs(ends)]
        block["counted"] = _merged(parts + ([block["counted"]] if block["counted"] else []))
        block["doc_ids"].append(rows.column("doc_id"))
        block["folds"].append(folds)
        block["ends"].append(ends + block["at"])
        block["at"] += len(raw)
        block["body"].append(block["zstd"].compress(raw.data))
        block["size"] += rows.nbytes

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal seq
        block, number = held.pop(lang), (part << 24) + seq
        seq += 1
        found, counts = block["counted"] or (np.zeros(0, np.int64), np.zeros((FOLDS, 0), np.int32))
        body = b"".join([*block["body"], block["zstd"].flush()])
        joined = [pa.concat_arrays(block["doc_ids"]).cast(pa.int64()), *[np.concatenate(block[k]) for k in ("folds", "ends")]]
        none = np.zeros(0, np.int64)
        yield row(number, lang, *joined, body, none, np.zeros((FOLDS, 0), np.int32))
        for lo in range(0, len(found), GRAM_ROWS):
            yield row(number, lang, none, none, none, None, found[lo : lo + GRAM_ROWS], counts[:, lo : lo + GRAM_ROWS])

    for batch in batches:
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            add(lang, batch.filter(pa.compute.equal(langs, lang)))
            if held[lang]["size"] >= BLOCK_BYTES:
                yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


def _score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """One block's texts against the answers to its n-grams: bits of each text, with and without its own fold's counts."""
    out = []
    index = pd.Index(answers.column("gram").to_numpy())
    bits = np.stack([answers.column(name).to_numpy() for name in ["bits", *[f"bits{k}" for k in _EACH]]])
    for row in blocks.to_pylist():
        ends, folds = np.array(row["ends"], np.int64), np.array(row["folds"], np.int32)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(row["body"]), np.uint8)
        spent, held, novelty = np.zeros(len(ends)), np.zeros(len(ends)), np.ones(len(ends))
        for lo, hi in _runs(ends):
            first = ends[lo - 1] if lo else 0
            own = ends[lo:hi] - first
            keys = _grams(raw[first : ends[hi - 1]], own)
            novelty[lo:hi] = _novelty(keys, own)
            at = index.get_indexer(keys)
            for out_of, model in ((spent, 0), (held, np.repeat(folds[lo:hi], np.diff(own, prepend=0)))):
                total = np.zeros(own[-1] + 1)
                np.cumsum(bits[model, at], out=total[1:])
                out_of[lo:hi] = np.diff(total[own], prepend=0.0)
        starts = np.concatenate([[0], ends[:-1]])
        out.append(
            pa.table(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "lang": pa.array([row["lang"]] * len(ends), pa.string()),
                    "trusted": pa.array(folds > 0, pa.bool_()),
                    "n_bytes": pa.array(ends - starts, pa.int64()),
                    "bits": pa.array(spent, pa.float64()),
                    "held_bits": pa.array(held, pa.float64()),
                    "novelty": pa.array(novelty, pa.float64()),
                }
            )
        )
    return pa.concat_tables(out)


SCORED = "doc_id long, lang string, trusted boolean, n_bytes long, bits double, held_bits double, novelty double"


def _count(model: int) -> Column:
    """An n-gram's count in a model: 0 is the whole one, the others lack a fold."""
    return F.col("c") - F.col(f"own{model}") if model else F.col("c")


def _discounts(entries: DataFrame) -> DataFrame:
    """The three discounts of each language and model, from the counts of counts 1 to 4."""
    n = [
        F.sum(F.when(_count(m) == k, 1).otherwise(0)).cast("double").alias(f"n{k}_{m}")
        for m in range(FOLDS + 1) for k in (1, 2, 3, 4)
    ]

    def rule(k: int, m: int):
        n1, n2 = F.col(f"n1_{m}"), F.col(f"n2_{m}")
        y = F.try_divide(n1, n1 + 2 * n2)
        usual = F.lit(float(k)) - F.lit(k + 1.0) * y * F.try_divide(F.col(f"n{k + 1}_{m}"), F.col(f"n{k}_{m}"))
        return F.when(usual.between(0.05, k), usual).otherwise(F.lit(0.5 * k)).alias(f"d{k}_{m}")

    return entries.groupBy("lang").agg(*n).select("lang", *[rule(k, m) for m in range(FOLDS + 1) for k in (1, 2, 3)])


def _below(entries: DataFrame, order: int) -> DataFrame:
    """The next shorter n-grams: each counts the different ones that end in it."""
    suffix = F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1)
    seen = lambda m: F.when(_count(m) > 0, 1).otherwise(0)
    return entries.groupBy("lang", suffix.alias("gram")).agg(
        F.sum(seen(0)).alias("c"), *[F.sum(seen(0) - seen(k)).alias(f"own{k}") for k in _EACH], F.bit_or("asking").alias("asking")
    )


def _probabilities(entries: DataFrame, order: int, few_langs: bool, lower: DataFrame | None) -> DataFrame:
    """(lang, gram, p0, p1, ...) of every asked n-gram of an order, by the whole model and by those that lack a fold.

    ``entries`` has (lang, gram, c, own1, ..., asking): the count, 0 where never seen, how much of it goes
    with each fold, and as bits the folds whose texts have the n-gram. Other folds' numbers are null.
    ``lower``: the same of the next shorter n-grams, None below order 1.
    ``few_langs``: the languages were counted and are few enough to broadcast their discounts,
    so that no shuffle deals n-grams by language.
    """
    models = range(FOLDS + 1)
    discounts = F.broadcast(_discounts(entries)) if few_langs else _discounts(entries)
    around = Window.partitionBy("lang", "context")

    def cut(m: int) -> Column:
        c = _count(m)
        return F.when(c == 0, 0.0).when(c == 1, F.col(f"d1_{m}")).when(c == 2, F.col(f"d2_{m}")).otherwise(F.col(f"d3_{m}"))

    def asked(m: int, value: Column) -> Column:
        return F.when(F.col("asking").bitwiseAND(1 << (m - 1)) != 0, value.cast("float")) if m else value

    # dealt out before the discounts are joined, so that the shuffled rows hold counts only
    rows = (
        entries.withColumn("context", F.shiftright("gram", 8)).repartition("lang", "context").join(discounts, "lang")
        .select("lang", "gram", "context", "asking", *[_count(m).alias(f"c{m}") for m in models], *[cut(m).alias(f"cut{m}") for m in models])
        .select(
            "*", *[F.sum(f"c{m}").over(around).alias(f"total{m}") for m in models], *[F.sum(f"cut{m}").over(around).alias(f"left{m}") for m in models]
        )
    )
    # p = own + rest * p of the shorter n-gram
    own = [asked(m, F.when(F.col(f"total{m}") > 0, (F.col(f"c{m}") - F.col(f"cut{m}")) / F.col(f"total{m}")).otherwise(0.0)).alias(f"own{m}") for m in models]
    rest = [asked(m, F.when(F.col(f"total{m}") > 0, F.col(f"left{m}") / F.col(f"total{m}")).otherwise(1.0)).alias(f"rest{m}") for m in models]
    if lower is None:
        shorter = rows.select("lang", "gram", *own, *rest, *[F.lit(1.0 / 256).alias(f"q{m}") for m in models])
    else:
        suffix = F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1)
        known = lower.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), *[F.col(f"p{m}").alias(f"q{m}") for m in models])
        shorter = rows.select("lang", "gram", suffix.alias("suffix"), *own, *rest).join(
            known, (F.col("lang") == F.col("_l")) & (F.col("suffix") == F.col("_g"))
        )
    p = [F.col(f"own{m}") + F.col(f"rest{m}") * F.col(f"q{m}") for m in models]
    return shorter.select("lang", "gram", *[x.cast("float" if m else "double").alias(f"p{m}") for m, x in enumerate(p)])


def score_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Bits of every text under its language's model of the trusted texts (``trusted``: one column of doc_ids).

    Columns of ``SCORED``, one row per input row. A null language is a language of
    its own (""), a null text is empty, an empty text has 0 bits. Without trusted text
    each byte costs 8 bits. ``held_bits`` are those of a model without the counts of the text's fold
    (of a text that is not trusted: the same as ``bits``).
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // MERGED_BYTES))
    fold = F.when(F.col("trusted"), 1 + F.pmod(F.xxhash64("text"), F.lit(FOLDS))).otherwise(0).cast("int").alias("fold")
    source = flagged(source, trusted, "doc_id", "trusted").select("doc_id", "lang", "text", fold)
    packed = source.coalesce(parts).mapInArrow(_pack, PACKED)
    staged, path, name = Staged(spark), new_dir(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    packed.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(max(2, parts), "block").saveAsTable(name)
    times = [f"n{k}" for k in _EACH]
    asked = spark.table(name).select("block", "lang", F.explode(F.arrays_zip("grams", *times)).alias("g")).select(
        "block", "lang", F.col("g.grams").alias("gram"), *[F.col(f"g.{n}").alias(n) for n in times]
    )
    counted = asked.groupBy("lang", "gram").agg(*[F.sum(f"n{k}").alias(f"own{k}") for k in _EACH])
    asking = [F.when(F.col(f"own{k}") > 0, 1 << (k - 1)).otherwise(0) for k in _EACH]
    whole = sum((F.col(f"own{k}") for k in _EACH), F.lit(0).cast("long"))
    entries = {ORDER: staged.put("counts", counted.select("*", whole.alias("c"), sum(asking, F.lit(0)).alias("asking")))}
    for order in range(ORDER, 1, -1):
        entries[order - 1] = staged.put(f"counts{order - 1}", _below(entries[order], order))
    few_langs = entries[1].select("lang").distinct().count() <= BROADCAST_ROWS
    model = None
    for order in range(1, ORDER):
        shorter, model = model, staged.put(f"model{order}", _probabilities(entries[order], order, few_langs, model))
        staged.drop(shorter, entries[order])
    bits = [(-F.log2(f"p{m}")).cast("float").alias(f"bits{m}") for m in range(FOLDS + 1)]
    model = _probabilities(entries[ORDER], ORDER, few_langs, model).select("lang", "gram", *bits)
    answers = asked.join(model, ["lang", "gram"]).select(
        F.col("block").alias("asker"), "gram", F.col("bits0").alias("bits"), *[F.when(F.col(f"n{k}") > 0, F.col(f"bits{k}")).alias(f"bits{k}") for k in _EACH]
    )
    bodies = spark.table(name).where(F.col("body").isNotNull()).select("block", "lang", "doc_ids", "folds", "ends", "body")
    scored = Staged(spark).put("scored", bodies.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_score, SCORED))
    spark.sql(f"DROP TABLE {name}")
    staged.drop_all(path)
    return scored


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per input row: doc_id, lang, n_bytes, perplexity (per byte), score, threshold, novelty, least_novelty, kept.

    ``score`` is the rate in bits per byte with ``SHRINK_BYTES`` pseudo bytes at the trusted
    texts' rate added, by models that do not count the text: both are of ``held_bits``. A text is kept when its
    score is at most the language's threshold, the ``quantile`` of the trusted texts' scores (over all
    of them) times ``margin``, and its novelty at least the opposite quantile of theirs divided by ``margin``.
    ``perplexity`` is of the whole model. Languages
    with fewer than ``MIN_TRUSTED`` trusted texts have no threshold and keep everything; so do empty texts.
    """
    scored = score_texts(docs, trusted)
    rate, langs = stage(
        scored.where("trusted").groupBy("lang").agg(
            F.count(F.lit(1)).alias("n_trusted"), (F.sum("held_bits") / F.greatest(F.sum("n_bytes"), F.lit(1))).alias("rate")
        ),
        "rates",
    )
    # a row per language, counted: no join deals documents by language
    few = F.broadcast if langs <= BROADCAST_ROWS else lambda rows: rows
    rated = scored.join(few(rate), "lang", "left").withColumn(
        "score", (F.col("held_bits") + SHRINK_BYTES * F.coalesce("rate", F.lit(8.0))) / (F.col("n_bytes") + SHRINK_BYTES)
    )
    enough = lambda name: F.when(F.col("n") >= MIN_TRUSTED, F.col(name))
    bound = (
        rated.where("trusted").groupBy("lang")
        .agg(
            (margin * F.percentile_approx("score", quantile, 10_000)).alias("high"),
            (F.percentile_approx("novelty", 1 - quantile, 10_000) / margin).alias("low"), F.max("n_trusted").alias("n"),
        )
        .select("lang", enough("high").alias("threshold"), enough("low").alias("least_novelty"))
    )
    return rated.join(few(stage(bound, "bounds")[0]), "lang", "left").select(
        "doc_id",
        "lang",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"),
        "score",
        "threshold",
        "novelty",
        "least_novelty",
        F.coalesce((F.col("score") <= F.col("threshold")) & (F.col("novelty") >= F.col("least_novelty")), F.lit(True)).alias("kept"),
    )
