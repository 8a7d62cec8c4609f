"""Toxicity by a factorization machine over hashed terms.

Beside a weight per term the machine learns a short vector per term; the dot product
of two terms' vectors is the weight of their pair, so that an insult next to a mention
of a group can count for more than the sum of both. It is fitted with MLlib on a
bounded sample of labelled texts and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import stage

SAMPLE_PER_CLASS = 10_000
"""Labelled texts of each class that the machine is fitted on, at most (those of the lowest id hashes)."""
SLOTS = 1 << 18
TERMS = 4096
"""Slots that the machine knows: those whose share of texts differs most between the classes."""
MIN_Z = 4.0
FACTORS = 4
ITERATIONS = 60
TOXIC_FROM = 0.7

_WORDS = re.compile(r"[^\W\d_]+")


def slots_of(text: str) -> set[int]:
    """The hashed terms of a text: lower-cased runs of letters."""
    return {zlib.crc32(w.encode("utf-8", "replace")) % SLOTS for w in set(_WORDS.findall(text.lower()))}


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[str(s) for s in sorted(slots_of(t or ""))] for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "slots"])


@dataclass(frozen=True)
class Machine:
    """The fitted numbers: at most ``TERMS`` slots, so its size is fixed."""

    bias: float
    index: dict[int, int]
    linear: np.ndarray
    factors: np.ndarray

    def score(self, text: str) -> float:
        at = [i for s in slots_of(text) if (i := self.index.get(s)) is not None]
        z = self.bias
        if at:
            v = self.factors[at]
            z += self.linear[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 1) -> Machine:
    """``labels``: (doc_id, label 0/1). Texts that repeat count once; rows without an id, label or text are left out.

    Without texts of both classes the machine is the share of class 1, smoothed, for every text.
    The sample is capped per class, so the bias is moved back to the odds of all labels: a score
    means the same whether or not a class was capped.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    labelled = {int(k): n for k, n in known.groupBy("label").count().collect()}
    stands_for = [max(1.0, labelled.get(k, 0) / per_class) for k in (0, 1)]  # labels per sampled one
    shift = float(np.log(stands_for[1] / stands_for[0]))
    sample = [known.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = sample[0].unionAll(sample[1])
    texts = (
        docs.select("doc_id", "text").where("text IS NOT NULL")
        .join(F.broadcast(picked), "doc_id")  # at most 2 * per_class rows of two numbers
        .groupBy(F.xxhash64("text").alias("same")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    )
    rows = stage(texts.select("label", "text").mapInArrow(_hash_texts, "label double, slots array<string>"), "terms")[0]
    totals = {k: n for k, n in rows.groupBy("label").count().collect()}
    n0, n1 = totals.get(0.0, 0), totals.get(1.0, 0)
    if not n0 or not n1:
        all0, all1 = n0 * stands_for[0], n1 * stands_for[1]
        share = (all1 + 1) / (all0 + all1 + 2)
        return Machine(float(np.log(share / (1 - share))), {}, np.zeros(0), np.zeros((0, FACTORS)))
    by_slot = rows.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(
        F.sum("label").alias("k1"), F.count(F.lit(1)).alias("k")
    )
    p = F.col("k") / float(n0 + n1)
    spread = F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    z = F.abs(F.try_divide(F.col("k1") / float(n1) - (F.col("k") - F.col("k1")) / float(n0), spread))
    chosen = by_slot.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "slot").limit(TERMS).collect()
    terms = [r["slot"] for r in chosen]
    if not terms:
        return Machine(float(np.log(n1 / n0)) + shift, {}, np.zeros(0), np.zeros((0, FACTORS)))
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="slots", outputCol="features")
    counter.setBinary(True)
    features = stage(counter.transform(rows).select("label", "features"), "features")[0]
    machine = FMClassifier(
        factorSize=FACTORS, regParam=1e-3, maxIter=ITERATIONS, stepSize=0.1, initStd=0.05, solver="adamW", seed=seed
    ).fit(features)
    index = {int(t): i for i, t in enumerate(terms)}
    return Machine(float(machine.intercept) + shift, index, machine.linear.toArray(), machine.factors.toArray())


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; a null or empty text has the score of no terms."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        one = model.value.score
        return pd.Series([one(t) if t else one("") for t in texts], dtype="float64")

    return docs.withColumn(name, scores(F.col("text")))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels nothing is fitted on."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
