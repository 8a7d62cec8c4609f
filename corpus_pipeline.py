"""Cleans a corpus in stages: quality, toxicity, near copies, personal data, packing.

Each stage takes the documents that its predecessor kept, as a table with the columns
of ``documents``; ``run`` writes every stage's result to the shared work folder and
reads it back, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import kneser_ney, minmax, packing, surrogates, toxicity
from runloom.llm.common import read
from runloom.llm.queries import KEY
from runloom.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity is above their language's threshold."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    verdicts = kneser_ney.classify(docs, trusted)
    rejected = verdicts.groupBy("doc_id").agg(F.max("kept").alias("any_kept")).where("NOT any_kept").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic."""
    machine = toxicity.fit(docs, toxicity.train_labels(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, machine, "_toxicity").where(F.col("_toxicity") < toxicity.TOXIC_FROM).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component (all its rows, should an id repeat)."""
    dropped = minmax.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return surrogates.pseudonymise(docs, KEY).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality", quality), ("toxicity", toxic), ("near copies", near_copies), ("personal data", private), ("packing", packed)]

ORACLE_SQL = None
"""Language-model scores, a trained model and best-fit packing are beyond SQL; the tests use brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)[0]
    return STAGES[-1][1](spark, docs, sf_dir)
