"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import conversations, kneser_ney, licences, minmax, packing, pq, resharding, spm, surrogates, topk, toxicity, warc, whitening
from runloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEY = b"a key for the registered query; real ones are secret"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, as a digest, and whether decoding them gives the text again."""
    import public_tokenizers

    vocabulary = spm.load(public_tokenizers.path("piece_bpe_32k.model"))
    return spm.check(read(spark, sf_dir, "documents"), vocabulary)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and verdict; the texts of quality 1 are the trusted ones."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(read(spark, sf_dir, "documents"), trusted)


@query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best licence notice, and the licences that it holds as passages."""
    return licences.digest(licences.scan(read(spark, sf_dir, "documents")))


SQL["op3_licences"] = licences.oracle_sql()


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of the held-out third are never read by the fit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, toxicity.train_labels(read(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, machine)
    predicted = (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of highest inner product with every hundredth one."""
    vectors = topk.integers(read(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))


SQL["op5_topk"] = """
    WITH fine AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text records of every page."""
    return warc.derive(warc.responses(read(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


SQL["op6_warc"] = warc.oracle_sql()


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data replaced, and how many mentions were."""
    docs = surrogates.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return docs.select("doc_id", "text", F.col("_n_replaced").alias("n_replaced"))


@query
def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return minmax.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return pq.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(spark, read(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components, at unit variance."""
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after planted damage: its faults, its cheapest repair and the repaired text's digest."""
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


SQL["op12_conversations"] = conversations.oracle_sql()


@query
def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's new shard and slot, read back from the resharded files."""
    return resharding.digests(resharding.reshard(read(spark, sf_dir, "documents")))
