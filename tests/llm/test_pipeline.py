"""The pipeline's stages as a whole, and the entry point's guard."""

from __future__ import annotations

from collections import Counter

import __spark_entry__ as entry_points
import corpus_pipeline
from pyspark.sql import functions as F
from runloom.llm import kneser_ney
from runloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


def test_stages_keep_columns_and_drop_what_they_judge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near copies", "personal data", "packing"]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    table = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        table = step(spark, table, SF)
        assert table.columns == docs.columns
    left = {r.doc_id: r.text for r in table.collect()}
    good = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    assert set(left) <= {r.doc_id for r in docs.collect()}
    # a language needs MIN_TRUSTED trusted texts before it judges any
    lang = {r.doc_id: r.lang for r in docs.collect()}
    trusted = Counter(lang[i] for i, (q, _) in labels.items() if q == 1)
    judged = [i for i, (q, _) in labels.items() if q == 0 and trusted[lang[i]] >= kneser_ney.MIN_TRUSTED]
    assert judged and not [i for i in judged if i in left and len(left[i]) > 400]
    assert sum(i in left for i in good) >= 0.8 * len(good)  # the rest are copies
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == set(left)


CLASHING = ["label", "score", "kept", "block", "component_id", "rep", "key", "n", "entity", "piece", "sequence_id", "wanted", "features"]


def odd_tables(spark, folder, rows):
    """``documents`` with columns named like those of the stages, and labels with gaps, below ``folder``."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    docs.write.parquet(f"{folder}/documents.parquet")
    given = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    gaps = given.limit(0) if not rows else given.unionAll(spark.sql("SELECT CAST(null AS BIGINT), 1, 1 UNION ALL SELECT 9001, null, null"))
    gaps.write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_on_odd_rows(spark, folder):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    plain = max((r for r in given if r[2] == "en"), key=lambda r: len(r[1]))
    odd = [
        (None, None, None, None, None), (None, plain[1], "en", None, None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0),
        (9003, " \n\t ", None, "s", 4), (9004, plain[1], None, "s", None), (9005, " ".join([plain[1]] * 40), "en", "s", 1),
        (9006, "word " * 60_000, "de", "s", 1), (9007, "\u0000\u2028 \U0001f600", "xx", "s", 1), given[0], given[0], (given[1][0], plain[1], "en", "s", 1),
    ]
    docs = odd_tables(spark, folder, given + odd)
    table = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in table.collect())
        table = step(spark, table, folder)
        assert table.columns == docs.columns
        after = Counter(r.doc_id for r in table.collect())
        assert not after - before  # no row is made or repeated
    left = table.collect()
    assert all(r[c] == f"own {c}" for r in left for c in CLASHING)
    ids = Counter(r.doc_id for r in left)
    # texts without words are nobody's copies; rows without an id are no one's either
    assert all(ids[i] == 1 for i in (9001, 9002, 9003)) and ids[None] == 2
    pieces = Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, folder).collect())
    assert {i for i, _ in pieces} == set(ids)
    assert all(pieces[i, 0] == n for i, n in ids.items())


def test_stages_on_empty_tables(spark, folder):
    docs = odd_tables(spark, folder, [])
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, folder)
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
