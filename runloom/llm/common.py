"""What several operators share: sources, size-checked broadcasts, batch loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import new_dir, stage

BROADCAST_ROWS = 1_000_000
"""Rows of at most three numbers that a hinted broadcast may hold: some 32 MB."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: is the row's key among ``ids`` (one column)?

    The ids are broadcast only after counting them; above ``BROADCAST_ROWS`` the
    planner shuffles both sides. Both ways give the same rows.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("_flag_key")).where("_flag_key IS NOT NULL").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    joined = rows.join(wanted, rows[key] == F.col("_flag_key"), "left")
    return joined.withColumn(flag, F.col("_flag_key").isNotNull()).drop("_flag_key")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column holds about ``limit`` bytes at most; one row is never cut."""
    for batch in batches:
        text, start, size = batch.column(column), 0, 0
        sizes = pc.binary_length(text).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


def utf8_bytes(text: pa.Array):
    """A string column's bytes as one numpy array, with the offsets of its rows (nulls are empty)."""
    whole = pa.concat_arrays([pc.fill_null(text.cast(pa.large_string()), "")])
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Staged:
    """Tables in the shared folder that are dropped once later ones have been written from them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, label: str, df: DataFrame) -> DataFrame:
        path = new_dir(self.spark, label)
        back = stage(df, label, path)[0]
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if id(table) in self.paths:
                self._delete(self.paths.pop(id(table))[1])

    def drop_all(self, *paths: str) -> None:
        self.drop(*[table for table, _ in list(self.paths.values())])
        for path in paths:
            self._delete(path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
