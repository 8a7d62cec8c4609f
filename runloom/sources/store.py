"""The state tables at rest: Parquet with fixed schemas, a bucketed snapshot and the batches since.

A table is a folder of ``batch-*`` folders, one per append, ``snapshot-*`` folders made by
``compact``, and ``live-*`` files, the highest of which names the live snapshot and the batches it holds.
A batch counts once its writer has finished it (``_SUCCESS``), so a failed writer leaves nothing behind that is read;
a compaction that dies before it has written its ``live`` file changes nothing. Batches and old
snapshots are only ever dropped by ``vacuum``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.keyed import latest
from runloom.session import new_name
from runloom.sources.files import drop_path, list_names, path_exists, read_text_file, write_new_text_file

# Columns, keys and required columns of the state tables.
SCHEMAS = {
    "runs": "run_id string, dag_id string, state string, trigger string, created_at double, finished_at double, run_dir string",
    "task_instances": "run_id string, task_id string, state string, try_number bigint, started_at double, finished_at double, error string, result string",
    "schedules": "dag_id string, last_run_at double",
    "applied": "app_name string, revision string, synced_at double",
}
KEYS = {
    "runs": ["run_id"],
    "task_instances": ["run_id", "task_id"],
    "schedules": ["dag_id"],
    "applied": ["app_name"],
}
REQUIRED = {
    "runs": ["run_id", "dag_id", "state", "trigger", "created_at", "run_dir"],
    "task_instances": ["run_id", "task_id", "state", "try_number"],
    "schedules": ["dag_id", "last_run_at"],
    "applied": ["app_name", "revision", "synced_at"],
}
BUCKETS = 64  # folders of a snapshot, by the first key column


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name] + ", seq bigint")


def create_store(spark: SparkSession, base: str) -> None:
    """Creates the four tables that are not there yet."""
    for name in SCHEMAS:
        if not path_exists(spark, f"{base}/{name}"):
            spark.createDataFrame([], schema_of(name)).write.parquet(f"{base}/{name}/{new_name('batch')}")


def append(rows: DataFrame, base: str, name: str) -> None:
    """Appends row versions; ``seq`` orders the versions of a key."""
    schema = schema_of(name)
    cast = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema])
    missing = " OR ".join(f"{c} IS NULL" for c in REQUIRED[name])
    checked = cast.selectExpr(
        *cast.columns, f"CASE WHEN {missing} THEN raise_error('{name}: a required column is null') END AS _c"
    )
    checked.filter("_c IS NULL").drop("_c").write.parquet(f"{base}/{name}/{new_name('batch')}")


def _live(spark: SparkSession, path: str) -> tuple[int, str | None, list[str]]:
    """Number of the live file, the snapshot it names and the batches that are in it."""
    numbers = [int(n.split("-")[1]) for n in list_names(spark, path) if n.startswith("live-")]
    if not numbers:
        return 0, None, []
    told = json.loads(read_text_file(spark, f"{path}/live-{max(numbers)}"))
    return max(numbers), told["snapshot"], told["batches"]


def _finished(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in list_names(spark, path) if n.startswith("batch-") and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def _bucket(value):
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, base: str, name: str, only: Mapping[str, object] = {}) -> tuple[DataFrame, int, list[str]]:
    """Row versions of the live snapshot and the batches since, the live number, and all batches among them."""
    path, schema, first = f"{base}/{name}", schema_of(name), KEYS[name][0]
    number, snapshot, folded = _live(spark, path)
    batches = _finished(spark, path)
    since = [f"{path}/{b}" for b in batches if b not in set(folded)]
    rows = spark.read.schema(schema).parquet(*since) if since else spark.createDataFrame([], schema)
    if snapshot:
        held = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{snapshot}")
        if first in only:  # one folder of the snapshot; the number is worked out while the query is planned
            held = held.filter(F.col("bucket") == _bucket(F.lit(only[first]).cast(schema[first].dataType)))
        rows = rows.unionByName(held.drop("bucket"))
    for column, value in only.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows, number, sorted({*folded, *batches})


def read(spark: SparkSession, base: str, name: str, only: Mapping[str, object] = {}) -> DataFrame:
    """Newest version of each row, or of the rows whose key columns have the values in ``only``."""
    other = [c for c in only if c not in KEYS[name]]
    if other:
        raise ValueError(f"{', '.join(other)}: not a key of {name}")
    return latest(_versions(spark, base, name, only)[0], KEYS[name], ["seq"]).drop("seq")


def compact(spark: SparkSession, base: str, name: str) -> str:
    """Folds snapshot and batches into a new snapshot in ``BUCKETS`` folders, then makes it the live one.

    Batches that are appended meanwhile stay batches. Of two compactions at once the second fails at
    its ``live`` file, which exists already, and leaves the first one's snapshot live.
    """
    path = f"{base}/{name}"
    rows, number, batches = _versions(spark, base, name)
    snapshot = new_name("snapshot")
    folded = latest(rows, KEYS[name], ["seq"]).select(*schema_of(name).names).withColumn("bucket", _bucket(F.col(KEYS[name][0])))
    folded.hint("rebalance", "bucket").sortWithinPartitions("bucket", *KEYS[name]).write.partitionBy("bucket").parquet(f"{path}/{snapshot}")
    write_new_text_file(spark, f"{path}/live-{number + 1}", json.dumps({"snapshot": snapshot, "batches": batches}))
    return snapshot


def vacuum(spark: SparkSession, base: str, name: str) -> list[str]:
    """Drops what no reader can need any more: folded batches and superseded snapshots. Run it when no query reads."""
    path = f"{base}/{name}"
    _, snapshot, folded = _live(spark, path)
    gone = [n for n in list_names(spark, path) if n in set(folded) or (snapshot and n.startswith("snapshot-") and n != snapshot)]
    for n in gone:
        drop_path(spark, f"{path}/{n}")
    return gone
