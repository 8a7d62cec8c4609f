"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it gets a scratch folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/runloom/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder; nothing is ever written twice to it."""
    return f"{work_dir(spark)}/{new_name(label)}"


def new_name(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that write in here drop their shuffle files as soon as they are over.

    Else these stay until the driver happens to collect its garbage, beside all that is written after.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, label: str = "stage", path: str | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder and read it back, with its row count.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    back, counts = stage_counted(df, {"rows": F.count(F.lit(1))}, label, path)
    return back, counts["rows"]


def stage_counted(
    df: DataFrame,
    counts: dict[str, Column],
    label: str = "stage",
    path: str | None = None,
    partition_by: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, int]]:
    """``stage`` with counts of its own, taken while the rows are written."""
    path = path or new_dir(df.sparkSession, label)
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    watched.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, whose size the planner knows.

    Rows given to ``createDataFrame`` as a list become an RDD of unknown size, which
    is never broadcast; an Arrow table does not.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(kind)
    columns = list(zip(*rows)) or [()] * len(kind)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
    return spark.createDataFrame(table, kind)


def small_table(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A table that should be tiny (one row per class), with its size known to the planner.

    Up to ``limit`` rows become a local relation; a larger table is staged instead.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return local_table(df.sparkSession, rows, df.schema)
    return stage(df)[0]
