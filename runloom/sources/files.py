"""File sources and sinks of a training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.keyed import key_hash
from runloom.session import new_name

RUN_BUCKETS = 64


def scan_features(spark: SparkSession, path: str, label: str = "target") -> tuple[DataFrame, list[str]]:
    """A labelled numeric table and its feature names in order."""
    rows = spark.read.parquet(path)
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    return rows, numeric


def write_split(rows: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Train and test rows of a run below ``run_id=.../split=...``; other runs stay."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", "true")
        .partitionBy("run_id", "split")
        .format(fmt)
        .save(path)
    )


def read_split(spark: SparkSession, path: str, schema: T.StructType, run_id: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split back; only its folder is listed and read, types come from ``schema``."""
    full = T.StructType([f for f in schema if f.name not in ("run_id", "split")])
    full = full.add("run_id", "string").add("split", "string")
    rows = spark.read.schema(full).option("header", "true").format(fmt).load(path)
    return rows.filter((F.col("run_id") == run_id) & (F.col("split") == split)).drop("run_id", "split")


def write_runs(rows: DataFrame, path: str, buckets: int = RUN_BUCKETS) -> None:
    """Writes outputs of many runs; a run replaces its own rows and no others.

    The rows go to a folder of their own (``data/write=N``, runs by ``run_bucket``), the runs they belong to into a
    manifest, and then ``live-N``, which only one writer can create, makes both count: a reader sees all of a
    write or nothing of it, and rows of other runs are neither read nor written. What a run's former write holds stays until
    ``vacuum_runs``. A second writer at the same time fails and can be run again.
    """
    spark = rows.sparkSession
    number = _live_number(spark, path) + 1
    label = new_name(f"{number}")
    bucket = F.pmod(key_hash(["run_id"]), F.lit(buckets)).cast("int")
    (
        rows.withColumn("run_bucket", bucket)
        .hint("rebalance", "run_bucket")  # one file per bucket, several for a large one
        .sortWithinPartitions("run_bucket", "run_id")
        .write.partitionBy("run_bucket")
        .parquet(f"{path}/data/write={label}")
    )
    written = spark.read.schema(_with_places(rows.schema)).parquet(f"{path}/data/write={label}")
    written.select("run_id").distinct().write.parquet(f"{path}/manifest/write={label}")
    write_new_text_file(spark, f"{path}/live-{number}", label)


def _with_places(schema: T.StructType) -> T.StructType:
    plain = [f for f in schema if f.name not in ("run_bucket", "write")]
    return T.StructType([*plain, T.StructField("write", T.StringType()), T.StructField("run_bucket", T.IntegerType())])


def _live_number(spark: SparkSession, path: str) -> int:
    return max([int(n.split("-")[1]) for n in list_names(spark, path) if n.startswith("live-")], default=0)


def _live_writes(spark: SparkSession, path: str) -> list[str]:
    """Labels of the writes that count, oldest first."""
    numbers = sorted(int(n.split("-")[1]) for n in list_names(spark, path) if n.startswith("live-"))
    if not numbers:
        return []
    labels = {int(r["value"].split("-")[0]): r["value"] for r in spark.read.text([f"{path}/live-{n}" for n in numbers]).collect()}
    return [labels[n] for n in numbers]


def _current(spark: SparkSession, path: str, run_type: T.DataType) -> DataFrame:
    """The write that holds each run: ``(run_id, write)``."""
    schema = T.StructType([T.StructField("run_id", run_type), T.StructField("write", T.StringType())])
    live = _live_writes(spark, path)
    if not live:
        return spark.createDataFrame([], schema)
    number = F.substring_index("write", "-", 1).cast("bigint")
    named = spark.read.schema(schema).parquet(f"{path}/manifest").filter(F.col("write").isin(live))
    return named.groupBy("run_id").agg(F.max_by("write", number).alias("write"))


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of every run's newest write; with ``run_bucket``, the folder they are in."""
    full = _with_places(schema)
    now = _current(spark, path, schema["run_id"].dataType)
    if not path_exists(spark, f"{path}/data"):
        return spark.createDataFrame([], full).drop("write")
    return spark.read.schema(full).parquet(f"{path}/data").join(now, ["run_id", "write"], "left_semi").drop("write")


def vacuum_runs(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Drops the data of writes that hold no run any more, and of writers that died. Run it when no query reads or writes."""
    used = {r["write"] for r in _current(spark, path, schema["run_id"].dataType).select("write").distinct().collect()}
    gone = [n for n in list_names(spark, f"{path}/data") if n.removeprefix("write=") not in used]
    for n in gone:
        drop_path(spark, f"{path}/data/{n}")
    return gone


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes one folder that its writer has replaced; nothing if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def write_new_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet; the file system refuses a second one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_scale(spark: SparkSession, path: str) -> DataFrame:
    """Integers of a text file, one per line, doubled."""
    lines = spark.read.text(path)
    return lines.select((F.trim("value").try_cast("bigint") * 2).alias("value"))
