"""Task logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.operators.keyed import input_bytes, latest, row_by_row
from runloom.session import drop_dir, new_dir, shuffles_dropped, stage


def list_log_files(spark: SparkSession, path: str, task_id: str | None = None, all_tries: bool = False) -> DataFrame:
    """``(file, length, run_dir, task_id, attempt)`` of logs named ``<task>.<try>.log``, from the listing alone.

    The newest try unless all are asked for; tries are compared as numbers, so try 10 is newer than try 9.
    Spark lists no file without a byte, so an empty log counts as none.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(path)
    name = F.substring_index("path", "/", -1)
    files = listed.select(
        F.col("path").alias("file"),
        "length",
        F.regexp_replace("path", r"/[^/]*$", "").alias("run_dir"),
        F.regexp_extract(name, r"^(.*)\.(\d+)\.log$", 1).alias("task_id"),
        F.regexp_extract(name, r"^(.*)\.(\d+)\.log$", 2).try_cast("bigint").alias("attempt"),
    )
    if task_id is not None:
        files = files.filter(F.col("task_id") == task_id)
    return files if all_tries else latest(files, ["run_dir", "task_id"], ["attempt"])


def read_log_files(spark: SparkSession, path: str, task_id: str | None = None, all_tries: bool = False) -> DataFrame:
    """Whole texts of the logs that ``list_log_files`` chooses; other files are not opened.

    The chosen paths are on the driver, as the listing of any scan is.
    """
    chosen = list_log_files(spark, path, task_id, all_tries).select("file", "run_dir", "task_id", "attempt")
    paths = [r["file"] for r in chosen.select("file").collect()]
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log")
    texts = texts.filter(F.col("_metadata.file_path").isin(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return chosen.join(texts, "file").select("run_dir", "task_id", "attempt", "text")


def require_logs(logs: DataFrame, task_id: str) -> DataFrame:
    if logs.isEmpty():
        raise FileNotFoundError(f"no logs for task {task_id!r}")
    return logs


BUCKETS = 256  # folders of a log table, whatever the number of runs
ROUND_BYTES = 64 << 20  # of what is read for a log table; one that reads more is written in several rounds
MOST_ROUNDS = 8


def _bucket():
    return F.pmod(F.xxhash64("run_id", "task_id"), F.lit(BUCKETS)).cast("int")


def write_log_lines(lines: DataFrame, path: str) -> None:
    """``(run_id, task_id, attempt, line)`` as a table in ``BUCKETS`` folders, the lines of a task together.

    Beside it goes, last, an index: which attempts a task of a run has. A large table is written a part of the folders
    at a time, so that only a part of the lines is being shuffled. Lines that cannot be had in parts are worked out once.
    """
    spark = lines.sparkSession
    rounds = max(1, min(MOST_ROUNDS, -(-input_bytes(lines) // ROUND_BYTES)))
    bucket, copy = F.col("bucket"), None
    with shuffles_dropped(spark):
        if rounds > 1 and not in_parts(lines.where(_bucket() == 0)):
            copy = new_dir(spark, "unsorted")
            lines = stage(lines, "unsorted", copy)[0]
        dealt = lines.withColumn("bucket", _bucket())
        for i in range(rounds):
            part = dealt.where(bucket % rounds == i) if rounds > 1 else dealt
            together = part.hint("rebalance", "bucket").sortWithinPartitions("bucket", "run_id", "task_id", "attempt")
            together.write.mode("append" if i else "error").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/lines")
        if copy:
            drop_dir(spark, copy)
        written = spark.read.schema(dealt.schema).parquet(f"{path}/lines")
        written.select("run_id", "task_id", "attempt").distinct().write.parquet(f"{path}/attempts")


def in_parts(filtered: DataFrame) -> bool:
    """Does the filter on top of a plan, by a hash of keys, reach every table that the plan reads?"""

    def narrowed(plan) -> bool:
        if plan.nodeName() == "Filter" and "xxhash64" in plan.condition().toString():
            return row_by_row(plan)
        below = plan.children()
        return not below.isEmpty() and all(narrowed(below.apply(i)) for i in range(below.size()))

    return narrowed(filtered._jdf.queryExecution().optimizedPlan())


def read_log_lines(spark: SparkSession, path: str, all_tries: bool = False, run_id: object = None, task_id: str | None = None) -> DataFrame:
    """Log lines of the newest attempt of each task of each run (or of one run, one task).

    The newest attempt comes from the index, so texts are read once; files are sorted,
    and what is asked of one run or task is pushed to the scan.
    """
    lines, index = spark.read.parquet(f"{path}/lines").drop("bucket"), spark.read.parquet(f"{path}/attempts")
    for name, value in (("run_id", run_id), ("task_id", task_id)):
        if value is not None:
            lines, index = lines.where(F.col(name) == value), index.where(F.col(name) == value)
    if all_tries:
        return lines
    newest = index.groupBy("run_id", "task_id").agg(F.max("attempt").alias("attempt"))
    return _no_older(lines, newest, ["run_id", "task_id"])


def _no_older(lines: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of the attempts in ``newest``, none of which is older than it; by the keys that ``newest`` is already dealt by."""
    last = newest.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("attempt").alias("_newest"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return lines.join(last, [*same, F.col("attempt") >= F.col("_newest")], "left_semi")


def find_log_lines(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The newest log of each asked ``(run_id, task_id)``, line by line, or a row that says there is none.

    ``(run_id, task_id, attempt, line, problem)``: attempt and line are null where a problem is named. The folders that hold none
    of the asked tasks are not read (partition filter at run time).
    """
    keys = ["bucket", "run_id", "task_id"]  # one dealing of each table serves the folds and both joins
    wanted = asked.select(_bucket().alias("bucket"), "run_id", "task_id").distinct()
    index = spark.read.parquet(f"{path}/attempts").withColumn("bucket", _bucket())
    known = wanted.join(index.groupBy(*keys).agg(F.max("attempt").alias("attempt")), keys, "left")
    lines = spark.read.parquet(f"{path}/lines")
    kinds = dict(lines.dtypes)
    found = _no_older(lines, known.filter(F.col("attempt").isNotNull()), keys)
    missing = known.filter(F.col("attempt").isNull()).select(
        "run_id", "task_id", "attempt", F.lit(None).cast(kinds["line"]).alias("line"), F.format_string(fixed.NO_LOGS, "task_id", F.col("run_id").cast("string")).alias("problem")
    )
    return found.select("run_id", "task_id", "attempt", "line", F.lit(None).cast("string").alias("problem")).unionByName(missing)
