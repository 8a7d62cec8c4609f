"""The state and scoring jobs on a stream.

Every sink writes one folder per micro-batch (``batch_id=N``, overwritten on
replay), so a restarted query never counts a batch twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runloom.functions import fixed
from runloom.operators.keyed import latest
from runloom.operators.learn import predict
from runloom.operators.state import advance_by, app_outcomes
from runloom.sources.files import drop_path, list_names, path_exists
from runloom.sources.traces import write_scored


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """One table of a folder as a stream of new files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there and stops; call again with the same checkpoint for more."""
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score(
    rows: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    classes: Sequence[str],
    out: str,
    checkpoint: str,
    model_uri: str,
    trace: bool = True,
) -> StreamingQuery:
    """Scores a feed: predictions below ``out/predictions``, traces below ``out/traces``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        traces = f"{out}/traces/batch_id={batch_id}" if trace else None
        scored = predict(model, batch, features, classes)
        write_scored(scored, f"{out}/predictions/batch_id={batch_id}", model_uri, list(features), traces)

    return start(rows, sink, checkpoint)


def current_state(changes: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Newest change per key by ``seq``; a late change with a lower number loses."""
    rest = [c for c in changes.columns if c not in keys]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


FAN = 8  # state folders of one level that are folded into one of the next


def track_state(changes: DataFrame, keys: Sequence[str], seq: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the newest change per key of each batch; ``read_state`` folds them by ``seq``.

    Nothing is kept in the query's own state, so closed runs cost nothing and a late change simply loses to the higher
    number. Every ``FAN`` batches are folded into one folder, every ``FAN`` of those into one of the next level, and so on:
    a batch costs its own rows, plus each row once more per level, however long the stream runs.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        _add_level(batch, keys, seq, out, batch_id)

    return start(changes, sink, checkpoint)


def _add_level(batch: DataFrame, keys: Sequence[str], seq: str, out: str, batch_id: int) -> None:
    """The newest change per key of a batch as a folder, and what is due to be folded into higher levels."""
    current_state(batch, keys, seq).write.mode("overwrite").parquet(f"{out}/level=0/upto={batch_id}")
    level = 0
    while (batch_id + 1) % FAN ** (level + 1) == 0:
        parts = [f"{out}/level={level}/upto={batch_id - i * FAN**level}" for i in range(FAN)]
        rows = batch.sparkSession.read.schema(batch.schema).parquet(*parts)
        current_state(rows, keys, seq).write.mode("overwrite").parquet(f"{out}/level={level + 1}/upto={batch_id}")
        level += 1


def _folders(newest: int) -> list[tuple[int, int]]:
    """The fewest (level, upto) folders that hold the batches 0 to ``newest``."""
    level = 0
    while FAN ** (level + 1) <= newest + 1:
        level += 1
    found, start_at = [], 0
    while start_at <= newest:
        if start_at + FAN**level <= newest + 1:
            start_at += FAN**level
            found.append((level, start_at - 1))
        else:
            level -= 1
    return found


def read_state(spark: SparkSession, out: str, schema: T.StructType, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Newest change per key over all batches; at most ``FAN`` - 1 folders of each level are read."""
    batches = [int(n.split("=")[1]) for n in list_names(spark, f"{out}/level=0") if n.startswith("upto=")]
    if not batches:
        return spark.createDataFrame([], schema)
    return latest(_read_levels(spark, out, schema, max(batches)), keys, [seq]).select(*schema.names)


def _read_levels(spark: SparkSession, out: str, schema: T.StructType, newest: int) -> DataFrame:
    """What the folders of the batches up to ``newest`` hold."""
    parts = [f"{out}/level={level}/upto={upto}" for level, upto in _folders(newest)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _fold(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, keys: list[str], seq: str) -> DataFrame:
    """Writes the newest row per key of the batch before and of ``rows`` as this batch's state.

    The state before stays for a replay of this batch, the one before that goes.
    """
    before = f"{path}/batch_id={batch_id - 1}"
    if path_exists(spark, before):
        rows = spark.read.schema(rows.schema).parquet(before).unionByName(rows)
    here = f"{path}/batch_id={batch_id}"
    latest(rows, keys, [seq]).select(*rows.columns).write.mode("overwrite").parquet(here)
    drop_path(spark, f"{path}/batch_id={batch_id - 2}")
    return spark.read.schema(rows.schema).parquet(here)


def track_outcomes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Per application how many runs it has and how many of them have not succeeded, kept up to date from run changes.

    ``changes(app_name, run_id, state, seq)``: the highest ``seq`` of a run counts, so late and repeated
    changes move nothing; those without an application, run_id or seq are ignored, as a null state is by the batch job. A batch looks its own runs up among those
    seen, and folds what they change into the counts of the batch before: a row per application, whatever
    the number of its runs. A batch that is replayed starts from the same counts.
    """
    keys = ["app_name", "run_id"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, "state", "seq").filter("app_name IS NOT NULL AND run_id IS NOT NULL AND seq IS NOT NULL")
        _add_level(rows, keys, "seq", f"{out}/runs", batch_id)
        new = spark.read.schema(rows.schema).parquet(f"{out}/runs/level=0/upto={batch_id}")
        old = _read_levels(spark, f"{out}/runs", rows.schema, batch_id - 1).join(new.select(*keys), keys, "left_semi")
        held = current_state(old, keys, "seq").select(*keys, F.col("state").alias("was"), F.col("seq").alias("was_seq"))
        unseen = F.col("was_seq").isNull()
        moved = new.join(held, keys, "left").filter(unseen | (F.col("seq") > F.col("was_seq")))
        failing = lambda state: F.coalesce((F.col(state) != fixed.SUCCESS).cast("long"), F.lit(0))
        change = moved.select(
            "app_name", unseen.cast("long").alias("n"), (failing("state") - F.when(unseen, 0).otherwise(failing("was"))).alias("n_open")
        )
        before = f"{out}/outcomes/batch_id={batch_id - 1}"
        if path_exists(spark, before):
            change = change.unionByName(spark.read.schema(change.schema).parquet(before))
        counts = change.groupBy("app_name").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"))
        counts.write.mode("overwrite").parquet(f"{out}/outcomes/batch_id={batch_id}")
        drop_path(spark, f"{out}/outcomes/batch_id={batch_id - 2}")

    return start(changes, sink, checkpoint)


def read_outcomes(spark: SparkSession, out: str, app_name: T.DataType) -> DataFrame:
    """(app_name, ok, n) after the newest whole batch of ``track_outcomes``; no rows before the first."""
    schema = T.StructType([T.StructField("app_name", app_name), T.StructField("n", T.LongType()), T.StructField("n_open", T.LongType())])
    names = [n for n in list_names(spark, f"{out}/outcomes") if n.startswith("batch_id=")]
    whole = [int(n.split("=")[1]) for n in names if path_exists(spark, f"{out}/outcomes/{n}/_SUCCESS")]
    if not whole:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).parquet(f"{out}/outcomes/batch_id={max(whole)}")
    return rows.select("app_name", (F.col("n_open") == 0).alias("ok"), "n")


def flag_stuck(
    changes: DataFrame, older_than: float, out: str, checkpoint: str, keys: Sequence[str] = ("run_id",)
) -> StreamingQuery:
    """Runs that are still running ``older_than`` seconds after their last change.

    ``changes(run_id, state, seq, changed_at)``; the clock is the newest time seen.
    Each batch folds its changes into the state of the one before, so its cost follows
    the number of keys and not that of the batches.
    """
    keys = list(keys)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now_state = _fold(spark, f"{out}/state", batch, batch_id, keys, "seq")
        now = now_state.agg(F.max("changed_at").alias("now")).first()["now"]
        stuck = now_state.filter((F.col("state") == fixed.RUNNING) & (F.lit(now) - F.col("changed_at") > older_than))
        stuck.withColumn("stuck_for", F.lit(now) - F.col("changed_at")).write.mode("overwrite").parquet(
            f"{out}/stuck/batch_id={batch_id}"
        )

    return start(changes, sink, checkpoint)


def read_stuck(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Stuck runs as of the newest micro-batch; none when that batch found none."""
    batch = T.StructField("batch_id", T.LongType())
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("stuck_for", T.LongType()), batch]))
    state = spark.read.schema(T.StructType([*schema.fields, batch])).parquet(f"{out}/state")
    newest = state.agg(F.max("batch_id").alias("batch_id"))
    return rows.parquet(f"{out}/stuck").join(newest, "batch_id", "left_semi").drop("batch_id")


def reconcile(
    desired: DataFrame,
    applied: DataFrame,
    app_runs: DataFrame | None,
    out: str,
    checkpoint: str,
    only: DataFrame | None = None,
    seq: str | None = None,
    outcomes: str | None = None,
) -> StreamingQuery:
    """Emits an application whenever desired differs from applied, once per change.

    ``desired(app_name, dag_id, desired)`` is the stream, ``applied(app_name,
    revision)`` where things stood at the start; of several changes to one
    application in a batch the newest by ``seq`` counts.  Each batch folds its moves into the
    applied table of the one before.  ``app_name`` may be of any type.
    Run outcomes come from the table ``app_runs``, folded anew for every batch, or from the folder ``outcomes``
    that ``track_outcomes`` keeps up to date (then ``only`` has no say: let the tracked changes be those wanted).
    """
    if (app_runs is None) == (outcomes is None):
        raise ValueError("either app_runs or outcomes must be given")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = applied.select("app_name", "revision", F.lit(-1).cast("bigint").alias("moved_in"))
        before = f"{out}/applied/batch_id={batch_id - 1}"
        if path_exists(spark, before):
            base = base.unionByName(spark.read.schema(base.schema).parquet(before))
        stands = latest(base, ["app_name"], ["moved_in"]).select("app_name", F.col("revision").alias("applied"))
        wanted = batch if seq is None else latest(batch, ["app_name"], [seq])
        status = wanted.join(stands, "app_name", "left")
        told = app_outcomes(app_runs, only) if outcomes is None else read_outcomes(spark, outcomes, batch.schema["app_name"].dataType)
        acted = advance_by(status, told).filter("action <> 'none'")
        acted.write.mode("overwrite").parquet(f"{out}/actions/batch_id={batch_id}")
        done = spark.read.schema(acted.schema).parquet(f"{out}/actions/batch_id={batch_id}")
        moves = done.filter("action = 'synced'").select(
            "app_name", F.col("applied").alias("revision"), F.lit(batch_id).cast("bigint").alias("moved_in")
        )
        _fold(spark, f"{out}/applied", moves, batch_id, ["app_name"], "moved_in")

    return start(desired, sink, checkpoint)
