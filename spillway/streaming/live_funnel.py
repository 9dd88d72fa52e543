"""A funnel that stays current while events arrive.

The stream keeps one small state row per (entity, stage).  A pair counts in the micro-batch in
which all its rows so far carry that batch's timestamp, which is the first batch that has it, so
repeated events are never counted twice (a batch takes longer than the clock's millisecond, so no
two batches carry the same timestamp).  Because this is an aggregation, Spark combines a batch's
repeats before the shuffle; a deduplication would ship every one of them.

Each batch stores the counts so far, at most one row per stage, under its batch id, on top of those
of the newest batch before it.  A batch that is run again after a failure replaces its own folder.
Folders other than the newest two are removed, so neither their number nor the work of reading the
funnel grows with time.

The pairs stay in the state for good, as exact distinct counts require; for a log with more of
them than executors have memory, they are kept on disk by Spark's RocksDB provider, which
:data:`spillway.session.RECOMMENDED` sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import StageLog, columns, name
from ..functions.ladder import StageLadder
from ..operators.volumes import funnel

_COUNTS = "stage_order INT, entities BIGINT"


def first_reached(log: StageLog) -> DataFrame:
    """Streaming rows ``entity, stage_order, first_batch, last_batch``; run in update mode."""
    return (
        log.rows()
        .selectExpr(
            name(log.entity),
            f"{log.ladder.order(log.stage_sql)} AS stage_order",
            "current_timestamp() AS batch_time",
        )
        .groupBy(log.entity, "stage_order")
        .agg(*columns(["min(batch_time) AS first_batch", "max(batch_time) AS last_batch"]))
    )


def start_live_funnel(
    log: StageLog, counts_folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Follow a streaming log.  ``trigger`` is what ``writeStream.trigger`` takes."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [b for b in _stored_batches(spark, counts_folder) if b < batch_id]
        counts = batch.where("first_batch = last_batch").groupBy("stage_order").agg(
            *columns(["count(1) AS entities"])
        )
        if done:
            counts = counts.unionByName(_counts_of(spark, counts_folder, done[-1]))
        (
            counts.groupBy("stage_order")
            .agg(*columns(["sum(entities) AS entities"]))
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(f"{counts_folder}/batch={batch_id}")
        )
        for old in done[:-1]:
            _folder(spark, f"{counts_folder}/batch={old}", "delete", True)

    writer = (
        first_reached(log)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def _folder(spark: SparkSession, path: str, action: str, *arguments):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return getattr(system, action)(place, *arguments)


def _stored_batches(spark: SparkSession, counts_folder: str) -> list[int]:
    """Ids of the batches whose counts are stored completely, in order."""
    if not _folder(spark, counts_folder, "exists"):
        return []
    names = [f.getPath().getName() for f in _folder(spark, counts_folder, "listStatus")]
    ids = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [b for b in ids if _folder(spark, f"{counts_folder}/batch={b}/_SUCCESS", "exists")]


def _counts_of(spark: SparkSession, counts_folder: str, batch: int) -> DataFrame:
    return spark.read.schema(_COUNTS).parquet(f"{counts_folder}/batch={batch}")


def live_counts(spark: SparkSession, counts_folder: str, ladder: StageLadder) -> DataFrame:
    """``stage_order, stage, reached`` as of the last finished batch."""
    stored = _stored_batches(spark, counts_folder)
    counts = (
        _counts_of(spark, counts_folder, stored[-1])
        if stored
        else spark.createDataFrame([], _COUNTS)
    )
    return counts.selectExpr(
        "stage_order", f"{ladder.name_at('stage_order')} AS stage", "entities AS reached"
    )


def live_funnel(spark: SparkSession, counts_folder: str, ladder: StageLadder) -> DataFrame:
    """The funnel of :func:`live_counts`."""
    return funnel(live_counts(spark, counts_folder, ladder))
