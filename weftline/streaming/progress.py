"""Progress of tasks from a stream of state events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import taskqueue
from ..operators.buckets import BucketStore

EVENTS = "doc_id string, seq bigint, stage string, current bigint, total bigint"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """The running state per document: a stateful aggregation whose state is one row per document."""
    return taskqueue.progress(events)


def run_to_table(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold each micro-batch into the progress table at ``path``; a repeated batch changes nothing.

    The table keeps for each document the number and value of the last stage and of the last known percent.
    """
    percent = taskqueue.percent(F.col("current"), F.col("total"))
    store = _store(events.sparkSession, path)

    def fold(batch: DataFrame, _: int) -> None:
        new = batch.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("seq", "stage")).alias("s"), F.max(F.when(percent.isNotNull(), F.struct("seq", percent.alias("progress")))).alias("p")).persist(StorageLevel.DISK_ONLY)
        try:  # the batch is folded once, however often the store reads it
            store.replace(new.unionByName(store.near(new)).groupBy("doc_id").agg(F.max("s").alias("s"), F.max("p").alias("p")))
        finally:
            new.unpersist()

    writer = events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _store(spark: SparkSession, path: str) -> BucketStore:
    """Progress in buckets of documents: a batch rewrites the buckets of its documents, and one that is lost has changed nothing."""
    return BucketStore(spark, path, "doc_id string, s struct<seq:bigint,stage:string>, p struct<seq:bigint,progress:int>", ("doc_id",))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, stage, progress)."""
    return _store(spark, path).read().select("doc_id", F.col("s.stage").alias("stage"), F.coalesce("p.progress", F.lit(0)).alias("progress"))


def watch(events: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Call a handler with each micro-batch; the trigger's interval merges bursts."""
    return events.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
