"""The store of task states: saved, loaded and deleted by id, with a log of changes that can be streamed.

A save writes its changes to the log first and publishes the states after it; readers of the log see the changes of published saves only, so
neither is ever there without the other. A state is replaced whole, the last save of an id wins, and of an id that one save names
twice the row with the greatest values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import kv
from .buckets import BucketStore

CHANGES = "task_id string, status string, current_stage string, progress int, error_message string, deleted boolean"


class TaskStates:
    def __init__(self, spark: SparkSession, path: str, columns: str = schema.TASKS, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = BucketStore(spark, f"{self.path}/states", columns, ("task_id",), buckets=buckets)

    def save(self, tasks: DataFrame) -> None:
        """Put the states of some tasks in the place of those that are stored."""
        fields = self.store.columns.names
        rows = tasks.filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.max(F.struct(*(F.col(c) for c in fields if c != "task_id"))).alias("t")).select("task_id", "t.*")
        self._log(rows.withColumn("deleted", F.lit(False)))
        self.store.replace(rows)

    def load(self, ids: DataFrame | None = None) -> DataFrame:
        """All states, or those of some tasks (task_id)."""
        return self.store.read() if ids is None else self.store.near(ids.select("task_id"))

    def delete(self, ids: DataFrame) -> None:
        known = self.store.near(ids.select("task_id")).select("task_id")
        self._log(known.withColumn("deleted", F.lit(True)))
        self.store.replace(self.store.read().limit(0), ids.select("task_id"))

    def clear(self) -> None:
        self._log(self.store.read().select("task_id").withColumn("deleted", F.lit(True)))
        self.store.overwrite(self.store.read().limit(0))

    def _log(self, rows: DataFrame) -> None:
        number = self.store.manifest()["number"] + 1
        names = {f.strip().split()[0]: f.strip().split()[1] for f in CHANGES.split(",")}
        given = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()]
        rows.select(*given).write.mode("overwrite").parquet(f"{self.path}/changes/number={number}")

    def changes(self, after: int = 0) -> DataFrame:
        """Changes of published saves after the given one: number, task_id, status, ..., deleted. In a save's order none is before another."""
        upto = self.store.manifest()["number"]
        fs, to_path = kv._files(self.spark, self.path)
        folders = [f"{self.path}/changes/number={n}" for n in range(after + 1, upto + 1) if fs.exists(to_path(f"{self.path}/changes/number={n}"))]
        if not folders:
            return self.spark.createDataFrame([], f"{CHANGES}, number int")
        return self.spark.read.schema(f"{CHANGES}, number int").option("basePath", f"{self.path}/changes").parquet(*folders)
