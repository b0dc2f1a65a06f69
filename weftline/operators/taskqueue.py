"""The task queue as a fold over its log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import numbered

PENDING, PROCESSING, COMPLETED, FAILED = "Pending", "Processing", "Completed", "Failed"
#: Stages in which a document's progress follows its task (fixed values).
PROGRESS_STAGES = ("ProcessingChunks", "MergingEntities", "MergingRelations")
MAX_RETRIES = 3


def next_task(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The pending task of lowest priority number, the oldest of them; or the first n."""
    return tasks.filter(F.col("status") == PENDING).orderBy("priority", "created_at", "task_id").limit(n)


def list_tasks(tasks: DataFrame) -> DataFrame:
    """All tasks with their place in the queue."""
    return numbered(tasks, "priority", "created_at", "task_id")


def recover(tasks: DataFrame) -> DataFrame:
    """After a restart: running tasks wait again."""
    running = F.col("status") == PROCESSING
    out = tasks.withColumn("status", F.when(running, PENDING).otherwise(F.col("status")))
    return out.withColumn("started_at", F.when(running, F.lit(None).cast("timestamp")).otherwise(F.col("started_at"))) if "started_at" in tasks.columns else out


def update(tasks: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """tasks after changes (task_id, status, error), one row a task: their status, times and error."""
    at, new = F.lit(now).cast("timestamp"), F.col("__s")
    out = tasks.join(changes.select("task_id", F.col("status").alias("__s"), F.col("error").alias("__e")), "task_id", "left")
    own = new.isNotNull()
    return out.withColumns({
        "status": F.coalesce(new, "status"),
        "progress": F.when(new == COMPLETED, 100).when(own, 0).otherwise(F.col("progress")),
        "started_at": F.when(new == PROCESSING, at).otherwise(F.col("started_at")),
        "completed_at": F.when(new.isin(COMPLETED, FAILED), at).otherwise(F.col("completed_at")),
        "error_message": F.when(own, F.col("__e")).otherwise(F.col("error_message")),
    }).select(tasks.columns)


def _step(s: Column, e: Column) -> Column:
    """The state after an event. Events that are not allowed in a state change nothing; terminal tasks stay, so that retries find them."""
    status, op = s["status"], e["op"]
    idle = status.isNull()
    fresh = (op == "enqueue") & (idle | (status == "Deleted"))
    start, done, fail = (op == "start") & (status == PENDING), (op == "complete") & (status == PROCESSING), (op == "fail") & (status == PROCESSING)
    retry = (op == "retry") & (status == FAILED) & (s["retries"] < MAX_RETRIES)
    drop = (op == "delete") & ~idle & (status != PROCESSING)
    stop = (op == "stop") & status.isin(PENDING, PROCESSING)
    new = F.when(fresh | retry, PENDING).when(start, PROCESSING).when(done, COMPLETED).when(fail | stop, FAILED).when(drop, "Deleted").otherwise(status)
    progress = F.when(fresh | retry, 0).when(done, 100).when((op == "progress") & (status == PROCESSING), F.greatest(F.lit(0), F.least(F.lit(100), e["arg"]))).otherwise(s["progress"])
    priority = F.when(fresh, e["arg"]).when((op == "reorder") & ~idle, e["arg"]).otherwise(s["priority"])
    retries = F.when(fresh, 0).when(retry, s["retries"] + 1).otherwise(s["retries"])
    return F.struct(new.alias("status"), progress.cast("int").alias("progress"), priority.cast("int").alias("priority"), retries.cast("int").alias("retries"))


def fold_events(events: DataFrame) -> DataFrame:
    """events (task_id, seq, op, arg int) -> (task_id, status, progress, priority, retries). A task's log is its own small group."""
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("progress"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("int").alias("retries"))
    logs = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "arg"))).alias("log"))
    return logs.select("task_id", F.aggregate("log", start, _step).alias("s")).select("task_id", "s.*").filter("status IS NOT NULL")


def percent(current: Column, total: Column) -> Column:
    """Whole percent, 0 to 100; null where the total is 0."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), (current * 100.0 / total).cast("int"))))


def progress(events: DataFrame) -> DataFrame:
    """State events (doc_id, seq, stage, current, total) -> (doc_id, stage, progress): the last stage, the last known percent."""
    p = percent(F.col("current"), F.col("total"))
    return events.groupBy("doc_id").agg(F.max_by("stage", "seq").alias("stage"), F.coalesce(F.max_by(p, F.when(p.isNotNull(), F.col("seq"))), F.lit(0)).alias("progress"))


def apply_status(documents: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Documents (id, rag_status, rag_progress, is_in_rag_system, rag_added_time, ...) after their tasks (document_id, status, stage, progress)."""
    t = tasks.select(F.col("document_id").alias("id"), F.col("status").alias("__s"), F.col("current_stage").alias("__g"), F.col("progress").alias("__p"))
    out = documents.join(t, "id", "left")
    finished = F.coalesce(F.col("__s") == COMPLETED, F.lit(False))
    out = out.withColumns({
        "rag_status": F.coalesce("__s", "rag_status"),
        "rag_progress": F.when(F.col("__g").isin(*PROGRESS_STAGES), F.col("__p")).otherwise(F.col("rag_progress")),
        "is_in_rag_system": F.col("is_in_rag_system") | finished,
        "rag_added_time": F.when(finished, now).otherwise(F.col("rag_added_time")),
    })
    return out.drop("__s", "__g", "__p")
