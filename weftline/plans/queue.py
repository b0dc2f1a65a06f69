"""Queries of the task queue and the document table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, documents, taskqueue
from ..operators.chats import ChatHistory
from ..operators.taskstates import TaskStates
from ..session import shared_folder
from ..streaming import progress, tasks
from .views import Data, register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


@query("SELECT task_id, priority, created_at FROM {tasks} WHERE status = 'Pending' ORDER BY priority, created_at, task_id LIMIT 1")
def queue_next(d: Data) -> DataFrame:
    return taskqueue.next_task(d.tasks).select("task_id", "priority", "created_at")


@query("SELECT task_id, priority, CAST(row_number() OVER (ORDER BY priority, created_at, task_id) - 1 AS INT) AS pos FROM {tasks}")
def queue_list(d: Data) -> DataFrame:
    return taskqueue.list_tasks(d.tasks).select("task_id", "priority", "pos")


_FOLD = """WITH RECURSIVE e AS (SELECT task_id, op, arg, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM {task_log}),
s(task_id, n, status, progress, priority, retries) AS (
 SELECT DISTINCT task_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT) FROM e
 UNION ALL SELECT s.task_id, e.n,
  CASE WHEN op = 'enqueue' AND status IS NULL OR op = 'retry' AND status = 'Failed' AND retries < 3 THEN 'Pending' WHEN op = 'start' AND status = 'Pending' THEN 'Processing' WHEN op = 'complete' AND status = 'Processing' THEN 'Completed'
       WHEN op = 'fail' AND status = 'Processing' OR op = 'stop' AND status IN ('Pending', 'Processing') THEN 'Failed' ELSE status END,
  CASE WHEN op = 'enqueue' AND status IS NULL OR op = 'retry' AND status = 'Failed' AND retries < 3 THEN 0 WHEN op = 'complete' AND status = 'Processing' THEN 100 WHEN op = 'progress' AND status = 'Processing' THEN greatest(0, least(100, arg)) ELSE progress END,
  CASE WHEN op = 'enqueue' AND status IS NULL OR op = 'reorder' AND status IS NOT NULL THEN arg ELSE priority END,
  CASE WHEN op = 'enqueue' AND status IS NULL THEN 0 WHEN op = 'retry' AND status = 'Failed' AND retries < 3 THEN retries + 1 ELSE retries END
 FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1)
SELECT task_id, status, progress, priority, retries FROM s WHERE n = (SELECT max(n) FROM e WHERE e.task_id = s.task_id) AND status IS NOT NULL"""


@query(_FOLD)
def queue_state_fold(d: Data) -> DataFrame:
    return taskqueue.fold_events(d.task_log)


@query(_FOLD)
def queue_state_stream(d: Data) -> DataFrame:
    """The same states from a stream whose micro-batches bring each task's events in any order, kept in state per task."""
    run = f"{shared_folder(d.spark)}/weftline-tasks-{uuid.uuid4().hex}"
    log = d.task_log
    log.repartition(4, F.xxhash64("seq")).write.parquet(f"{run}/events")
    events = progress.read_events(d.spark, f"{run}/events", log.schema, 2)
    tasks.run_to_table(tasks.states(events), f"{run}/table", f"{run}/checkpoint").awaitTermination()
    return tasks.read_states(d.spark, f"{run}/table")


@query("SELECT task_id, CASE WHEN status = 'Processing' THEN 'Pending' ELSE status END AS status FROM {tasks}")
def queue_recover(d: Data) -> DataFrame:
    return taskqueue.recover(d.tasks).select("task_id", "status")


_PROGRESS = """WITH p AS (SELECT *, CASE WHEN total > 0 THEN greatest(0, least(100, CAST(trunc(current * 100.0::DOUBLE / total) AS INT))) END AS pct FROM {state_events})
SELECT doc_id, arg_max(stage, seq) AS stage, CAST(coalesce(arg_max(pct, seq) FILTER (pct IS NOT NULL), 0) AS INT) AS progress FROM p GROUP BY doc_id"""


@query(_PROGRESS)
def task_progress(d: Data) -> DataFrame:
    return taskqueue.progress(d.state_events)


@query(_PROGRESS)
def task_progress_stream(d: Data) -> DataFrame:
    """The same fold over a stream of the events' file, run until it is read."""
    spark = d.spark
    run = f"{shared_folder(spark)}/weftline-progress-{uuid.uuid4().hex}"
    source = f"{run}/events"
    d.state_events.repartition(4).write.parquet(source)
    events = progress.read_events(spark, source, d.state_events.schema, 1)
    job = progress.run_to_table(events, f"{run}/table", f"{run}/checkpoint")
    job.awaitTermination()
    return progress.read_progress(spark, f"{run}/table")


@query("""WITH t AS (SELECT document_id, max(status) AS status, max(current_stage) AS current_stage, max(progress) AS progress FROM {live} GROUP BY document_id)
SELECT m.id, coalesce(t.status, rag_status) AS rag_status, CASE WHEN t.current_stage = 'MergingEntities' THEN t.progress ELSE rag_progress END AS rag_progress, is_in_rag_system OR coalesce(t.status = 'Completed', FALSE) AS is_in_rag_system
FROM {markdown} m LEFT JOIN t ON t.document_id = m.id""")
def task_status_apply(d: Data) -> DataFrame:
    docs = d.markdown.withColumn("rag_added_time", F.lit(None).cast("timestamp"))
    tasks = d.live.groupBy("document_id").agg(*(F.max(c).alias(c) for c in ("status", "current_stage", "progress")))
    out = taskqueue.apply_status(docs, tasks, F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", "rag_status", "rag_progress", "is_in_rag_system")


@query("""SELECT m.id, CASE WHEN rag_status IN ('Pending', 'Processing') THEN coalesce(t.status, rag_status) ELSE rag_status END AS rag_status, CASE WHEN rag_status IN ('Pending', 'Processing') THEN coalesce(t.progress, rag_progress) ELSE rag_progress END AS rag_progress,
(SELECT count(*) FROM {markdown}) AS total, CAST(ceil((SELECT count(*) FROM {markdown}) / 25) AS BIGINT) AS pages
FROM (SELECT * FROM {markdown} ORDER BY CASE rag_status WHEN 'Processing' THEN 0 WHEN 'Pending' THEN 1 WHEN 'Failed' THEN 2 ELSE 3 END, upload_time DESC, id LIMIT 25 OFFSET 50) m LEFT JOIN {live} t ON t.document_id = m.id""")
def docs_paged(d: Data) -> DataFrame:
    rows, totals = documents.page(d.markdown, 3, 25, d.live)
    total = totals.first()
    return rows.select("id", "rag_status", "rag_progress", F.lit(total["total"]).alias("total"), F.lit(total["pages"]).alias("pages"))


_FILES = "SELECT doc_id AS seq, 'f' || CAST(doc_id % 900 AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.MD' ELSE '.markdown' END AS file_name, text FROM {documents}"


@query(f"""WITH f AS (SELECT *, octet_length(encode(text)) AS file_size, sha256(text) AS file_hash, CASE WHEN NOT regexp_matches(lower(file_name), '\\.(md|markdown)$') THEN 'type' WHEN octet_length(encode(text)) > 30000 THEN 'size' WHEN text = '' THEN 'empty' END AS bad FROM ({_FILES}) x),
n AS (SELECT *, row_number() OVER (PARTITION BY file_name, bad IS NULL ORDER BY seq) > 1 AS again FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY file_hash, bad IS NULL AND NOT again ORDER BY seq) > 1 AS same FROM n)
SELECT seq, file_size, file_hash, coalesce(bad, CASE WHEN again THEN 'name exists' WHEN same THEN 'content exists' END) AS reason FROM h""")
def doc_upload_validate(d: Data) -> DataFrame:
    files = d.spark.sql(_FILES, documents=d.documents).withColumn("content", F.encode("text", "UTF-8")).drop("text")
    return documents.validate_uploads(files, None, 30000).select("seq", "file_size", "file_hash", "reason")


@query("""SELECT seq, '{"type":"text_chunk","content":"' || replace(text, '"', '\\"') || '"}' AS data FROM {answers} WHERE text <> '' UNION ALL SELECT max(seq) + 1, '{"type":"done"}' FROM {answers}""")
def sse_events(d: Data) -> DataFrame:
    return context.sse_events(d.answers.withColumn("error", F.lit(None).cast("string")))


@query("SELECT md5(string_agg(text, '' ORDER BY seq)) AS answer FROM {answers}")
def sse_fold(d: Data) -> DataFrame:
    events = context.sse_events(d.answers.withColumn("error", F.lit(None).cast("string")))
    return context.fold_sse(events).select(F.md5("answer").alias("answer"))


@query("""SELECT seq, '{"type":"error","message":"step ' || CAST(seq AS VARCHAR) || '"}' AS data FROM {answers} WHERE seq % 7 = 3
UNION ALL SELECT seq, '{"type":"text_chunk","content":"' || replace(text, '"', '\\"') || '"}' FROM {answers} WHERE text <> '' AND seq % 7 <> 3 UNION ALL SELECT max(seq) + 1, '{"type":"done"}' FROM {answers}""")
def sse_errors(d: Data) -> DataFrame:
    """Pieces with an error become error events, blank or not."""
    return context.sse_events(d.answers.withColumn("error", F.when(F.col("seq") % 7 == 3, F.concat(F.lit("step "), F.col("seq").cast("string")))))


_STATES = "task_id string, document_id int, status string, current_stage string, progress int, priority int, created_at timestamp"
_FAILED = "current_stage = 'Persisting' AND status = 'Processing'"


@query(f"""SELECT task_id, CASE WHEN {_FAILED} THEN 'Failed' ELSE status END AS status, current_stage, CASE WHEN {_FAILED} THEN 0 ELSE progress END AS progress
FROM {{tasks}} WHERE NOT (status = 'Pending' AND progress < 30)""")
def task_states(d: Data) -> DataFrame:
    """The store of task states after a save of all, a save of some and a deletion."""
    states = _changed_states(d)
    return states.load().select("task_id", "status", "current_stage", "progress")


@query(f"""SELECT number, status, deleted, count(*) AS n FROM (SELECT 1 AS number, status, FALSE AS deleted FROM {{tasks}} UNION ALL SELECT 2, 'Failed', FALSE FROM {{tasks}} WHERE {_FAILED} UNION ALL SELECT 3, NULL, TRUE FROM {{tasks}} WHERE status = 'Pending' AND progress < 30) x GROUP BY ALL""")
def task_state_changes(d: Data) -> DataFrame:
    """The log of the same changes, by save."""
    return _changed_states(d).changes().groupBy("number", "status", "deleted").agg(F.count("*").alias("n"))


def _changed_states(d: Data) -> TaskStates:
    states = TaskStates(d.spark, f"{shared_folder(d.spark)}/weftline-states-{uuid.uuid4().hex}", _STATES)
    states.save(d.tasks)
    states.save(d.tasks.filter(_FAILED).withColumns({"status": F.lit("Failed"), "progress": F.lit(0)}))
    states.delete(d.tasks.filter("status = 'Pending' AND progress < 30").select("task_id"))
    return states


@query("""WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn >= 2, turn, role, text) - 1 AS nth FROM {conversations} WHERE conv_id % 7 <> 0 OR turn >= 2)
SELECT CAST(conv_id AS VARCHAR) AS chat_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY nth)) AS messages FROM m GROUP BY conv_id""")
def chat_history_store(d: Data) -> DataFrame:
    """Histories after two additions; those of every seventh chat were cleared in between."""
    history = ChatHistory(d.spark, f"{shared_folder(d.spark)}/weftline-chats-{uuid.uuid4().hex}")
    rows = d.conversations.select(F.col("conv_id").cast("string").alias("chat_id"), "conv_id", "turn", "role", "text")
    history.add(rows.filter("turn < 2"))
    history.clear(rows.filter("conv_id % 7 = 0"))
    history.add(rows.filter("turn >= 2"))
    line = F.struct("at", F.concat("role", F.lit(":"), "text").alias("line"))
    packed = history.snapshot().groupBy("chat_id").agg(F.array_sort(F.collect_list(line)).alias("m"), F.count("*").alias("n_messages"))
    return packed.select("chat_id", "n_messages", F.md5(F.array_join(F.transform("m", lambda x: x["line"]), "\n")).alias("messages"))
