"""The task queue's states from a stream of its events, with timers for idle and failed tasks.

Each task is a key with a state of its own: what is settled, and the events after it. Events may come in any order of micro-batches and more
than once. Without a delay all events of a task are kept (a task's log is small) and the result is that of ``taskqueue.fold_events`` over the same
log. With a delay, events older than the watermark are settled and events that come later than that are left out; timers
look at settled events only, so what they do does not depend on the order of arrival either.

An event without task, number or (with a delay) time is left out; of events with one number the first that comes counts, unless they differ within
a micro-batch, where the least operation and argument does; a null argument is a progress of 100 and no priority, as in the fold; an empty stream gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import taskqueue as Q
from ..operators.buckets import BucketStore

EVENTS = "task_id string, seq bigint, op string, arg int, at timestamp"
VIEW = "task_id string, version bigint, status string, progress int, priority int, retries int"
_STATE = "version bigint, status string, progress int, priority int, retries int, seq bigint, at bigint, seqs array<bigint>, ops array<string>, args array<int>, ats array<bigint>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Task = tuple[str | None, int | None, int | None, int | None]  # status, progress, priority, retries
NEW: Task = (None, None, None, None)


def step(task: Task, op: str | None, arg: int | None) -> Task:
    """The state after an event; one that is not allowed in a state changes nothing."""
    status, progress, priority, retries = task
    if op == "enqueue" and status in (None, "Deleted"):
        return Q.PENDING, 0, arg, 0
    if op == "retry" and status == Q.FAILED and retries < Q.MAX_RETRIES:
        return Q.PENDING, 0, priority, retries + 1
    if op == "reorder" and status is not None:
        return status, progress, arg, retries
    if op == "start" and status == Q.PENDING:
        return Q.PROCESSING, progress, priority, retries
    if op == "progress" and status == Q.PROCESSING:
        return status, max(0, min(100, 100 if arg is None else arg)), priority, retries
    if op == "complete" and status == Q.PROCESSING:
        return Q.COMPLETED, 100, priority, retries
    if (op == "fail" and status == Q.PROCESSING) or (op == "stop" and status in (Q.PENDING, Q.PROCESSING)):
        return Q.FAILED, progress, priority, retries
    if op == "delete" and status is not None and status != Q.PROCESSING:
        return "Deleted", progress, priority, retries
    return task


class TaskMachine(StatefulProcessor):
    """``idle_ms``: a running task without events for so long has failed. ``retry_ms``: a failed task waits again after so long."""

    def __init__(self, idle_ms: int | None = None, retry_ms: int | None = None, timed: bool = False):
        self.idle_ms, self.retry_ms, self.timed = idle_ms, retry_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def _load(self) -> dict[str, Any]:
        v = self.state.get()
        if v is None:
            return {"version": 0, "task": NEW, "seq": None, "at": None, "later": {}}
        version, status, progress, priority, retries, seq, at, seqs, ops, args, ats = v
        later = {n: (o, a, t) for n, o, a, t in zip(seqs, ops, args, ats, strict=True)}
        return {"version": version, "task": (status, progress, priority, retries), "seq": seq, "at": at, "later": later}

    def _save(self, s: dict[str, Any]) -> None:
        order = sorted(s["later"])
        ops, args, ats = ([s["later"][n][i] for n in order] for i in range(3))
        self.state.update((s["version"], *s["task"], s["seq"], s["at"], order, ops, args, ats))

    def _view(self, key: Any, s: dict[str, Any]) -> Iterator[Row]:
        task = s["task"]
        for n in sorted(s["later"]):
            task = step(task, *s["later"][n][:2])
        if task[0] is not None:
            yield Row(task_id=key[0], version=s["version"], status=task[0], progress=task[1], priority=task[2], retries=task[3])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self._load()
        new = sorted((r["seq"], r["op"] or "", -1 if r["arg"] is None else r["arg"], r["arg"], r["ms"]) for r in rows)
        latest = None
        for seq, op, _, arg, ms in new:
            if seq not in s["later"] and (s["seq"] is None or seq > s["seq"]):
                s["later"][seq] = (op, arg, ms)
                s["version"] += 1
                latest = ms if latest is None else max(latest, ms)
        if latest is None:
            return
        if self.timed:
            self.handle.registerTimer(latest)
        self._save(s)
        yield from self._view(key, s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        before = s["version"]
        for n in sorted(s["later"]):
            op, arg, at = s["later"][n]
            if at > now:
                break
            s["task"], s["seq"], s["at"] = step(s["task"], op, arg), n, max(at, s["at"] or at)
            del s["later"][n]
        if not s["later"] and s["at"] is not None:
            for status, op, wait in ((Q.PROCESSING, "fail", self.idle_ms), (Q.FAILED, "retry", self.retry_ms)):
                if wait is None or s["task"][0] != status or step(s["task"], op, None) == s["task"]:
                    continue
                if now >= s["at"] + wait:
                    s["task"], s["at"], s["version"] = step(s["task"], op, None), s["at"] + wait, s["version"] + 1
                else:
                    self.handle.registerTimer(s["at"] + wait)
        self._save(s)
        if s["version"] != before:
            yield from self._view(key, s)


def states(events: DataFrame, delay: str | None = None, idle_ms: int | None = None, retry_ms: int | None = None) -> DataFrame:
    """A stream of task states from a stream of events; the row of greatest version is a task's state.

    ``delay``: how late an event may come, as for a watermark over the column ``at``; timers need it.
    """
    if delay is None and (idle_ms is not None or retry_ms is not None):
        raise ValueError("timers need a delay")
    known = events.filter("task_id IS NOT NULL AND seq IS NOT NULL")
    if delay is not None:
        known = known.filter("at IS NOT NULL").withColumn("ms", F.unix_millis("at")).withWatermark("at", delay).select("task_id", "seq", "op", "arg", "ms", "at")
    else:
        known = known.select("task_id", "seq", "op", "arg", F.lit(0).cast("bigint").alias("ms"))
    machine = TaskMachine(idle_ms, retry_ms, delay is not None)
    return known.groupBy("task_id").transformWithState(machine, VIEW, "Update", "None" if delay is None else "EventTime")


def run_to_table(found: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest state of each task in the table at ``path``; a batch that is repeated changes nothing."""
    store = _store(found.sparkSession, path)

    def keep(batch: DataFrame, _: int) -> None:
        newest(batch, store)

    conf, name = found.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, _ROCKS)  # states with timers need it; a query keeps the provider that it was started with
    try:
        writer = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def newest(rows: DataFrame, store: BucketStore) -> None:
    """Put states into the store, unless it has a newer one of their task. The rows are worked out once, however often the store reads them."""
    task = F.max_by(F.struct("status", "progress", "priority", "retries"), "version").alias("t")
    own = rows.groupBy("task_id").agg(F.max("version").alias("version"), task).select("task_id", "version", "t.*").persist(StorageLevel.DISK_ONLY)
    try:
        both = own.unionByName(store.near(own)).groupBy("task_id").agg(F.max("version").alias("version"), task)
        store.replace(both.select("task_id", "version", "t.*"))
    finally:
        own.unpersist()


def _store(spark: SparkSession, path: str) -> BucketStore:
    return BucketStore(spark, path, VIEW, ("task_id",))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, status, progress, priority, retries)."""
    return _store(spark, path).read().drop("version")
