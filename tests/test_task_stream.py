"""The task machine over streams: any order of micro-batches, repeated batches, timers."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from weftline.operators import taskqueue
from weftline.streaming import progress, tasks

OPS = ("enqueue", "start", "progress", "fail", "retry", "complete", "reorder", "stop", "delete")


def write_batches(spark, folder, batches):
    """One file for each micro-batch, in their order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, tasks.EVENTS).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-"):
                os.rename(f"{path}/{f}", f"{folder}/batch-{i:03d}.parquet")
                os.utime(f"{folder}/batch-{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def read(spark, folder):
    return progress.read_events(spark, f"{folder}/*.parquet", tasks.EVENTS, 1)


def test_any_order_of_batches_is_the_fold(spark, tmp_path):
    """Ten orders of one log, as tasks of their own names, each in its own order of micro-batches."""
    rng = random.Random(2)
    log = [(f"t{k % 7}", k * 3, "enqueue" if k < 7 else rng.choice(OPS), rng.choice([None, -5, 7, 300])) for k in range(140)]
    batches: list[list[tuple]] = [[] for _ in range(4)]
    for order in range(10):
        mixed = rng.sample(log, len(log))
        for i, (task, seq, op, arg) in enumerate(mixed):
            batches[i % 4].append((f"{order}-{task}", seq, op, arg, None))
        batches[3] += [(f"{order}-{t}", s, o, a, None) for t, s, o, a in mixed[:20]]  # events that come again
    batches[0] += [(None, 1, "enqueue", 1, None), ("0-t1", None, "stop", 1, None)]
    write_batches(spark, str(tmp_path), batches)
    tasks.run_to_table(tasks.states(read(spark, tmp_path)), f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    want = {tuple(r) for r in taskqueue.fold_events(spark.createDataFrame(log, "task_id string, seq bigint, op string, arg int")).collect()}
    found = [tuple(r) for r in tasks.read_states(spark, f"{tmp_path}/table").collect()]
    assert len(found) == 10 * len(want)
    for order in range(10):
        assert {(t.split("-")[1], *rest) for t, *rest in found if t.startswith(f"{order}-")} == want


def test_a_repeated_batch_or_an_older_one_changes_nothing(spark, tmp_path):
    store = tasks._store(spark, f"{tmp_path}/table")
    first = spark.createDataFrame([("a", 2, "Processing", 5, 1, 0), ("b", 1, "Pending", 0, 1, 0)], tasks.VIEW)
    tasks.newest(first, store)
    tasks.newest(spark.createDataFrame([("a", 1, "Pending", 0, 1, 0), ("b", 3, "Failed", 0, 1, 0)], tasks.VIEW), store)
    tasks.newest(first, store)
    assert {tuple(r)[:2] for r in tasks.read_states(spark, f"{tmp_path}/table").collect()} == {("a", "Processing"), ("b", "Failed")}


def test_timers(spark, tmp_path):
    """A task without events fails and waits again; one with events does not; what comes too late is left out."""
    at = lambda minute: spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {minute})").first()[0]
    start = [(t, n, op, 1, at(n)) for t in ("idle", "busy", "done") for n, op in ((0, "enqueue"), (1, "start"))]
    batches = [
        start + [("done", 2, "complete", 1, at(2)), ("busy", 2, "progress", 10, at(2))],
        [("busy", 8, "progress", 60, at(8)), ("clock", 0, "enqueue", 1, at(9))],
        [("clock", 1, "reorder", 2, at(14)), ("busy", 14, "progress", 70, at(14))],
        [("clock", 2, "reorder", 3, at(16))],
        [("clock", 3, "reorder", 4, at(19)), ("idle", 2, "stop", 1, at(2))],
    ]
    write_batches(spark, str(tmp_path), batches)
    found = tasks.states(read(spark, tmp_path), "1 minute", idle_ms=10 * 60_000, retry_ms=4 * 60_000)
    tasks.run_to_table(found, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    rows = {r["task_id"]: (r["status"], r["retries"]) for r in tasks.read_states(spark, f"{tmp_path}/table").collect()}
    assert rows["done"] == ("Completed", 0) and rows["busy"] == ("Processing", 0) and rows["clock"] == ("Pending", 0)
    assert rows["idle"] == ("Pending", 1)  # failed at minute 11, waits again from minute 15


def test_step_is_the_fold(spark):
    """Every pair of state and event: the helper equals the column expression of the fold."""
    logs = [[("enqueue", 3)]] + [[("enqueue", 3), ("start", 1)], [("enqueue", 3), ("start", 1), ("fail", 1)], [("enqueue", 3), ("start", 1), ("complete", 1)], [("enqueue", 3), ("delete", 1)], []]
    logs += [[("enqueue", 3), ("start", 1), *[("fail", 1), ("retry", 1), ("start", 1)] * 3, ("fail", 1)]]
    made = [[*log, (op, arg)] for log in logs for op in (*OPS, "other", None) for arg in (None, -1, 50, 101)]
    rows = [(f"t{i}", n, op, arg) for i, log in enumerate(made) for n, (op, arg) in enumerate(log)]
    want = {r["task_id"]: tuple(r)[1:] for r in taskqueue.fold_events(spark.createDataFrame(rows, "task_id string, seq bigint, op string, arg int")).select(F.col("task_id"), "status", "progress", "priority", "retries").collect()}
    for i, log in enumerate(made):
        task = tasks.NEW
        for op, arg in log:
            task = tasks.step(task, op, arg)
        assert task == want.get(f"t{i}", tasks.NEW), log
