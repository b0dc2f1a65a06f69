"""A micro-batch's rows are worked out once, however often the store that takes them reads them."""

from __future__ import annotations

import os

from weftline.streaming import progress, tasks


def counted(rows, folder):
    """rows through a task that leaves a file each time it runs."""
    os.makedirs(folder)

    def pass_on(batches):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    return rows.coalesce(1).mapInArrow(pass_on, rows.schema)


def test_states_of_a_batch_are_worked_out_once(spark, tmp_path):
    store = tasks._store(spark, f"{tmp_path}/table")
    for version in (1, 2):
        rows = spark.createDataFrame([(f"t{k}", version, "Pending", 0, k, 0) for k in range(300)], tasks.VIEW)
        tasks.newest(counted(rows, f"{tmp_path}/runs{version}"), store)
        assert len(os.listdir(f"{tmp_path}/runs{version}")) == 1
    assert tasks.read_states(spark, f"{tmp_path}/table").count() == 300
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_progress_of_a_batch_is_folded_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 300}", k, "s", k % 10, 10) for k in range(600)], progress.EVENTS)
    rows.coalesce(1).write.parquet(f"{tmp_path}/events")
    events = progress.read_events(spark, f"{tmp_path}/events")
    progress.run_to_table(counted(events, f"{tmp_path}/runs"), f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    assert len(os.listdir(f"{tmp_path}/runs")) == 1
    assert progress.read_progress(spark, f"{tmp_path}/table").count() == 300
