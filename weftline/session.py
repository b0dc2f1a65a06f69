"""Sending the package to the executors of a session, and short lists in its shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in a local session without one a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settle(rows: DataFrame, label: str, short: bool = True) -> DataFrame:
    """A list as a table in the cluster's shared folder, so that what follows does not compute it again; one file if ``short``.

    Only the short list itself goes to the one task that writes it: what it is computed from stays in as many tasks as it has.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    (rows.repartition(1) if short else rows).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows up to which a list that is stored already is numbered in one task.
SHORT = 10_000


def numbered(rows: DataFrame, *order: Column | str, stored: bool = False) -> DataFrame:
    """rows of any number with pos, from 0 by the order (which has no ties). ``stored``: rows are a table, so that counting them is cheap.

    Rows are sorted by ranges and written once with their place in the range; only one count for each range meets in a task.
    """
    if stored and rows.count() <= SHORT:
        return rows.withColumn("pos", (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))
    place = F.monotonically_increasing_id()
    kept = settle(rows.orderBy(*order).select("*", F.shiftright(place, 33).alias("__range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "numbered", False)
    counts = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))  # one row for each task of the sort
    return kept.join(F.broadcast(starts), "__range").withColumn("pos", (F.col("__before") + F.col("__at")).cast("int")).drop("__range", "__at", "__before")


#: Places of a list that are one block of a running sum.
BLOCK = 4096


def running(rows: DataFrame, value: Column, block: list[Column], order: list[Column], by: tuple[str, ...] = (), name: str = "upto") -> DataFrame:
    """rows with the sum of ``value`` up to each of them in the order, the row included, for each value of ``by``.

    Two levels: sums within blocks, and before each block those of the blocks before it. ``block`` are columns that grow with the order; only one
    row for each block meets in a task, and ties of the order share a block.
    """
    keys = [f"__b{i}" for i in range(len(block))]
    marked = rows.withColumns({**dict(zip(keys, block, strict=True)), "__v": value})
    sums = marked.groupBy(*by, *keys).agg(F.sum("__v").alias("__of"))
    before = F.sum("__of").over(W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate((*by, *keys))), F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate((*by, *keys))]
    out = marked.join(sums, same).drop(*(f"__s{i}" for i in range(len(by) + len(keys))))
    own = F.sum("__v").over(W.partitionBy(*by, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn(name, own + F.col("__before")).drop(*keys, "__v", "__before")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="weftline-ship-"), "weftline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
