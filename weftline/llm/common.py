"""What the operators share: reading tables, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only: the other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add, whatever their case."""
    new = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in new))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of a few MB, unless the session says otherwise: a task's memory then does not depend on how long texts are."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan, without a Python worker."""
    fields = spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (f.split() for f in schema.split(", ")))).schema.fields
    made = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A temporary one only where the cluster names none and runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def remove_scratch(spark: SparkSession) -> None:
    """Delete what operators have left in the shared folder. Results that were not written elsewhere can't be read afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = base.getFileSystem(conf)
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, "weftline-*")) or []:
        fs.delete(status.getPath(), True)


class Scratch:
    """Intermediate tables of one run of an operator. A table cuts the lineage: a lost executor's tasks start from files."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), small: bool = False) -> DataFrame:
        """Write and read a table. ``small``: not more files than a few for each core, whatever the number of partitions."""
        schema = df.schema
        if small:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
