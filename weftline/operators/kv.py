"""Key-value stores as tables with a column ``id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Keys that a call may name; more belong in a table that is joined.
MAX_KEYS = 100_000


def key_rows(like: DataFrame, ids: list[str]) -> DataFrame:
    """The named keys in order: (pos, id)."""
    if len(ids) > MAX_KEYS:
        raise ValueError(f"{len(ids)} keys; use a table of keys")
    return like.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("id", T.StringType())]))


def get_by_id(store: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    return store.filter(F.col(id_col) == key)


def get_by_ids(store: DataFrame, ids: list[str], id_col: str = "id") -> DataFrame:
    """Rows in the order of the keys: missing keys are left out, repeated ones repeated. Column ``pos`` is the key's place."""
    keys = F.broadcast(key_rows(store, ids).withColumnRenamed("id", "__key"))  # at most MAX_KEYS
    return store.join(keys, F.col(id_col).cast("string") == F.col("__key")).drop("__key")


def missing_keys(store: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """Keys (id) that the store has not."""
    return keys.select("id").distinct().join(store.select(F.col(id_col).alias("id")), "id", "left_anti")


def is_empty(store: DataFrame) -> DataFrame:
    """One row: whether the store has no rows. It looks at one row only."""
    return store.limit(1).agg((F.count("*") == 0).alias("is_empty"))


def upsert(store: DataFrame, changes: DataFrame, seq: Column, id_col: str = "id") -> DataFrame:
    """The last write of each id wins as a whole row; changes come after the store. seq orders the changes."""
    both = store.withColumn("__seq", F.lit(None).cast("bigint")).unionByName(changes.withColumn("__seq", seq.cast("bigint")), allowMissingColumns=True)
    last = W.partitionBy(id_col).orderBy(F.col("__seq").desc_nulls_last())
    return both.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn", "__seq")


def delete(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return store.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside the old one, then swap the folders. df must not read what a broken swap left: see ``repair``."""
    repair(df.sparkSession, path)
    fs, to_path = _files(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(to_path(path)):
        fs.delete(to_path(f"{path}.old"), True)
        fs.rename(to_path(path), to_path(f"{path}.old"))
    fs.rename(to_path(f"{path}.new"), to_path(path))
    fs.delete(to_path(f"{path}.old"), True)


def repair(spark: SparkSession, path: str) -> None:
    """Finish a swap whose writer was lost. For writers: of those there is one at a time."""
    fs, to_path = _files(spark, path)
    left = current_path(spark, path)
    if left not in (None, path):
        fs.rename(to_path(left), to_path(path))


def remove(spark: SparkSession, path: str) -> None:
    fs, to_path = _files(spark, path)
    fs.delete(to_path(path), True)


def current_path(spark: SparkSession, path: str) -> str | None:
    """Where a table's rows are: in its folder; between the two renames of a swap in the new one, which is whole by then. None: nowhere.

    The old folder is moved away only after the new one is written, so a missing folder beside a whole new one is never an empty table.
    """
    fs, to_path = _files(spark, path)
    for where, mark in ((path, path), (f"{path}.new", f"{path}.new/_SUCCESS"), (path, path), (f"{path}.old", f"{path}.old")):
        if fs.exists(to_path(mark)):
            return where
    return None


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, function from a name to its path object)"""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return to_path(path).getFileSystem(conf), to_path
