"""Substring search over node ids without a scan of the nodes: posting lists of three-character pieces, joined and then verified.

A posting list is a set of rows (gram, entity_id, entity_type) in the bucket of its gram. An id that contains the label has all of the label's
grams, so the ids that are in every one of their lists are the only candidates, and the label is looked for in those. Types have a list each.
Labels of fewer than three characters have no gram: they are looked for in the list of all ids, and so is ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BucketStore

GRAM = 3
#: What the names of lists begin with: of a gram, of a type, of all ids (dealt out, so that no bucket holds them all).
OF_GRAM, OF_TYPE, OF_ALL = "g:", "t:", "a:"
PARTS = 64


def grams(c: Column, size: int = GRAM) -> Column:
    """The distinct pieces of ``size`` characters."""
    n = F.greatest(F.char_length(c) - size + 1, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(size))))


class LabelIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.store = BucketStore(spark, path, "gram string, entity_id string, entity_type string", ("gram",), ("gram", "entity_id"), buckets)

    def _postings(self, nodes: DataFrame) -> DataFrame:
        part = F.concat(F.lit(OF_ALL), F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)).cast("string"))
        names = F.concat(F.transform(grams(F.col("entity_id")), lambda g: F.concat(F.lit(OF_GRAM), g)), F.array(part), F.when(F.col("entity_type").isNotNull(), F.array(F.concat(F.lit(OF_TYPE), F.col("entity_type")))).otherwise(F.array().cast("array<string>")))
        rows = nodes.filter(F.col("entity_id").isNotNull()).select("entity_id", "entity_type").dropDuplicates(["entity_id"])
        return rows.select(F.explode(names).alias("gram"), "entity_id", "entity_type")

    def build(self, nodes: DataFrame) -> None:
        """Index nodes (entity_id, entity_type) anew."""
        self.store.overwrite(self._postings(nodes))

    def put(self, nodes: DataFrame) -> None:
        """Add nodes, or replace those with their ids; only the lists of their grams and types are rewritten."""
        old = self.store.near(self._postings(nodes).select("gram")).join(nodes.select("entity_id").distinct(), "entity_id", "left_semi")
        # A node whose type has changed leaves the old type's list.
        types = old.filter(F.col("gram").startswith(OF_ALL)).select(F.concat(F.lit(OF_TYPE), F.col("entity_type")).alias("gram"), "entity_id").dropna()
        self.store.replace(self._postings(nodes), types)

    def remove(self, ids: DataFrame) -> None:
        """Take nodes (entity_id) out of all lists."""
        ids = ids.select("entity_id").dropna().distinct()
        kept = self.store.near(self._postings(ids.withColumn("entity_type", F.lit(None).cast("string"))).select("gram")).join(ids, "entity_id", "left_semi")
        types = kept.filter(F.col("gram").startswith(OF_ALL)).select(F.concat(F.lit(OF_TYPE), F.col("entity_type")).alias("gram"), "entity_id").dropna()
        self.store.replace(self.store.read().limit(0), kept.select("gram", "entity_id").unionByName(types))

    def match(self, label: str) -> DataFrame:
        """(entity_id, entity_type) of the nodes whose id contains the label or whose type is the label; ``*`` is every node."""
        lists = lambda names: self.store.near(self.spark.createDataFrame([(n,) for n in names], "gram string"))
        if label == "*" or len(label) < GRAM:
            every = lists([f"{OF_ALL}{i}" for i in range(PARTS)]).select("entity_id", "entity_type")
            return every if label == "*" else every.filter(F.col("entity_id").contains(label) | (F.col("entity_type") == label))
        wanted = sorted({label[i : i + GRAM] for i in range(len(label) - GRAM + 1)})
        found = lists([OF_GRAM + g for g in wanted]).groupBy("entity_id").agg(F.count("*").alias("n"), F.first("entity_type").alias("entity_type"))
        found = found.filter((F.col("n") == len(wanted)) & F.col("entity_id").contains(label)).select("entity_id", "entity_type")
        return found.unionByName(lists([OF_TYPE + label]).select("entity_id", "entity_type")).dropDuplicates(["entity_id"])
