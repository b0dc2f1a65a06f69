"""Chat histories as rows that are only ever added: messages, and marks from which on a history starts anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .buckets import BucketStore

ROWS = "chat_id string, number bigint, turn bigint, role string, text string, cleared boolean"


class ChatHistory:
    """Histories of any number of chats under ``path``. Messages are in the order of their adding, within one adding by turn, role and text."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.store = BucketStore(spark, path, ROWS, ("chat_id",), buckets=buckets)

    def add(self, messages: DataFrame) -> None:
        """messages (chat_id, turn, role, text)"""
        self._append(messages.select("chat_id", "turn", "role", "text", F.lit(False).alias("cleared")))

    def clear(self, chats: DataFrame) -> None:
        """Forget what the chats (chat_id) hold so far."""
        none = [F.lit(None).alias(c) for c in ("turn", "role", "text")]
        self._append(chats.select("chat_id").distinct().select("chat_id", *none, F.lit(True).alias("cleared")))

    def _append(self, rows: DataFrame) -> None:
        self.store.append(rows.withColumn("number", F.lit(self.store.manifest()["number"] + 1)))

    def snapshot(self, chats: DataFrame | None = None) -> DataFrame:
        """(chat_id, at, role, text) of all chats, or of some (chat_id): the messages since the last mark, at from 0."""
        rows = self.store.read() if chats is None else self.store.near(chats.select("chat_id"))
        last = F.coalesce(F.max(F.when(F.col("cleared"), F.col("number"))).over(W.partitionBy("chat_id")), F.lit(-1))
        live = rows.withColumn("__last", last).filter((F.col("number") > F.col("__last")) & ~F.col("cleared"))
        order = W.partitionBy("chat_id").orderBy("number", "turn", "role", "text")
        return live.select("chat_id", (F.row_number().over(order) - 1).alias("at"), "role", "text")
