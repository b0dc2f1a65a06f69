"""Cutting documents into chunks of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import prefixed_md5
from ..functions.text import strip
from ..functions.tokens import WORDS, Tokenizer


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    return size - overlap


def sliding(docs: DataFrame, size: int = 1200, overlap: int = 100, content: str = "content", keys: tuple[str, ...] = ("full_doc_id", "file_path"), repeat_tail: bool = True, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Windows of ``size`` tokens, ``overlap`` of them shared with the next one, as chunks in order.

    A remainder of at most ``overlap`` tokens makes no chunk of its own. The chunk before has reached the end already, and
    gets those tokens once more (``repeat_tail``) or not. Contents are what the tokenizer makes of the tokens: words joined by one blank.
    """
    step = _check(size, overlap)
    cut = docs.select(*keys, tokenizer.encode(F.col(content)).alias("__t")).filter(F.size("__t") > 0)
    n = F.size("__t")
    # Starts at which more than the overlap is left, and always the first.
    last = F.greatest(F.lit(0), F.floor((n - 1 - overlap) / step)).cast("int")
    rows = cut.withColumn("__last", last).select(*keys, "__t", "__last", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("chunk_order_index"))
    start = F.col("chunk_order_index") * step
    own = F.slice("__t", start + 1, F.lit(size))
    rest = F.size("__t") - (start + step)
    if repeat_tail:
        tail = F.slice("__t", start + step + 1, F.greatest(rest, F.lit(1)))
        own = F.when((F.col("chunk_order_index") == F.col("__last")) & (rest > 0) & (rest <= overlap), F.concat(own, tail)).otherwise(own)
    rows = rows.select(*keys, F.col("chunk_order_index"), own.alias("__own"))
    rows = rows.withColumn("__text", tokenizer.decode(F.col("__own")))
    return rows.select(*keys, "chunk_order_index", prefixed_md5("chunk-", F.col("__text")).alias("id"), strip(F.col("__text")).alias("content"), F.size("__own").alias("tokens"))


def by_separator(docs: DataFrame, separator: str, size: int = 1200, overlap: int = 100, strict: bool = False, content: str = "content", keys: tuple[str, ...] = ("full_doc_id", "file_path"), tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Pieces between separators; a piece of more than ``size`` tokens is cut into windows, or is an error with ``strict``."""
    step = _check(size, overlap)
    pieces = docs.select(*keys, F.posexplode(F.split(F.col(content), F.lit(_quoted(separator)), -1)).alias("piece", "__c")).withColumn("__t", tokenizer.encode(F.col("__c")))
    n = F.size("__t")
    if strict:
        pieces = pieces.withColumn("__t", F.when(n > size, F.raise_error(F.concat(F.lit("a piece has "), n.cast("string"), F.lit(" tokens")))).otherwise(F.col("__t")))
    windows = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    rows = pieces.select(*keys, "piece", "__c", "__t", F.explode(windows).alias("start"))
    own = F.slice("__t", F.col("start") + 1, F.lit(size))
    whole = F.size("__t") <= size
    text = F.when(whole, F.col("__c")).otherwise(tokenizer.decode(own))
    rows = rows.select(*keys, "piece", "start", text.alias("__text"), F.when(whole, F.size("__t")).otherwise(F.size(own)).alias("tokens"))
    return rows.select(*keys, "piece", "start", prefixed_md5("chunk-", F.col("__text")).alias("id"), strip(F.col("__text")).alias("content"), "tokens")


def _quoted(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
