"""Benchmark decontamination: which words of documents lie in a passage of a benchmark item.

A prefix-filtered set join. A window is ``size`` consecutive words of an item (a shorter item is one window); its tokens are
its shingles of ``GRAM`` words (of all its words if it has fewer). Shingles are ordered by rarity in the corpus. Since a
document with the window has all of its shingles, the prefix that it needs is one: the window's rarest shingle.

1. The benchmark's windows, each once with the items that have it, and the number of times that each of their shingles
   occurs in all documents.
2. Documents offer the places of necessary shingles with the words around them, and are joined to the windows filed under
   those. Bounds of position and length come first: the window has to fit between the start and the end of the document around that
   place. What is left is verified word by word.
3. Per text, the verified windows are united to a number of words hit and a list of items, and joined to the documents.

Sizes: nothing of the benchmark is collected. A bitmap of at most ``MAX_BITS`` bits tells tasks which shingles are worth sending; a
larger benchmark makes it less selective, not wrong. Windows and results are broadcast while they have at most ``MAX_BROADCAST``
rows. Beyond that they are joined by a shuffle, which documents without a hit do not take part in. A hot passage, or
one text in a third of all rows, sends places without texts, which are made distinct before they are shuffled.

Nulls and odd input: a null or wordless text has no words, no hits and no items; null item texts give no windows; windows of
items without an id are hits but name no item; items with equal windows all count; repeated rows are judged alike; long texts are read
whole; an empty documents table gives an empty result, an empty benchmark marks nothing. Further columns are kept, but for
columns named like the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from . import kernels as K
from .common import Scratch, bounded_batches, without
from .url_filter import _bit_positions, _filter_row, _test_bit

SIZE, GRAM = 10, 3
MAX_BITS = 1 << 27
MAX_BROADCAST = 200_000
#: A-Z belong to words as well: they are lowered.
_TABLE = K.ALNUM.copy()
_TABLE[65:91] = True
_KEY = ("__weft_h", "__weft_g")


def shingle_places(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of every k words in a row of one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
    return at, K.sequence_hashes(hashes, k)[at]


def windows_of(benchmark: DataFrame, item: str, text: str, size: int = SIZE) -> DataFrame:
    """benchmark -> (words, shingles, item) of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                own = offsets[i : j + 1]
                part = data[own[0] : own[-1]]
                starts, ends, first = K.word_spans(part, own - own[0], _TABLE)
                hashes, raw = K.word_hashes(part, starts, ends), K.LOWERED[part].tobytes()
                said = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for row in range(j - i):
                    a, b = first[row], first[row + 1]
                    begins = range(a, max(b - size, a) + 1 if b > a else a)
                    if not begins:
                        continue
                    n = min(size, b - a)
                    k = min(GRAM, n)
                    codes = K.sequence_hashes(hashes[a:b], k).view(np.int64)
                    words = pa.array([said[w : w + n] for w in begins], pa.list_(pa.string()))
                    shingles = pa.array([codes[w - a : w - a + n - k + 1] for w in begins], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([words, shingles, pa.array([batch.column(0)[i + row].as_py()] * len(begins), pa.string())], names=["words", "shingles", "item"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(cut, "words array<string>, shingles array<bigint>, item string")


def bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """One bit for each of n keys (key bigint) by its value, at most MAX_BITS in all."""
    n_bits = min(MAX_BITS, 1 << max(10, (16 * n).bit_length()))
    words = keys.select(F.pmod("key", F.lit(n_bits)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits


def _in(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    p = codes & np.uint64(64 * len(bits) - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def count_shingles(texts: DataFrame, bits: np.ndarray, grams: list[int]) -> DataFrame:
    """texts (text) -> (key, n): how often shingles that may be the benchmark's occur."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                own = offsets[i : j + 1]
                part = data[own[0] : own[-1]]
                starts, ends, first = K.word_spans(part, own - own[0], _TABLE)
                hashes = K.word_hashes(part, starts, ends)
                found = [codes[_in(shared.value, codes)] for codes in (shingle_places(hashes, first, k)[1] for k in grams)]
                codes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def offers(texts: DataFrame, bits: np.ndarray, grams: list[int], size: int = SIZE) -> DataFrame:
    """texts (text, two hashes) -> places of shingles that may be necessary: the hashes, key, at, n_words, before, near (words)."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                own = offsets[i : j + 1]
                part = data[own[0] : own[-1]]
                starts, ends, first = K.word_spans(part, own - own[0], _TABLE)
                hashes = K.word_hashes(part, starts, ends)
                raw = None
                for k in grams:
                    at, codes = shingle_places(hashes, first, k)
                    use = _in(shared.value, codes)
                    at, codes = at[use], codes[use]
                    # A few thousand places at a time: a passage under a common shingle may have any number of them.
                    for c in range(0, len(at), 4096):
                        raw = raw if raw is not None else K.LOWERED[part].tobytes()
                        p, row = at[c : c + 4096], np.searchsorted(first, at[c : c + 4096], "right") - 1
                        lo, hi = np.maximum(first[row], p - size + 1), np.minimum(first[row + 1], p + size)
                        near = [b" ".join([raw[starts[w] : ends[w]] for w in range(a, b)]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        rows = pa.array(i + row)
                        made = [batch.column(1).take(rows), batch.column(2).take(rows), pa.array(codes[c : c + 4096].view(np.int64)), pa.array(p - first[row]), pa.array(first[row + 1] - first[row]), pa.array((p - lo).astype(np.int32)), pa.array(near, pa.binary()).cast(pa.string())]
                        yield pa.RecordBatch.from_arrays(made, names=[*_KEY, "key", "at", "n_words", "before", "near"])

    return texts.mapInArrow(offer, "__weft_h bigint, __weft_g bigint, key bigint, at bigint, n_words bigint, before int, near string")


def with_word_counts(docs: DataFrame, text: str) -> DataFrame:
    """docs and the column n_words."""
    schema, at = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())]), docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at))
            n = [np.diff(K.word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _TABLE)[2]) for i, j in K.slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=schema.names)

    return docs.mapInArrow(count, schema)


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def hits_of(texts: DataFrame, benchmark: DataFrame, item: str, item_text: str, size: int, scratch: Scratch) -> DataFrame | None:
    """texts (text, two hashes) -> (two hashes, n_hit, items) of those with a window. None if the benchmark has no windows."""
    windows = windows_of(benchmark, item, item_text, size).groupBy("words").agg(F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))
    windows = scratch.keep(windows, "windows", small=True)
    keys = windows.select(F.explode("shingles").alias("key")).distinct()
    seen = keys.agg(F.count("*").alias("n")).first()["n"]
    if not seen:
        return None
    grams = sorted(r["k"] for r in windows.select(F.least(F.size("words"), F.lit(GRAM)).alias("k")).distinct().collect())  # at most GRAM rows
    counts = scratch.keep(count_shingles(texts.select("text"), bitmap(keys, seen), grams).join(_bounded(keys, seen), "key", "left_semi"), "counts", small=True)
    tokens = windows.select("words", F.posexplode("shingles").alias("place", "key")).join(_bounded(counts, seen), "key", "left")
    rarest = tokens.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("rarest"))
    filed = scratch.keep(rarest.join(windows.select("words", "items"), "words").select("words", "items", "rarest.key", "rarest.place"), "filed", small=True)
    n_filed = filed.count()
    offered = offers(texts, bitmap(filed.select("key"), n_filed), grams, size)
    begin, n = F.col("at") - F.col("place"), F.size("words")
    fits = (begin >= 0) & (begin + n <= F.col("n_words"))
    same = F.slice(F.split("near", " "), F.col("before") - F.col("place") + 1, n) == F.col("words")
    found = offered.join(_bounded(filed, n_filed), "key").filter(fits).filter(same)
    found = scratch.keep(found.select(*_KEY, begin.alias("begin"), (begin + n).alias("end"), "items").distinct(), "found", small=True)
    # Words hit: what each window adds to those that begin before it.
    before = F.max("end").over(W.partitionBy(*_KEY).orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0))))
    n_hit = found.select(*_KEY, "begin", "end").distinct().withColumn("added", added).groupBy(*_KEY).agg(F.sum("added").alias("n_hit"))
    named = found.select(*_KEY, F.explode_outer("items").alias("item")).distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return scratch.keep(n_hit.join(named, [*_KEY]), "hits", small=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """docs and the columns n_words, n_hit, items (sorted strings) and contaminated."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "decontaminate")
    docs = without(docs, "n_words", "n_hit", "items", "contaminated")
    hashes = {_KEY[0]: F.xxhash64(text), _KEY[1]: F.xxhash64(F.lit(1), text)}
    hits = hits_of(docs.select(F.col(text).alias("text"), *(h.alias(k) for k, h in hashes.items())), benchmark, item, item_text, size, scratch)
    judged = with_word_counts(docs, text)
    none = F.array().cast("array<string>")

    def finished(rows: DataFrame, n_hit: Column, items: Column) -> DataFrame:
        n_hit = F.coalesce(n_hit, F.lit(0)).cast("bigint")
        return rows.select(*docs.columns, "n_words", n_hit.alias("n_hit"), F.coalesce(items, none).alias("items"), (n_hit > 0).alias("contaminated"))

    if hits is None:
        return finished(judged, F.lit(0), none)
    n = hits.count()
    judged = judged.withColumns(hashes)
    joined = lambda rows: finished(rows.join(_bounded(hits, n), [*_KEY], "left"), F.col("n_hit"), F.col("items"))
    if n <= MAX_BROADCAST:
        return joined(judged)
    # Documents that a filter of the hit texts does not know are done; the others are shuffled.
    n_bits = min(MAX_BITS, 64 * (n // 4 + 1))
    row = scratch.keep(_filter_row(hits.select(F.col(_KEY[0]).alias("key")), n_bits, 2, 0), "hit-bits")
    judged = judged.withColumn("__weft_bits", row.scalar())
    first, second = (_test_bit(F.col("__weft_bits"), p) for p in _bit_positions(F.col(_KEY[0]), n_bits, 2, 0))
    return finished(judged.filter(~(first & second)), F.lit(0), none).unionByName(joined(judged.filter(first & second).drop("__weft_bits")))
