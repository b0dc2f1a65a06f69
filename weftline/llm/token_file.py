"""Token ids of documents in ascending order of document id, in a binary format, and back.

Documents are range-partitioned and sorted by id; each task encodes its texts with a public tokenizer and writes segments
of whole documents (``simple8b``). A dataset row is one segment: part, its number in the part, the ids before it in the part,
document ids, their token counts, and the coded ids. Offsets over the whole corpus come from the parts' totals.

Encoding goes through a cache of pre-tokens: byte-level BPE never merges across pre-tokens, so a text's ids are those of its
pre-tokens in order, each of which the tokenizer library encodes once per worker. Texts with characters outside the
plain set, or with a special token's mark, go to the library whole, and so do all texts where the tokenizer's file asks for
anything but plain byte-level BPE.

Nulls and odd input: a null text is an empty one and yields the end id alone; null document ids come first; repeated rows are
encoded one after the other; an empty table gives an empty dataset; a long text is a segment of its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import simple8b
from .common import bounded_batches

END_ID = 2
SEGMENT_IDS = 1 << 17
SCHEMA = "part int, seq int, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, ids binary"
#: What the vectorised pre-tokenizer knows: ASCII but for control characters, apostrophes and special tokens' marks, and
#: Latin letters of two bytes. Other texts go to the library whole.
_ODD = rb"[\x00-\x08\x0b\x0c\x0e-\x1f'\x7f\xc2\xca-\xff]|\xc3[\x97\xb7]|<\|"
#: Byte-level vocabularies write bytes as printable signs: those of Latin-1 that are printable stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 13, 32]] = _SPACE


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE begin: runs of letters, digits or other signs, each with one blank before it;
    white space otherwise, of which the last before a run of signs stands alone unless it is that blank."""
    n = len(data)
    kind = _KIND[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    last[ends - 1] = True
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    space = kind == _SPACE
    begins = first | np.concatenate([[True], before[1:] != kind[1:]])
    blank_before = np.concatenate([[False], data[:-1] == 32]) & ~first
    before_signs = space & ~last & (np.concatenate([after[:-1], [_SPACE]]) != _SPACE)
    return np.flatnonzero(np.where(space, begins | before_signs, begins & ~blank_before))


def _known(file: dict) -> bool:
    """Whether texts of this tokenizer file are cut as ``piece_starts`` cuts them: plain byte-level BPE with marks in ``<|``."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    by_bytes = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    marked = all("<|" in t["content"] for t in file.get("added_tokens") or [])
    return model.get("type") == "BPE" and plain and by_bytes and marked and not any(file.get(k) for k in ("normalizer", "truncation", "padding"))


class Encoder:
    """Ids of texts, as the tokenizer library gives them. Pre-tokens are looked up by a 64-bit hash of their bytes."""

    def __init__(self, path: str, max_cached: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd, self.max_cached = re.compile(_ODD), max_cached
        with open(path, encoding="utf-8") as f:
            self.by_pieces = _known(json.load(f))
        self.forget()

    def forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each)."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens, which go straight to the library's merges."""
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(p.decode("latin-1").translate(_SIGNS))] for p in pieces]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        codes = K.span_hashes(data, starts, ends)
        known, place = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == known[there]
        new = np.flatnonzero(~there)
        if len(new):
            where = np.empty(len(known), np.int64)
            where[place] = np.arange(len(codes))
            raw = data.tobytes()
            ids, sizes = self._pieces([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            self.row = np.insert(self.row, at[new], len(self.row) + np.arange(len(new)))
            self.keys = np.insert(self.keys, at[new], known[new])
            self.ids, self.first = np.concatenate([self.ids, ids]), np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            at = np.searchsorted(self.keys, known)
        row = self.row[at][place] if len(known) else np.zeros(0, np.int64)
        begin, size = self.first[row], self.first[row + 1] - self.first[row]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return flat, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, their number in each) for texts as bytes."""
        if len(self.keys) > self.max_cached:
            self.forget()
        raw, n = data.tobytes(), len(offsets) - 1
        if not self.by_pieces:
            return self._library([raw[offsets[k] : offsets[k + 1]].decode() for k in range(n)])
        odd = np.array([self.odd.search(raw, offsets[k], offsets[k + 1]) is not None for k in range(n)], bool)
        if not odd.any():
            return self._plain(data, offsets)
        sizes = np.zeros(n, np.int64)
        ids, sizes[odd] = self._library([raw[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(odd)])
        plain_data = data[np.repeat(~odd, np.diff(offsets))]
        plain, sizes[~odd] = self._plain(plain_data, np.concatenate([[0], np.cumsum(np.diff(offsets)[~odd])]))
        out = np.empty(sizes.sum(), np.uint32)
        of_odd = np.repeat(odd, sizes)
        out[of_odd], out[~of_odd] = ids, plain
        return out, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder: a worker keeps what it learned from one task to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write ``docs`` as a token dataset at ``path``. tokenizer: path of a tokenizers file that every executor has."""
    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            coded = simple8b.encode(np.concatenate(ids))
            made = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (names, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (coded, pa.binary()))]
            return pa.RecordBatch.from_arrays(made, names=["part", "seq", "before", "doc_ids", "n_tokens", "ids"])

        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets, 1 << 20):
                own = offsets[i : j + 1]
                found, n = tokens.encode(data[own[0] : own[-1]], own - own[0])
                names += batch.column(0).slice(i, j - i).to_pylist()
                sizes += (n + 1).tolist()
                ids.append(np.insert(found, np.cumsum(n), np.uint32(end_id)))
                if sum(map(len, ids)) >= segment_ids:
                    yield segment()
                    seq, before = seq + 1, before + sum(sizes)
                    names, sizes, ids = [], [], []
        if names:
            yield segment()

    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` the ids as ``ids``."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    sizes = stored.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    offsets, total = {}, 0
    for row in sorted(sizes.collect()):  # one row per part, that is per task of the writer
        offsets[row["part"]], total = total, total + row["n"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, names, sizes, coded in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_ids", "n_tokens", "ids")), strict=True):
                ids = simple8b.decode(coded)
                ends = np.cumsum(np.array(sizes, np.int64))
                if len(ids) != ends[-1]:
                    raise ValueError(f"a segment of part {part} has {len(ids)} ids, not {ends[-1]}")
                own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                made = [pa.array(names, pa.int64()), pa.array(offsets[part] + before + ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(o.astype("<u4").tobytes()) for o in own], pa.int64())]
                made += [pa.array([o.astype(np.int64) for o in own], pa.list_(pa.int64()))] * keep_ids
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return stored.mapInArrow(decode, schema)
