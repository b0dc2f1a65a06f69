"""Media columns: telephony audio.

A payload is stored losslessly as 8-bit mu-law or A-law samples in an AU container, or as IMA ADPCM blocks (36 bytes, 4-bit
samples) in a WAV container; which of the three, a checksum of the payload decides, so that equal texts are equal media.
Samples are expanded by lookup tables, ADPCM is decoded with numpy across the blocks of all documents of a slice,
and the result is resampled to 16 kHz and stored as 16-bit PCM beside the media. What a reader reports comes from the stored
bytes: payload and media from the media, features from the PCM.

Stored PCM is split into phases, in two columns: ``pcm`` holds every second sample, ``pcm_rest`` what the mean of their
neighbours does not tell of the samples between. Any PCM comes back exactly; where it was interpolated the rest is zeros, which
pack well in a column of their own.

The codecs are pure functions of bytes, so equal payloads have equal media and features. Nulls and odd input: a null text
is an empty one; a payload is padded with byte 255 to a positive multiple of 576, so it is never empty; damaged media or PCM
raise ValueError; an empty table gives an empty result; repeated rows are stored each; other columns are kept, but for
columns named like the new ones, which are replaced.

Memory: tasks work on slices of ``SLICE`` bytes of payload or on one document, which needs about 60 times its size; a
row holds the media and up to 7.3 bytes of PCM for each of its bytes, so a text may have some 250 MB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded_batches, without

PAD, UNIT = 255, 576
RATE, TARGET_RATE = 8000, 16000
#: Bytes of an ADPCM block: a header of 4 bytes, then two samples to the byte.
BLOCK = 36
MULAW, ALAW = 1, 27  # encodings of the AU format (fixed values)
ADPCM = 0x11  # WAV format tag of IMA ADPCM (fixed value)
CODECS = ("mulaw", "alaw", "adpcm")
SLICE = 256 << 10


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law codes: inverted bits, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law codes: even bits inverted, 3 bits of exponent, 4 of mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, step = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, step, (step + 256) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """Quantiser steps of IMA ADPCM. Fixed values of the format."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724,
        796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
        20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


_PCM_HEAD = struct.Struct("<4sIIQ")
_MULAW, _ALAW, _STEPS = mulaw_table(), alaw_table(), step_table()
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)  # fixed values of the format
#: Change of the predictor by (step index, nibble), from the format's rule.
_SIZE = (_STEPS[:, None] >> 3) + np.where(np.arange(8) & 4, _STEPS[:, None], 0) + np.where(np.arange(8) & 2, _STEPS[:, None] >> 1, 0) + np.where(np.arange(8) & 1, _STEPS[:, None] >> 2, 0)
_CHANGE = np.concatenate([_SIZE, -_SIZE], axis=1).astype(np.int32).ravel()
#: Sixteen times the next step index by (step index, nibble).
_NEXT = 16 * np.clip(np.arange(89)[:, None] + _INDEX, 0, 88).astype(np.int32).ravel()


def write_au(samples: bytes, encoding: int = MULAW, rate: int = RATE) -> bytes:
    return struct.pack(">4s5I", b".snd", 24, len(samples), encoding, rate, 1) + samples


def read_au(media: bytes) -> tuple[bytes, int]:
    """(samples, encoding)."""
    magic, start, size, encoding, _, channels = struct.unpack_from(">4s5I", media)
    if magic != b".snd" or channels != 1 or len(media) != start + size:
        raise ValueError("not a complete one-channel AU file")
    return media[start:], encoding


def write_adpcm(blocks: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A WAV file of whole ADPCM blocks."""
    per_block = (block - 4) * 2 + 1
    fmt = struct.pack("<4sIHHIIHHHH", b"fmt ", 20, ADPCM, 1, rate, rate * block // per_block, block, 4, 2, per_block)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(blocks), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(blocks)) + blocks


def read_adpcm(media: bytes) -> tuple[bytes, int]:
    """(blocks, bytes of a block)."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<H", media, 20)[0] != ADPCM:
        raise ValueError("not an ADPCM WAV file")
    block, at = struct.unpack_from("<H", media, 32)[0], 20 + struct.unpack_from("<I", media, 16)[0]
    tag, size = struct.unpack_from("<4sI", media, at)
    if tag != b"data" or len(media) != at + 8 + size or size % block:
        raise ValueError("damaged ADPCM WAV file")
    return media[at + 8 :], block


def decode_adpcm(blocks: bytes, block: int = BLOCK) -> np.ndarray:
    """16-bit PCM of ADPCM blocks: one step decodes the same sample of every block."""
    raw = np.frombuffer(blocks, np.uint8).reshape(-1, block)
    predictor = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    nibbles = np.empty((2 * (block - 4), len(raw)), np.uint8)
    nibbles[0::2], nibbles[1::2] = raw[:, 4:].T & 15, raw[:, 4:].T >> 4
    out = np.empty((len(nibbles) + 1, len(raw)), np.int16)
    out[0] = predictor
    row = index * 16
    for k, nibble in enumerate(nibbles):
        at = row + nibble
        predictor = np.minimum(np.maximum(predictor + _CHANGE.take(at), -32768), 32767)
        row = _NEXT.take(at)
        out[k + 1] = predictor
    return out.T.ravel()


def resample(pcm: np.ndarray, ends: np.ndarray, factor: int = TARGET_RATE // RATE) -> np.ndarray:
    """Linear interpolation between neighbouring samples of the clips that end at ``ends``, in integers: results are the
    same on every machine. Row k holds the k-th of ``factor`` samples for each of the given ones."""
    wide = pcm.astype(np.int32)
    step = np.empty_like(wide)
    step[:-1] = wide[1:] - wide[:-1]
    step[ends - 1] = 0
    out = np.empty((factor, len(pcm)), np.int16)
    for k in range(factor):
        out[k] = wide + step * k // factor
    return out


def _between(first: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """What interpolation of the first phase says of the others."""
    return resample(first, ends, factor)[1:]


def write_pcm(phases: np.ndarray, ends: np.ndarray, rate: int = TARGET_RATE) -> list[tuple[bytes, bytes]]:
    """Each clip's stored PCM: a header with its first phase, and the differences of the others from their interpolation."""
    factor = len(phases)
    first = phases[0].astype("<i2")
    rest = (phases[1:] - _between(phases[0], ends, factor)).astype("<i2")  # modulo 2 ** 16, so that nothing is lost
    starts = np.concatenate([[0], ends[:-1]])
    return [(_PCM_HEAD.pack(b"PPCM", rate, factor, b - a) + first[a:b].tobytes(), rest[:, a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def read_pcm(stored: list[bytes], rests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(phases of all clips, their ends) of stored PCM of one factor."""
    heads = [_PCM_HEAD.unpack_from(x) for x in stored]
    factor = heads[0][2]
    n = np.array([h[3] for h in heads], np.int64)
    if any(h[0] != b"PPCM" or h[2] != factor or len(x) != _PCM_HEAD.size + 2 * h[3] or len(r) != 2 * (factor - 1) * h[3] for h, x, r in zip(heads, stored, rests, strict=True)):
        raise ValueError("damaged PCM")
    ends = np.cumsum(n)
    whole = np.empty((factor, ends[-1]), np.int16)
    for x, r, k, end in zip(stored, rests, n.tolist(), ends.tolist(), strict=True):
        whole[0, end - k : end] = np.frombuffer(x, "<i2", offset=_PCM_HEAD.size)
        whole[1:, end - k : end] = np.frombuffer(r, "<i2").reshape(factor - 1, k)
    whole[1:] += _between(whole[0], ends, factor)
    return whole, ends


def features(phases: np.ndarray, ends: np.ndarray) -> list[str]:
    """For each clip its samples, sum of sizes, mean square, peak and changes of sign, all in integers."""
    starts = np.concatenate([[0], ends[:-1]])
    size = np.abs(phases.astype(np.int64))
    total, peak = np.add.reduceat(size.sum(0), starts), np.maximum.reduceat(size.max(0), starts)
    square = np.add.reduceat((size * size).sum(0), starts)
    signs = phases < 0
    after = np.roll(signs[0], -1)
    after[ends - 1] = signs[-1, ends - 1]
    turns = np.add.reduceat((signs[1:] != signs[:-1]).sum(0) + (after != signs[-1]), starts)
    n = len(phases) * (ends - starts)
    return [f"{a}:{b}:{c // a}:{d}:{e}" for a, b, c, d, e in zip(n.tolist(), total.tolist(), square.tolist(), peak.tolist(), turns.tolist(), strict=True)]


def pad_all(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padded payloads one after the other, their ends)."""
    size = np.diff(offsets)
    ends = np.cumsum(np.maximum(-(-size // UNIT), 1) * UNIT)
    out = np.full(ends[-1] if len(ends) else 0, PAD, np.uint8)
    begins = np.concatenate([[0], ends[:-1]])[: len(size)]
    out[np.repeat(begins - offsets[:-1], size) + np.arange(offsets[0], offsets[-1])] = data
    return out, ends


def decode_all(data: np.ndarray, ends: np.ndarray, codecs: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Stored PCM of payloads that end at ``ends``: all documents of a codec are decoded at once."""
    starts = np.concatenate([[0], ends[:-1]])
    out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(ends)
    for codec in np.unique(codecs):
        rows = np.flatnonzero(codecs == codec)
        own = np.concatenate([data[starts[r] : ends[r]] for r in rows])
        size = ends[rows] - starts[rows]
        if codec == 2:
            pcm, size = decode_adpcm(own.tobytes()), size // BLOCK * ((BLOCK - 4) * 2 + 1)
        else:
            pcm = (_MULAW, _ALAW)[codec][own]
        for r, made in zip(rows, write_pcm(resample(pcm, np.cumsum(size)), np.cumsum(size)), strict=True):
            out[r] = made
    return out


def wrap(payload: bytes, codec: int) -> bytes:
    return write_adpcm(payload) if codec == 2 else write_au(payload, (MULAW, ALAW)[codec])


def unwrap(media: bytes) -> tuple[bytes, str]:
    """(payload, codec) of stored media."""
    if media[:4] == b"RIFF":
        return read_adpcm(media)[0], "adpcm"
    payload, encoding = read_au(media)
    return payload, {MULAW: "mulaw", ALAW: "alaw"}[encoding]


def store_audio(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, and the columns n_bytes, media (AU or WAV), pcm and pcm_rest (16 kHz, 16 bits, in phases)."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, "n_bytes", "media", "pcm", "pcm_rest")
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("pcm_rest", T.BinaryType())])
    at = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at))
            for i, j in K.slices(offsets, SLICE):
                own = offsets[i : j + 1]
                payloads, ends = pad_all(data[own[0] : own[-1]], own - own[0])
                raw, starts = payloads.tobytes(), np.concatenate([[0], ends[:-1]])
                each = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                codecs = np.array([zlib.crc32(x) % len(CODECS) for x in each], np.int64)
                media = [wrap(x, c) for x, c in zip(each, codecs.tolist(), strict=True)]
                rest = [c.slice(i, j - i) for k, c in enumerate(batch.columns) if k != at]
                pcm = decode_all(payloads, ends, codecs)
                made = [pa.array(np.diff(own)), pa.array(media, pa.binary()), *(pa.array([p[k] for p in pcm], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=schema.names)

    return docs.mapInArrow(encode, schema)


def write_audio(docs: DataFrame, path: str, text: str = "text", level: int = 12, page_bytes: int = 4 << 20) -> None:
    """Write ``store_audio`` as Parquet. level, page_bytes: PCM packs the better the more effort and the more samples a page has."""
    store_audio(docs, text).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.page.size", str(page_bytes)).parquet(path)


def read_audio(stored: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """stored without media, pcm and pcm_rest, and what was read back from them.

    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, feature, pcm_samples, and with ``keep_pcm``
    the 16-bit samples as ``samples``. ``feature``: codec, samples, sum of sizes, mean square, peak, changes of sign of the PCM.
    """
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("codec", T.StringType()), ("feature", T.StringType()), ("pcm_samples", T.LongType())]
    new += [("samples", T.BinaryType())] * keep_pcm
    bounded_batches(stored.sparkSession)
    stored = without(stored, *(n for n, _ in new))
    schema = T.StructType([*(f for f in stored.schema.fields if f.name not in ("media", "pcm", "pcm_rest")), *(T.StructField(*n) for n in new)])
    at_media, at_pcm, at_rest = (stored.columns.index(c) for c in ("media", "pcm", "pcm_rest"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(K.text_bytes(batch.column(at_media))[1], SLICE):
                part = batch.slice(i, j - i)
                media = part.column(at_media).to_pylist()
                phases, ends = read_pcm(part.column(at_pcm).to_pylist(), part.column(at_rest).to_pylist())
                starts, rows = np.concatenate([[0], ends[:-1]]), []
                for raw, said, a, b in zip(media, features(phases, ends), starts.tolist(), ends.tolist(), strict=True):
                    payload, codec = unwrap(raw)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), codec, f"{codec}:{said}", len(phases) * (b - a))
                    rows.append((*row, phases[:, a:b].T.astype("<i2").tobytes()) if keep_pcm else row)
                rest = [c for k, c in enumerate(part.columns) if k not in (at_media, at_pcm, at_rest)]
                made = [pa.array([r[k] for r in rows], type=_arrow(kind)) for k, (_, kind) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=schema.names)

    return stored.mapInArrow(decode, schema)


def read_stored(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_audio(spark.read.parquet(path), **options)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(kind)]
