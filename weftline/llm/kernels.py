"""Numpy over the bytes of many texts at once: words, their hashes, and slices of bounded size.

Words are runs of bytes of a class, so UTF-8 needs no decoding: every separator here is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20


def byte_class(chars: bytes) -> np.ndarray:
    """True for the bytes that belong to words: all but ``chars``."""
    table = np.ones(256, bool)
    table[list(chars)] = False
    return table


SPACES = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, SLICE + 1), base, U64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=U64)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or of a single text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all texts in order, and the number of the first word of each text (and the end)."""
    inside = table[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over random values of bytes, by prefix sums."""
    value = _BYTE if fold is None else _BYTE[fold]
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(value[data] * powers(_BASE, len(data)), out=sums[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lowered."""
    return span_hashes(data, starts, ends, LOWERED)


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k words in a row."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(_STEP) + words[j : j + n]
    return mix64(out)
