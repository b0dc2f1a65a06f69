"""Simple-8b coding of token ids, in blocks that are coded and decoded with numpy.

A 64-bit word holds a selector in its top 4 bits and as many codes of equal width as fit in the other 60. A block has a
dictionary of its ids that occur more than once, most frequent first; an id's code is its place there, from 1 on. Code 0 is
the escape: the id itself stands in the block's list of escapes.

Segment layout, little-endian: ``S8B1``, number of blocks (u32); per block ids, words, dictionary entries, escapes (4 u32)
and the offset of its data in the segment (u64); then per block words (u64), dictionary (u32), escapes (u32).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
BLOCK = 1 << 14
#: (codes in a word, bits of a code) by selector; fixed values of the coding.
FORMS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in FORMS])
_LIMITS = np.array([1 << b for _, b in FORMS[:-1]], np.uint64)
_U = np.uint64


def pack(codes: np.ndarray) -> np.ndarray:
    """Words of codes below 2 ** 60; the last word may be filled up with zeros."""
    n = len(codes)
    padded = np.zeros(n + 64, np.uint64)
    padded[:n] = codes
    # The form that each code needs, then for each position the widest form that the codes from there on allow.
    need = np.searchsorted(_LIMITS, padded, "right").astype(np.uint8)
    form = np.full(n, len(FORMS) - 1, np.uint8)
    doubled, span = [need], 1
    while span < 60:
        doubled.append(np.maximum(doubled[-1][:-span], doubled[-1][span:]))
        span *= 2
    for s in range(len(FORMS) - 2, -1, -1):
        c = FORMS[s][0]
        k = c.bit_length() - 1
        worst = np.maximum(doubled[k][:n], doubled[k][c - (1 << k) : c - (1 << k) + n])
        form[worst <= s] = s
    jump, at, starts = _COUNT[form].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += jump[at]
    first = np.array(starts, np.int64)
    forms = form[first]
    words = forms.astype(np.uint64) << _U(60)
    for s in np.unique(forms):
        count, bits = FORMS[s]
        own = np.flatnonzero(forms == s)
        for j in range(count):
            words[own] |= padded[first[own] + j] << _U(bits * j)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n codes of packed words."""
    forms = (words >> _U(60)).astype(np.int64)
    counts = _COUNT[forms]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(forms):
        count, bits = FORMS[s]
        own = np.flatnonzero(forms == s)
        mask = _U((1 << bits) - 1)
        for j in range(count):
            out[first[own] + j] = (words[own] >> _U(bits * j)) & mask
    return out[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of ids below 2 ** 32."""
    heads, bodies = [], []
    n_blocks = -(-len(ids) // block)
    at = 8 + 24 * n_blocks
    for b in range(n_blocks):
        own = ids[b * block : (b + 1) * block].astype(np.uint32)
        values, place, times = np.unique(own, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        order = order[times[order] > 1]
        code = np.zeros(len(values), np.uint64)
        code[order] = np.arange(1, len(order) + 1)
        codes = code[place]
        words, escapes = pack(codes), own[codes == 0]
        body = words.astype("<u8").tobytes() + values[order].astype("<u4").tobytes() + escapes.astype("<u4").tobytes()
        heads.append(struct.pack("<4IQ", len(own), len(words), len(order), len(escapes), at))
        bodies.append(body)
        at += len(body)
    return b"".join([MAGIC, struct.pack("<I", n_blocks), *heads, *bodies])


def decode(segment: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks, which the offsets reach directly."""
    if segment[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    (n_blocks,) = struct.unpack_from("<I", segment, 4)
    out = [np.zeros(0, np.uint32)]
    for b in blocks if blocks is not None else range(n_blocks):
        n, n_words, n_known, n_escapes, at = struct.unpack_from("<4IQ", segment, 8 + 24 * b)
        codes = unpack(np.frombuffer(segment, "<u8", n_words, at), n)
        known = np.frombuffer(segment, "<u4", n_known, at + 8 * n_words)
        escapes = np.frombuffer(segment, "<u4", n_escapes, at + 8 * n_words + 4 * n_known)
        ids = np.empty(n, np.uint32)
        escaped = codes == 0
        ids[escaped] = escapes
        ids[~escaped] = known[codes[~escaped].astype(np.int64) - 1]
        out.append(ids)
    return np.concatenate(out)
