"""Burrows-Wheeler transforms of shards, and their merge by iterative interleave refinement.

A shard is a few sequences of symbols, each closed by a terminator. Its suffixes are sorted once, by prefix doubling. To merge,
one starts from the shards' lists of suffixes one after the other and refines the interleave: round h orders it by the first h
symbols, by one stable counting sort of the transforms' symbols, which keeps each shard's own order. Where the symbol or the
block of the round before changes, a new block begins; so after h rounds suffixes with h symbols in common share a block:
the common prefixes of length h and the repeated intervals, without sorting suffixes of different shards against each other.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Starts of the suffixes in order. ends: places of the terminators, which sort by place and before all symbols."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        at = rank[order]
        first = np.concatenate([[True], at[1:] != at[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(first) - 1
        if step > longest or first.all():
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank, step = key, 2 * step


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, block) of every suffix of all shards, in merged order: those of one block have ``depth`` symbols in common.

    shards: (symbols, ends), symbols from 1 to 65535 with 0 at the ends. Places count through the shards in turn.
    """
    base, places, symbols, follow, closed = 0, [], [], [], []
    for own, ends in shards:
        longest = int(np.diff(np.concatenate([[-1], ends])).max())
        order = suffix_order(own, ends, longest)
        before = own[order - 1]
        before[np.isin(order, np.concatenate([[0], ends[:-1] + 1]))] = 0
        # Stable order of the symbols before: where each suffix goes if it is lengthened by its symbol.
        by_symbol = np.argsort(before, kind="stable")
        to = np.empty(len(own), np.int64)
        to[by_symbol] = np.arange(len(own))
        places.append(order + base)
        symbols.append(before)
        follow.append(to + base)
        closed.append(base + np.arange(len(ends)))
        base += len(own)
    place, symbol, lengthen, terminators = np.concatenate(places), np.concatenate(symbols).astype(np.uint16), np.concatenate(follow), np.concatenate(closed)
    merged, block = np.arange(base), np.zeros(base, np.int64)
    n_end = len(terminators)
    for _ in range(depth):
        by = symbol[merged]
        order = np.argsort(by, kind="stable")[n_end:]  # those before which a sequence begins come first and end here
        by, came = by[order], block[order]
        new = np.concatenate([[True], (by[1:] != by[:-1]) | (came[1:] != came[:-1])])
        merged = np.concatenate([terminators, lengthen[merged[order]]])
        block = np.concatenate([np.zeros(n_end, np.int64), np.cumsum(new)])
    return place[merged], block
