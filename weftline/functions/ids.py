"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixed_md5(prefix: str, c: Column) -> Column:
    """``<prefix>-<md5>``: with prefix ``doc-`` two dashes, as ids have been written so far."""
    return F.concat(F.lit(f"{prefix}-"), F.md5(c))


def args_md5(*columns: Column) -> Column:
    """md5 of the arguments joined by bars; null counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def relation_id(src: Column, tgt: Column) -> Column:
    return prefixed_md5("rel-", F.concat(src, tgt))


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(a, b), F.greatest(a, b)


def point_uuid(prefix: str, c: Column) -> Column:
    """Hex UUID of a vector: 16 bytes of SHA-256 with version 4 and variant bits, first three fields little-endian."""
    h = F.sha2(F.concat(F.lit(prefix), c), 256)
    pair = lambda i: F.substring(h, 2 * i + 1, 2)
    version = F.concat(F.lit("4"), F.substring(h, 14, 1))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.concat(F.lower(F.conv((nibble.bitwiseAND(F.lit(3)) + 8).cast("string"), 10, 16)), F.substring(h, 18, 1))
    return F.concat(pair(3), pair(2), pair(1), pair(0), pair(5), pair(4), pair(7), version, variant, *(pair(i) for i in range(9, 16)))


def point_id(prefix: str, c: Column) -> Column:
    """The vector store's number for an id: eight bytes of the UUID, little-endian, as an unsigned decimal string."""
    h = F.sha2(F.concat(F.lit(prefix), c), 256)
    pair = lambda i: F.substring(h, 2 * i + 1, 2)
    version = F.concat(F.lit("4"), F.substring(h, 14, 1))
    return F.conv(F.concat(pair(7), version, *(pair(i) for i in (5, 4, 3, 2, 1, 0))), 16, 10)
