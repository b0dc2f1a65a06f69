"""URL filter by rules, with a cascade of Bloom filters instead of a join.

A rule is ``host + path prefix`` (``com/en/``); it fits its host and every subdomain if the url's path starts with the
rule's path. The longest fitting rule decides. Every url yields its candidate rule strings (host suffix + path prefix,
for the path lengths that occur among the rules), and a candidate is a rule exactly if the cascade says so:

* level 1 encodes the listed keys; level 2 the unlisted keys of the universe that pass level 1; level 3 the listed keys
  that pass level 2; and so on until a level lets nothing wrong through.
* The universe is every candidate key of the corpus that is judged, so there are no false answers on it.

Size: the first level has as many bits per key as keep its false positives, the second level's keys, within one filter.
Where any filter would still pass ``max_filter_bytes``, keys are dealt by hash to shards with a cascade each, twice as many
until all fit, so there is no list and no universe that is too large. Urls are judged with as many shards at a time as fit
into ``resident_bytes``; each further pass rewrites the urls with the best rules so far.

Main path: DataFrame functions only. Filters are arrays of 64-bit words that arrive by scalar subquery, never by join; rules'
path lengths arrive in the same way, however many there are.

Nulls and odd input: a null url, or one without ``://``, has empty host and path, no rule and the verdict ``allow``;
an empty table gives an empty result; repeated urls are judged alike; columns besides ``url`` are kept as they are,
but for columns named like the new ones, which
are replaced. Of two fitting rules of one length the one with the longer host wins, and
a rule on both lists blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, without

BLOCK, ALLOW = "block", "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, lower-cased; then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw_host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(raw_host), path


def candidates(host: Column, path: Column, path_lengths: Column) -> Column:
    """Rule strings that could fit, longest first: every host suffix with every path prefix of a given length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(path_lengths, lambda n: n <= F.char_length(path)), lambda n: F.left(path, n))
    key = lambda s, p: F.struct((F.char_length(s) + F.char_length(p)).alias("len"), F.char_length(s).alias("host_len"), F.concat(s, p).alias("key"))
    every = F.flatten(F.transform(prefixes, lambda p: F.transform(suffixes, lambda s: key(s, p))))
    ordered = F.reverse(F.array_sort(every))
    return F.when(host != "", F.transform(ordered, lambda c: c["key"])).otherwise(F.array().cast("array<string>"))


def _bit_positions(key: Column, n_bits: int, n_hashes: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 1000 + j)), F.lit(n_bits)) for j in range(n_hashes)]


@dataclass
class Cascade:
    """``levels[i]`` is a one-row DataFrame (bits array<bigint>) with ``sizes[i]`` bits and ``hashes[i]`` hashes to a key."""

    levels: list[DataFrame] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)

    @property
    def n_bytes(self) -> int:
        return sum(self.sizes) // 8

    def with_filters(self, df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumns({f"__weft_{prefix}{i}": level.scalar() for i, level in enumerate(self.levels)}) if self.levels else df

    def passes(self, key: Column, bits: Column, level: int) -> Column:
        tests = [_test_bit(bits, p) for p in _bit_positions(key, self.sizes[level], self.hashes[level], level)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def listed(self, key: Column, prefix: str) -> Column:
        """Whether the key is on the list: the parity of the first level that rejects it, or of the last level."""
        n = len(self.levels)
        out = F.lit(n % 2 == 1)
        for i in reversed(range(n)):
            out = F.when(~self.passes(key, F.col(f"__weft_{prefix}{i}"), i), F.lit(i % 2 == 1)).otherwise(out)
        return out if n else F.lit(False)


def _test_bit(bits: Column, position: Column) -> Column:
    word = F.get(bits, F.shiftright(position, 6).cast("int"))
    return F.call_function("getbit", word, position.bitwiseAND(F.lit(63)).cast("int")) == 1


def _filter_row(keys: DataFrame, n_bits: int, n_hashes: int, level: int) -> DataFrame:
    """One row: the keys' Bloom filter as an array of words. Words are OR-ed before the shuffle; there are n_bits / 64 of them."""
    words = n_bits // 64
    set_bits = keys.select(F.explode(F.array(*_bit_positions(F.col("key"), n_bits, n_hashes, level))).alias("p"))
    set_bits = set_bits.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    zeros = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    merged = set_bits.unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def shard_of(key: Column, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n_shards)).cast("int")


def _build(universe: DataFrame, scratch: Scratch, label: str, bits_per_key: int, n_hashes: int, max_bits: int, max_levels: int) -> Cascade | None:
    """The cascade of one shard's distinct (key, listed). None where a filter would have more than ``max_bits``."""
    cascade = Cascade()
    inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    rest = outside.count()
    for level in range(max_levels):
        n = inside.count()
        if n == 0:
            return cascade
        # Each further bit to a key divides the false positives by 1.6; no more of them than the next filter can hold.
        per_key, most = bits_per_key, max(64, max_bits // bits_per_key)
        if level == 0 and rest * 0.6185**per_key > most / 2:
            per_key = math.ceil(math.log(most / 2 / rest) / math.log(0.6185))
        hashes = n_hashes if per_key == bits_per_key else max(n_hashes, round(0.69 * per_key))
        n_bits = -(-max(64, n * per_key) // 64) * 64
        if n_bits > max_bits:
            return None
        row = scratch.keep(_filter_row(inside, n_bits, hashes, level), f"{label}-bits{level}")
        cascade.levels.append(row)
        cascade.sizes.append(n_bits)
        cascade.hashes.append(hashes)
        probed = outside.withColumn("__weft_bits", row.scalar())
        wrong = scratch.keep(probed.filter(cascade.passes(F.col("key"), F.col("__weft_bits"), level)).select("key"), f"{label}-wrong{level}", small=True)
        inside, outside = wrong, inside
    raise ValueError(f"{max_levels} levels of the cascade were not enough")


def build_cascades(universe: DataFrame, scratch: Scratch, label: str, bits_per_key: int = 12, n_hashes: int = 4, max_filter_bytes: int = 8 << 20, max_levels: int = 40) -> list[Cascade]:
    """universe: distinct (key, listed) -> a cascade for every shard of the keys."""
    max_bits = max(8 * max_filter_bytes, 64)
    n_shards = max(1, -(-universe.filter("listed").count() * bits_per_key // max_bits))
    while True:
        parts = universe
        if n_shards > 1:
            parts = scratch.keep(universe.withColumn("shard", shard_of(F.col("key"), n_shards)).repartition("shard"), f"{label}-{n_shards}", ("shard",))
        cascades: list[Cascade] = []
        for s in range(n_shards):
            built = _build(parts.filter(F.col("shard") == s) if n_shards > 1 else parts, scratch, f"{label}-{n_shards}-{s}", bits_per_key, n_hashes, max_bits, max_levels)
            if built is None:
                break
            cascades.append(built)
        if len(cascades) == n_shards:
            return cascades
        n_shards *= 2


def _first_listed(df: DataFrame, cascades: list[Cascade], name: str, scratch: Scratch, resident_bytes: int) -> DataFrame:
    """df and the column ``__weft_<name>``: the place of the first of its keys that is listed, null if none is."""
    found = f"__weft_{name}"
    df = df.withColumn(found, F.lit(None).cast("int"))
    at = 0
    while at < len(cascades):
        own, room = [at], resident_bytes - cascades[at].n_bytes
        while own[-1] + 1 < len(cascades) and cascades[own[-1] + 1].n_bytes <= room:
            own.append(own[-1] + 1)
            room -= cascades[own[-1]].n_bytes
        for s in own:
            df = cascades[s].with_filters(df, f"{name}{s}_")

        def listed(key: Column) -> Column:
            if len(cascades) == 1:
                return cascades[0].listed(key, f"{name}0_")
            shard, out = shard_of(key, len(cascades)), F.lit(False)
            for s in own:  # noqa: B023
                out = F.when(shard == s, cascades[s].listed(key, f"{name}{s}_")).otherwise(out)
            return out

        first = F.array_position("__weft_keys", F.get(F.filter("__weft_keys", listed), F.lit(0))).cast("int")
        df = df.withColumn(found, F.least(found, first)).drop(*(f"__weft_{name}{s}_{i}" for s in own for i in range(len(cascades[s].levels))))
        at = own[-1] + 1
        if at < len(cascades):
            df = scratch.keep(df, f"{name}-judged{at}")
    return df


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", resident_bytes: int = 64 << 20, **options) -> DataFrame:
    """pages and the columns host, path, rule (null where none fits) and verdict. rules: (rule, verdict), verdict block or allow."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    host, path = url_parts(F.col(url))
    rules = rules.select(F.col("rule"), F.col("verdict")).filter(F.col("rule").isNotNull()).distinct()
    path_length = F.char_length("rule") - F.char_length(F.substring_index("rule", "/", 1))
    lengths = scratch.keep(rules.agg(F.array_sort(F.collect_set(path_length)).alias("n")), "lengths")  # as many as the longest path has characters
    judged = without(pages, "host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    judged = judged.withColumn("__weft_lengths", lengths.scalar())
    judged = judged.withColumn("__weft_keys", candidates(F.col("host"), F.col("path"), F.col("__weft_lengths"))).drop("__weft_lengths")
    keys = judged.select(F.explode("__weft_keys").alias("key"), F.lit(False).alias("blocked"), F.lit(False).alias("allowed"))
    listed = rules.select(F.col("rule").alias("key"), (F.col("verdict") == BLOCK).alias("blocked"), (F.col("verdict") == ALLOW).alias("allowed"))
    universe = keys.unionByName(listed).groupBy("key").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    universe = scratch.keep(universe, "universe")
    for name in ("blocked", "allowed"):
        cascades = build_cascades(universe.select("key", F.col(name).alias("listed")), scratch, name, **options)
        judged = _first_listed(judged, cascades, name, scratch, resident_bytes)
    # Both are places among one url's candidates, longest first: the earlier wins, the block list at a tie.
    blocks = F.col("__weft_blocked").isNotNull() & (F.col("__weft_allowed").isNull() | (F.col("__weft_blocked") <= F.col("__weft_allowed")))
    rule = F.get("__weft_keys", F.least("__weft_blocked", "__weft_allowed") - 1)
    judged = judged.withColumns({"rule": rule, "verdict": F.when(blocks, F.lit(BLOCK)).otherwise(F.lit(ALLOW))})
    return judged.drop(*[c for c in judged.columns if c.startswith("__weft_")])
