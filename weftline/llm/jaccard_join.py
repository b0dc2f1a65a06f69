"""Near-duplicates: all pairs of documents whose sets of word shingles have a Jaccard similarity of at least 75 %, as classes.

1. Documents with equal shingle sets are one class (a 128-bit digest of the sorted shingle hashes).
2. Shingles are counted over the corpus. A class can only be similar to another if they share one of its rarest
   ``n - ceil(3 n / 4) + 1`` shingles; shingles that no other class has need no tile. What is left are a few tiles per class of
   candidates: shingle -> classes that have it in that prefix.
3. Classes that share tiles, directly or through others, form candidate groups; every link lies inside one. A group that is
   too large for one task is cut into size-banded tiles (by size, then by hash), and every pair of tiles whose sizes can
   match is a task of its own, so that no group, however large, meets in one place. Groups of more than ``SPLIT_ABOVE``
   classes, which chains of chance shingles can make out of most of a corpus, are split first: in each list of classes under
   one shingle, bitmaps say which could be similar, and only classes that are connected so stay together.
4. In a tile pair each class has a bitmap of its hashed shingles. Bits of one bitmap that the other lacks bound the overlap
   from above; pairs that pass get an exact intersection of sorted arrays. Classes are visited along links, and a pair
   whose classes are already connected is not compared again: a group of k copies costs about k comparisons, not k * k, and
   sends k - 1 links on.
5. Connected components of those links.

The order of shingles decides only how many candidates there are, never which pairs are found. Very common shingles
(``HEAVY_SHARE`` of a block's classes or more) come last in it without being counted exactly; there are at most
(words per document) / share of them, whatever the corpus, and the list is cut at ``max_heavy``.

Shingles are compared by 64-bit hashes. Texts are scanned three times instead of being shuffled. A class is known by half of its
digest; classes that share that half, which is seen from the other half, are known by the other.

Nulls and odd input: a null, empty or blank text has no shingles, is linked with nothing and is its own component; a text
of fewer than five words is one shingle, its whole sequence; repeated rows are copies; an empty table gives an empty result;
a null document id belongs to its class, whose smallest id is not null if any is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, bounded_batches
from .components import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 3 / 4.
OVER, UNDER = 3, 4
HEAVY_SHARE = 0.004
BLOCK_BYTES = 4 << 20
TILE = 1500
SPLIT_ABOVE = 20 * TILE
U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in K.slices(offsets):
        part = offsets[i : j + 1]
        own = data[part[0] : part[-1]]
        starts, ends, first = K.word_spans(own, part - part[0], K.SPACES)
        words = K.word_hashes(own, starts, ends)
        rows = K.sequence_hashes(words, k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(rows[a : b - k + 1])
            else:
                yield K.sequence_hashes(words[a:b], b - a) if b > a else rows[:0]


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def class_id(shingles: np.ndarray, twice: set[int]) -> int:
    """Half of the class's digest; the other half if that is in ``twice``, the halves that several classes share."""
    first, second = class_key(shingles)
    return second if first in twice else first


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a similar set must have one."""
    return n - -(-OVER * n // UNDER) + 1


def needed(a: int, b: np.ndarray, ratio: tuple[int, int] = (OVER, UNDER)) -> np.ndarray:
    """Common shingles that sets of these sizes need."""
    return -(-ratio[0] * (a + b) // sum(ratio))


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, k: int = SHINGLE) -> Iterator[list[tuple[pa.RecordBatch, list[np.ndarray]]]]:
    """Batches with their texts' shingle sets, a few MB of text at a time."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(text_at))
        for i, j in K.slices(offsets, BLOCK_BYTES):
            part = offsets[i : j + 1]
            yield batch.slice(i, j - i), list(shingle_sets(data[part[0] : part[-1]], part - part[0], k))


def classify(docs: DataFrame, scratch: Scratch, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, cid, check, carried), (token, n)): the class of every document, and shingles that are common in some block."""
    more = [docs.schema[c] for c in carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "cid", "check", *carried]
        for block, sets in _blocks(batches, 1):
            keys = [class_key(s) if len(s) else (0, 0) for s in sets]
            cid, check = (np.array([k[x] for k in keys], np.int64) for x in (0, 1))
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), block.column(0), pa.array(n), pa.array(cid), pa.array(check), *block.columns[2:]], names=names)
            own = list({k: s for k, s in zip(keys, sets, strict=True)}.values())
            tokens, times = np.unique(np.concatenate(own), return_counts=True)
            common = times >= max(8, HEAVY_SHARE * len(own))
            tokens, times = tokens[common], times[common].astype(np.int64)
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), none, pa.array(times), pa.array(tokens.view(np.int64)), none, *(pa.nulls(len(tokens), c.type) for c in block.columns[2:])], names=names)

    schema = ", ".join(["kind int, doc_id bigint, n bigint, cid bigint, check bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])
    scanned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carried).mapInArrow(scan, schema)
    scanned = scratch.keep(scanned, "scan", ("kind",))
    classes = scanned.filter("kind = 0").select("doc_id", "n", "cid", "check", *carried)
    return classes, scanned.filter("kind = 1").select(F.col("cid").alias("token"), "n")


def heavy_tokens(common: DataFrame, n_classes: int, max_heavy: int = 500_000) -> np.ndarray:
    """Sorted shingles that stand last in the order, at most ``max_heavy``."""
    total = common.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_SHARE * n_classes / 2)
    rows = total.orderBy(F.desc("n"), "token").limit(max_heavy).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def _is_in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


def _runs(cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], cids[1:] != cids[:-1]])) if len(cids) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(cids)))


_POSTINGS = "bucket int, kind int, cids binary, sizes binary, tokens binary, extra binary"


def _row(bucket: int, kind: int, *blobs: np.ndarray) -> tuple:
    return (int(bucket), kind, *(b.tobytes() for b in blobs))


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "cids", "sizes", "tokens", "extra"])


def _column(t: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def tiles(docs: DataFrame, heavy: np.ndarray, n_shingles: int, twice: set[int], per_bucket: int = 1_000_000) -> DataFrame:
    """(token, cid): the classes that need a partner on one of their rarest shingles, under those shingles.

    Two shuffles of packed arrays: shingles to hash buckets of about ``per_bucket`` shingles, where they are counted; those that
    occur more than once go on to buckets of classes, where each class picks its prefix.
    """
    n_buckets = max(1, -(-n_shingles // per_bucket))
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most max_heavy
    empty = np.zeros(0, np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for _, sets in _blocks(batches, 0):
            own = {class_id(s, twice): s for s in sets if len(s)}
            if not own:
                continue
            cids = np.fromiter(own, np.int64, len(own))
            size = np.array([len(s) for s in own.values()])
            tokens, of = np.concatenate(list(own.values())), np.repeat(np.arange(len(cids)), size)
            common = _is_in(tokens, heavy)
            n_heavy = np.bincount(of[common], minlength=len(cids))
            # Only a class with few other shingles can need common ones: as many as its prefix is long, in their order.
            short = [k for k in range(len(cids)) if size[k] - n_heavy[k] < prefix_length(int(size[k]))]
            spare = {k: (s := tokens[size[:k].sum() : size[: k + 1].sum()])[_is_in(s, heavy)][: prefix_length(int(size[k]))] for k in short}
            rows = []
            home = (cids.view(np.uint64) % U(n_buckets)).astype(np.int64)
            for q in np.unique(home):
                at = np.flatnonzero(home == q)
                spares = [spare.get(k, np.zeros(0, np.uint64)) for k in at]
                rows.append(_row(q, 1, cids[at], np.stack([size[at], n_heavy[at], [len(s) for s in spares]], 1).astype(np.int64), np.concatenate(spares), empty))
            tokens, of = tokens[~common], of[~common]
            bucket = (tokens >> U(32)) % U(n_buckets)
            order = np.argsort(bucket.astype(np.uint16), kind="stable") if n_buckets < 65536 else np.argsort(bucket, kind="stable")
            for start, n in zip(*_runs(bucket[order]), strict=True):
                at = order[start : start + n]
                starts, sizes = _runs(of[at])
                rows.append(_row(bucket[at[0]], 0, cids[of[at[starts]]], sizes.astype(np.uint32), tokens[at].astype(np.uint32), empty))
            yield from _rows(rows).to_batches()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        info = table.filter(pc.equal(table.column("kind"), 1))
        rows = [tuple(r.values()) for r in info.to_pylist()]
        own = table.filter(pc.equal(table.column("kind"), 0))
        listed, sizes = _column(own, "cids", np.int64), _column(own, "sizes", np.uint32)
        # A class comes whole from every block that has it; one of them counts.
        once = np.zeros(len(listed), bool)
        once[np.unique(listed, return_index=True)[1]] = True
        once = np.repeat(once, sizes)
        cids, tokens = np.repeat(listed, sizes)[once], _column(own, "tokens", np.uint32)[once]
        order = np.lexsort((cids, tokens))
        cids, tokens = cids[order], tokens[order]
        _, times = _runs(tokens)
        times = np.repeat(times, times)
        cids, tokens, times = cids[times > 1], tokens[times > 1], times[times > 1]
        home = (cids.view(np.uint64) % U(n_buckets)).astype(np.int64)
        order = np.lexsort((cids, home))
        for start, n in zip(*_runs(home[order]), strict=True):
            at = order[start : start + n]
            starts, sizes = _runs(cids[at])
            rows.append(_row(home[at[0]], 0, cids[at[starts]], sizes.astype(np.uint32), tokens[at].astype(np.uint64) | U(bucket) << U(32), times[at].astype(np.uint32)))
        return _rows(rows)

    def choose(table: pa.Table) -> pa.Table:
        own, info = (table.filter(pc.equal(table.column("kind"), k)) for k in (0, 1))
        known = _column(info, "sizes", np.int64).reshape(-1, 3)
        ids, first = np.unique(_column(info, "cids", np.int64), return_index=True)
        size, n_heavy = known[first, 0], known[first, 1]
        spare_end = np.cumsum(known[:, 2])
        spares = _column(info, "tokens", np.uint64)
        cids = np.repeat(_column(own, "cids", np.int64), _column(own, "sizes", np.uint32))
        tokens, times = _column(own, "tokens", np.uint64), _column(own, "extra", np.uint32)
        order = np.lexsort((tokens, times, cids))
        cids, tokens = cids[order], tokens[order]
        starts, shared_n = np.searchsorted(cids, ids), np.searchsorted(cids, ids, "right") - np.searchsorted(cids, ids)
        prefix = size - -(-OVER * size // UNDER) + 1
        want = np.maximum(0, prefix - (size - n_heavy - shared_n))
        light = np.minimum(want, shared_n)
        row = np.repeat(np.arange(len(ids)), light)
        picked = tokens[np.repeat(starts - (np.cumsum(light) - light), light) + np.arange(light.sum())] if light.sum() else tokens[:0]
        out_t, out_c = [picked], [ids[row]]
        for k in np.flatnonzero(want > shared_n):
            end = spare_end[first[k]]
            rest = spares[end - known[first[k], 2] : end][: want[k] - shared_n[k]]
            # Tiles of common shingles are kept apart from the others' by their own hash.
            out_t.append(K.mix64(rest))
            out_c.append(np.full(len(rest), ids[k]))
        return pa.table({"token": np.concatenate(out_t).view(np.int64), "cid": np.concatenate(out_c)})

    posted = docs.select("text").mapInArrow(scatter, _POSTINGS)
    counted = posted.groupBy("bucket").applyInArrow(count, _POSTINGS)
    return counted.groupBy("bucket").applyInArrow(choose, "token bigint, cid bigint")


def similar_in(arrays: list[np.ndarray], sides: np.ndarray | None = None, exact: bool = True, ratio: tuple[int, int] = (OVER, UNDER)) -> list[tuple[int, int]]:
    """Links that connect all similar sets, as (later, first) numbers. With sides, only pairs of different sides count.

    Not exact: all pairs that can be similar by their bitmaps are linked; the arrays may then hold 16 bits of each shingle.
    """
    m, (over, under) = len(arrays), ratio
    size = np.array([len(a) for a in arrays])
    width = 256
    while width < 8 * size.max() and width < (8192 if exact else 65536):
        width *= 2
    flat, start = np.concatenate(arrays), np.cumsum(size) - size
    bits = np.zeros((m, width // 64), np.uint64)
    at = flat.astype(np.uint64) & U(width - 1)
    np.bitwise_or.at(bits, (np.repeat(np.arange(m), size), (at >> U(6)).astype(np.int64)), U(1) << (at & U(63)))
    left = np.ones(m, bool)
    links: list[tuple[int, int]] = []
    for seed in range(m):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            other = np.flatnonzero(left & (over * size <= under * size[x]) & (under * size >= over * size[x]))
            if sides is not None:
                other = other[sides[other] != sides[x]]
            if not len(other):
                continue
            need = needed(int(size[x]), size[other], ratio)
            common = np.bitwise_count(bits[other] & ~bits[x]).sum(1, dtype=np.int64)
            bound = np.minimum(size[other] - common, size[x] - np.bitwise_count(bits[x] & ~bits[other]).sum(1, dtype=np.int64))
            other, need = other[bound >= need], need[bound >= need]
            if not len(other):
                continue
            if exact:
                n = size[other]
                ends = np.cumsum(n)
                joined = flat[np.repeat(start[other] - (ends - n), n) + np.arange(ends[-1])]
                found = np.add.reduceat(_is_in(joined, arrays[x]).astype(np.int64), ends - n)
                other = other[found >= need]
            for y in other:
                left[y] = False
                links.append((int(y), seed))
                queue.append(y)
    return links


def class_sets(docs: DataFrame, classes: DataFrame, twice: set[int], bloom_bytes: int = 16 << 20, narrow: bool = False, k: int = SHINGLE) -> DataFrame:
    """classes (cid) -> (cid, shingles, n), one row each, and some others. Narrow: the low 16 bits of each shingle, enough for bitmaps."""
    spark = docs.sparkSession
    n = classes.count()
    # A filter of the wanted classes (one bit by hash) spares other sets the shuffle; beyond its bound every set is shuffled.
    n_bits = 1 << max(10, (10 * n).bit_length())
    wanted = None
    if n_bits // 8 <= bloom_bytes:
        rows = classes.select(F.pmod("cid", F.lit(n_bits)).alias("p")).distinct()
        words = rows.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        bits = np.zeros(n_bits // 64, np.uint64)
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
        wanted = spark.sparkContext.broadcast(bits)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, sets in _blocks(batches, 0, k):
            found: dict[int, np.ndarray] = {}
            for s in sets:
                if len(s) and (cid := class_id(s, twice)) not in sent:
                    p = cid % n_bits
                    if wanted is None or int(wanted.value[p >> 6]) >> (p & 63) & 1:
                        found[cid] = s
            if len(sent) < 1_000_000:
                sent.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([(s.astype(np.uint16) if narrow else s).tobytes() for s in found.values()], pa.binary()), pa.array([len(s) for s in found.values()], pa.int64())], names=["cid", "shingles", "n"])

    return docs.select("text").mapInArrow(arrays, "cid bigint, shingles binary, n bigint").dropDuplicates(["cid"])


def meet(sets: DataFrame, scratch: Scratch, label: str, tile: int, pack_words: int, exact: bool = True, ratio: tuple[int, int] = (OVER, UNDER)) -> DataFrame:
    """sets (root, cid, shingles, n) -> links (a, b) that connect the similar classes of each root; a class can have several roots."""
    sets = scratch.keep(sets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio[1] / ratio[0])) + 1e-9).cast("int")), label)
    per_group = scratch.keep(sets.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("words")), f"{label}-sizes", small=True)
    small = per_group.filter((F.col("k") <= tile) & (F.col("words") <= 4 * pack_words))
    large = per_group.join(small, "root", "left_anti").select("root")
    # Small groups share tasks of about pack_words shingles.
    total = small.agg(F.sum("words")).first()[0] or 0
    packs = max(1, -(-total // pack_words))
    in_packs = sets.join(small.select("root"), "root", "left_semi").select(F.concat(F.lit("p"), F.pmod(F.xxhash64("root"), F.lit(packs))).alias("unit"), F.lit(0).alias("side"), "root", "cid", "shingles")
    # Large groups: tiles by band and hash; tiles of one band or of neighbouring bands meet.
    banded = sets.join(large, "root", "left_semi")
    in_band = banded.groupBy("root", "band").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / (4 * pack_words))).cast("int").alias("parts"))
    banded = banded.join(in_band, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    next_parts = in_band.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    last_parts = in_band.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    banded = banded.join(next_parts, ["root", "band"], "left").join(last_parts, ["root", "band"], "left")
    me = lambda b, x: F.concat_ws(":", b.cast("string"), x.cast("string"))
    unit = lambda a, b: F.concat_ws("|", F.lit("t"), F.col("root").cast("string"), a, b)
    band, part = F.col("band"), F.col("part")
    none = F.array().cast("array<struct<unit:string,side:int>>")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    same = F.transform(up_to("parts"), lambda x: F.struct(unit(me(band, F.least(part, x)), me(band, F.greatest(part, x))).alias("unit"), F.when(x == part, 0).when(part < x, 1).otherwise(2).alias("side")))
    above = F.when(F.col("above").isNotNull(), F.transform(up_to("above"), lambda x: F.struct(unit(me(band, part), me(band + 1, x)).alias("unit"), F.lit(1).alias("side")))).otherwise(none)
    below = F.when(F.col("below").isNotNull(), F.transform(up_to("below"), lambda x: F.struct(unit(me(band - 1, x), me(band, part)).alias("unit"), F.lit(2).alias("side")))).otherwise(none)
    in_tiles = banded.select(F.explode(F.concat(same, above, below)).alias("u"), "root", "cid", "shingles").select("u.unit", "u.side", "root", "cid", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        root, cid, side = (table.column(c).to_numpy() for c in ("root", "cid", "side"))
        raw = table.column("shingles").to_pylist()
        order = np.lexsort((cid, root))
        starts, sizes = _runs(root[order])
        a: list[int] = []
        b: list[int] = []
        for s, k in zip(starts, sizes, strict=True):
            at = order[s : s + k]
            if k > 1:
                for y, x in similar_in([np.frombuffer(raw[i], np.uint64 if exact else np.uint16) for i in at], side[at] if side[at].any() else None, exact, ratio):
                    a.append(cid[at[y]])
                    b.append(cid[at[x]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_packs.unionByName(in_tiles).groupBy("unit").applyInArrow(compare, "a bigint, b bigint")


def split_groups(docs: DataFrame, found: DataFrame, groups: DataFrame, scratch: Scratch, twice: set[int], above: int = SPLIT_ABOVE, tile: int = TILE, pack_words: int = 400_000) -> DataFrame:
    """found (token, cid), groups (cid, root) -> groups with those of more than ``above`` classes split; classes that nothing can be similar to are left out.

    Two similar classes share a shingle of ``found`` and pass by their bitmaps, so they meet in its list and stay together.
    """
    giant = scratch.keep(groups.groupBy("root").count().filter(F.col("count") > above).select("root"), "giant", small=True)
    if giant.isEmpty():
        return groups
    members = scratch.keep(groups.join(giant, "root", "left_semi").select("cid"), "giant-members")
    listed = found.join(members, "cid", "left_semi").select("cid", F.col("token").alias("root"))
    entries = class_sets(docs, members, twice, narrow=True).join(listed, "cid")
    links = meet(entries, scratch, "lists", tile, pack_words, exact=False)
    parts = components(links, scratch, "parts").withColumnRenamed("node", "cid")
    scratch.drop("lists")
    return scratch.keep(groups.join(giant, "root", "left_anti").select("cid", "root").unionByName(parts.select("cid", "root")), "split-groups")


def link_candidates(docs: DataFrame, groups: DataFrame, scratch: Scratch, twice: set[int], tile: int = TILE, bloom_bytes: int = 16 << 20, pack_words: int = 400_000) -> DataFrame:
    """groups (cid, root) -> links (a, b) between similar classes."""
    return meet(class_sets(docs, groups.select("cid"), twice, bloom_bytes).join(groups, "cid"), scratch, "sets", tile, pack_words)


def jaccard_classes(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), one row per document.

    With ``carried`` columns of docs, these and ``group`` as well: a number for each component, null for a text without shingles. It tells
    apart what a component's smallest id does not where different texts share an id.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    classes, common = classify(docs, scratch, carried)
    docs = docs.select("doc_id", "text")
    classes, twice, seen = tell_apart(classes)
    found = tiles(docs, heavy_tokens(common, seen["k"]), seen["n"] or 0, twice)
    found = scratch.keep(found, "tiles")
    least = found.groupBy("token").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).filter("top > b")
    found = found.join(least, "token")
    groups = components(found.select(F.col("cid").alias("a"), "b"), scratch, "groups").withColumnRenamed("node", "cid")
    groups = split_groups(docs, found, groups, scratch, twice)
    links = scratch.keep(link_candidates(docs, groups, scratch, twice), "links", small=True)
    scratch.drop("tiles", "sets")
    return by_document(classes, links, scratch, carried)


def tell_apart(classes: DataFrame) -> tuple[DataFrame, set[int], Row]:
    """classes (doc_id, n, cid, check, ...) with cids that no two of them share; the halves that several share; k classes of n shingles together."""
    by_half = classes.filter("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    seen = by_half.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum((F.col("lo") != F.col("hi")).cast("int")).alias("clash")).first()
    twice: set[int] = set()
    if seen["clash"]:
        # About k * k / 2 ** 65 of k classes: a handful at ten billion.
        twice = {r["cid"] for r in by_half.filter("lo <> hi").select("cid").collect()}
        classes = classes.withColumn("cid", F.when(F.col("cid").isin(*twice), F.col("check")).otherwise(F.col("cid")))
    return classes, twice, seen


def by_document(classes: DataFrame, links: DataFrame, scratch: Scratch, carried: tuple[str, ...] = ()) -> DataFrame:
    """classes (doc_id, n, cid, carried), links (a, b) between similar ones -> (doc_id, n_shingles, component_id), see ``jaccard_classes``."""
    roots = components(links, scratch, "links").withColumnRenamed("node", "cid")
    # Smallest ids by class, then by component of linked classes; a class with a third of all documents is summed up before it
    # is shuffled, and documents meet their class in a plain join, whose large keys Spark can split.
    least = classes.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    linked = scratch.keep(least.join(roots, "cid"), "linked")
    components_least = scratch.keep(linked.groupBy("root").agg(F.min("least").alias("component")), "component-ids")
    by_class = least.join(linked.select("cid", "root").join(components_least, "root"), "cid", "left").select("cid", F.coalesce("component", "least").alias("component"), F.coalesce("root", "cid").alias("group"))
    by_class = scratch.keep(by_class, "class-ids")
    key = F.when(F.col("n") > 0, F.col("cid"))
    out = classes.withColumn("cid", key).join(by_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *((*carried, "group") if carried else ()))
