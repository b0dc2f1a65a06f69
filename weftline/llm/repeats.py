"""Removing repeated passages: every byte covered by a string of 100 bytes that also starts earlier in the corpus.

1. Every window of ``LENGTH`` bytes has an anchor, the 16 bytes in it with the smallest hash (the first of them at a tie). Equal
   windows have equal anchors at equal offsets, so all occurrences of a window meet under their anchor's hash. Neighbouring
   windows with one anchor form a segment; about one byte in forty is an anchor.
2. Segments with equal bytes: all but the first are repeats as a whole. Repeats inside a slice of a task are settled there, so
   that a hot passage sends one row per slice.
3. What is left are first segments whose anchor also occurs in a different segment: copies begin, end or differ there. Their
   windows are dealt by ``RANGE`` neighbouring offsets of the anchor; windows of one range share a core of bytes, and only rows
   with equal cores can have windows in common. In each task such rows, with the core as one symbol between their
   fringes, form shards; the shards' Burrows-Wheeler transforms are merged (``bwt_merge``), and the blocks of suffixes with a
   whole window in common are the repeated intervals.
4. The intervals of a document are united, and what they leave is hashed.

"Earlier": smaller document id (null first), then the hash of the text, then the start. Bytes are compared by 64-bit hashes
of anchors, segments and cores, fringes byte by byte.

Nulls and odd input: a null text is empty; texts of fewer than 100 bytes lose nothing; of rows repeated with id and text the
first keeps its bytes; different texts under one id are told apart by their 64-bit hash; an empty table gives an
empty result; a text may have what a row may, 2 GB; other columns are ignored. No group is gathered: tasks stream sorted rows, and a core with more than
``CHUNK`` rows is worked off in pieces that pass on hashes of the windows seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bwt_merge import repeated
from .common import Scratch, bounded_batches

LENGTH = 100
GRAM = 16
SPREAD = LENGTH - GRAM + 1
RANGE = 17
SLICE = 4 << 20
CHUNK = 30_000
SHARDS = 4
U = np.uint64
_BASES = [pow(K._BASE, 1 << i, 1 << 64) for i in range(4)]
#: A place packs 31 bits of the segment's start, 7 of its windows and 7 of the anchor's offset.
_WHOLE = 127
#: Rows of a merge: every one of them may have a core of its own, and symbols have 16 bits.
MOST = 60_000


def _place(start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 14) | (n << 7) | offset


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return (place >> 14) & 0x7FFFFFFF, (place >> 7) & 127, place & 127


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, anchor's hash) of every segment of the texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(np.uint64)
    grams, span = K._BYTE[data], 1
    for base in _BASES:
        grams = grams[:-span] * U(base) + grams[span:]
        span *= 2
    grams = K.mix64(grams)
    least, span = (grams >> U(31) << U(31)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * span <= SPREAD:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (SPREAD - span)], least[SPREAD - span :])
    whole = np.ones(len(data), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        whole[max(a, b - LENGTH + 1) : b] = False
    windows = np.flatnonzero(whole)
    at = (least[windows] & U((1 << 31) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else none
    last = np.append(first[1:], len(at)) - 1 if len(at) else none
    return at[first], windows[first], windows[last], grams[at[first]]


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow array of spans of bytes."""
    sizes = ends - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


_SEGMENT = ["key", "seg", "doc", "tie", "place"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> segments (key, seg, doc, tie, place), and repeats inside a slice as intervals with offset 127."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(2))
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j in K.slices(offsets, SLICE):
            part = offsets[i : j + 1]
            own, part = data[part[0] : part[-1]], part - part[0]
            at, lo, hi, key = anchors(own, part)
            row = np.searchsorted(part, lo, "right") - 1
            doc, tie, start = ids[i:j][row], ties[i:j][row], lo - part[row]
            seg = K.span_hashes(own, lo, hi + LENGTH)
            order = np.lexsort((start, tie, doc, seg, key))
            same = lambda x: np.concatenate([[False], x[order][1:] == x[order][:-1]])
            again = same(key) & same(seg)
            twin = again & same(doc) & same(tie) & same(start)
            repeat = np.zeros(len(order), bool)
            repeat[order[again & ~twin]] = True
            fresh = np.zeros(len(order), bool)
            fresh[order[~again]] = True
            # A twin of a row that is a repeat is one as well; its row is the same and adds nothing.
            run = np.flatnonzero(repeat)
            if len(run):
                begins = np.concatenate([[True], (run[1:] != run[:-1] + 1) | (row[run[1:]] != row[run[:-1]])])
                a, b = run[begins], run[np.append(np.flatnonzero(begins)[1:], len(run)) - 1]
                size = hi[b] + LENGTH - lo[a]
                spread = K.mix64(doc[a].astype(np.uint64) * U(31) + start[a].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (spread, size, doc[a], tie[a], _place(start[a], 0 * size, 0 * size + _WHOLE))], names=_SEGMENT)
            f = np.flatnonzero(fresh)
            made = (key[f].view(np.int64), seg[f].view(np.int64), doc[f], tie[f], _place(start[f], hi[f] - lo[f] + 1, at[f] - lo[f]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=_SEGMENT)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments -> (kind, doc, tie, place, size): repeats as intervals (kind 0), first segments of shared anchors (kind 1)."""
    last = None  # the row before: key, seg, doc, tie, place
    held = None  # the last first segment, whose neighbour is not known yet, and whether it shares its key with the one before

    def out(kind: int, rows: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(size), kind, np.int32)), *(pa.array(v) for v in (*rows, size))], names=["kind", "doc", "tie", "place", "size"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        done = (rows[4] & 127) == _WHOLE
        if done.any():
            yield out(0, rows[2:, done], rows[1, done])
        rows = rows[:, ~done]
        if not rows.shape[1]:
            continue
        before = np.concatenate([rows[:, :1] if last is None else last, rows[:, :-1]], axis=1)
        equal = rows == before
        if last is None:
            equal[:, 0] = False
        last = rows[:, -1:]
        again = equal[0] & equal[1]
        repeat = again & ~(equal[2] & equal[3] & equal[4])
        if repeat.any():
            n = (rows[4, repeat] >> 7) & 127
            yield out(0, rows[2:, repeat], n - 1 + LENGTH)
        first = rows[:, ~again]
        if not first.shape[1]:
            continue
        key = first[0]
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        if held is not None:
            joins = held[0][0] == key[0]
            shared[0] |= joins
            if held[1] or joins:
                yield out(1, held[0][2:, None], np.zeros(1, np.int64))
        held = (first[:, -1], bool(shared[-1]))
        use = np.flatnonzero(shared[:-1])
        if len(use):
            yield out(1, first[2:, use], np.zeros(len(use), np.int64))
    if held is not None and held[1]:
        yield out(1, held[0][2:, None], np.zeros(1, np.int64))


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Rows (doc, tie, place, size, text) sorted with texts before what belongs to them, in pieces: texts' bytes and offsets, the text
    of every other row (its number), those rows' numbers in the piece, the piece. A piece starts with a text."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        sizes = batch.column(4).cast(pa.large_binary())
        room = np.diff(K.text_bytes(sizes)[1])
        upto = np.concatenate([[0], np.cumsum(room)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE, "right")) - 1)
            piece = batch.slice(i, j - i)
            if carry is not None:
                piece = pa.Table.from_batches([carry, piece]).combine_chunks().to_batches()[0]
            is_text = pc.is_null(piece.column(2)).to_numpy(zero_copy_only=False)
            texts, others = np.flatnonzero(is_text), np.flatnonzero(~is_text)
            data, offsets = K.text_bytes(piece.column(4).filter(pa.array(is_text)))
            yield data, offsets, np.searchsorted(texts, others, "right") - 1, others, (piece, texts, carry is not None)
            carry = piece.slice(int(texts[-1]), 1)
            i = j


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their shared segments -> per range of offsets: core, doc, tie, place of the anchor, offsets, fringes."""
    for data, offsets, text, others, (piece, _, _) in _with_texts(batches):
        if not len(others):
            continue
        doc, tie = piece.column(0).to_numpy()[others], piece.column(1).to_numpy()[others]
        start, n, off = _unplace(piece.column(2).take(pa.array(others)).to_numpy())
        at = offsets[text] + start + off
        for k in range(SPREAD // RANGE):
            o1, o2 = k * RANGE, (k + 1) * RANGE - 1
            near, far = np.maximum(o1, off - n + 1), np.minimum(o2, off)
            use = near <= far
            a, near, far = at[use], near[use], far[use]
            core = K.span_hashes(data, a - o1, a - o2 + LENGTH) + U(k)
            made = [core.view(np.int64), doc[use], tie[use], _place((start + off)[use], near, far)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in made), _binary(data, a - far, a - o1), _binary(data, a - o2 + LENGTH, a - near + LENGTH)], names=["core", "doc", "tie", "place", "left", "right"])


def _repeats_in(core: np.ndarray, place: np.ndarray, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, window) of all windows of rows of shared cores; equal windows have equal numbers. Rows lie core by core."""
    _, near, far = _unplace(place)
    names = np.cumsum(np.concatenate([[True], core[1:] != core[:-1]])) + 256
    (ld, lo), (rd, ro) = K.text_bytes(left), K.text_bytes(right)
    ln, rn = np.diff(lo), np.diff(ro)
    size = ln + rn + 2
    shards, starts = [], []
    base = 0
    for part in np.array_split(np.arange(len(core)), min(SHARDS, len(core))):
        ends = np.cumsum(size[part]) - 1
        begins = ends - size[part] + 1
        symbols = np.zeros(size[part].sum(), np.int64)
        put = lambda at, n: np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        symbols[put(begins, ln[part])] = ld[lo[part[0]] : lo[part[-1] + 1]].astype(np.int64) + 1
        symbols[begins + ln[part]] = names[part]
        symbols[put(begins + ln[part] + 1, rn[part])] = rd[ro[part[0]] : ro[part[-1] + 1]].astype(np.int64) + 1
        shards.append((symbols, ends))
        starts.append(begins + base)
        base += len(symbols)
    at, block = repeated(shards, RANGE)
    begins = np.concatenate(starts)
    row = np.searchsorted(begins, at, "right") - 1
    shift = at - begins[row]
    windows = far[row] - near[row] + 1
    use = shift < windows
    return row[use], far[row[use]] - shift[use], block[use]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core, doc, tie and place -> intervals (doc, tie, place, size) of windows that have occurred in an earlier row."""
    waiting: list[pa.RecordBatch] = []
    seen: tuple[int, np.ndarray] | None = None  # of a core that is worked off in pieces: hashes of windows

    def work(table: pa.Table, unfinished: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seen
        core = table.column("core").to_numpy()
        known = seen if seen is not None and core[0] == seen[0] else None
        alone = np.concatenate([[True], core[1:] != core[:-1]]) & np.concatenate([core[1:] != core[:-1], [True]])
        if known is not None or unfinished:
            alone &= core != (known[0] if known is not None else core[-1])
        table = table.filter(pa.array(~alone))
        core = core[~alone]
        seen = None
        # The rows of one core share its symbol; there are at most MOST rows, so symbols suffice.
        if not len(core):
            return
        table = table.combine_chunks()
        left, right = (table.column(c).combine_chunks() for c in ("left", "right"))
        doc, tie, place = (table.column(c).to_numpy() for c in ("doc", "tie", "place"))
        row, offset, window = _repeats_in(core, place, left, right)
        order = np.lexsort((row, window))
        row, offset, window = row[order], offset[order], window[order]
        # All occurrences of a window outside the first row that has it.
        first = np.concatenate([[True], window[1:] != window[:-1]])
        again = row != row[first][np.cumsum(first) - 1]
        if known is not None or unfinished:
            hot = core[row] == (core[0] if known is not None else core[-1])
            codes = _window_codes(left, right, place, row[hot], offset[hot])
            if known is not None:
                again[np.flatnonzero(hot)[np.isin(codes, known[1])]] = True
                codes = np.union1d(codes, known[1])
            if unfinished:
                seen = (int(core[-1]), np.unique(codes))
        row, offset = row[again], offset[again]
        start = _unplace(place[row])[0] - offset
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        if len(row):
            begins = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
            first = np.flatnonzero(begins)
            n = np.diff(np.append(first, len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(tie[row[first]]), pa.array(_place(start[first], 0 * n, 0 * n + _WHOLE)), pa.array(n - 1 + LENGTH)], names=["doc", "tie", "place", "size"])

    for batch in (b.slice(i, MOST - CHUNK) for b in batches for i in range(0, b.num_rows, MOST - CHUNK)):
        waiting.append(batch)
        table = pa.Table.from_batches(waiting)
        if table.num_rows < CHUNK:
            continue
        core = table.column("core").to_numpy()
        cut = int(np.searchsorted(core, core[-1]))
        if cut:
            yield from work(table.slice(0, cut), False)
            waiting = table.slice(cut).to_batches()
        else:
            yield from work(table, True)
            waiting = []
    if waiting:
        yield from work(pa.Table.from_batches(waiting), False)


def _window_codes(left: pa.Array, right: pa.Array, place: np.ndarray, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each offset of each row: of its parts in the row's fringes, with the offset."""
    _, _, far = _unplace(place[row])
    (ld, lo), (rd, ro) = K.text_bytes(left), K.text_bytes(right)
    before = K.span_hashes(ld, lo[row] + far - offset, lo[row + 1])
    after = K.span_hashes(rd, ro[row], ro[row] + offset // RANGE * RANGE + RANGE - 1 - offset)
    return K.mix64(before * U(K._STEP) + after + offset.astype(np.uint64) * U(K._BASE))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their intervals -> figures of each document. Of rows equal in id and text all but the first lose every window."""
    pending: tuple[int, int, bytes, list[tuple[int, int]]] | None = None

    def figures(doc: int, text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, int, str]:
        spans.sort()
        kept, upto, removed, n = [], 0, 0, 0
        for a, b in spans:
            if a > upto or n == 0:
                kept.append(text[upto:a])
                n += 1
                removed += b - a
                upto = b
            elif b > upto:
                removed += b - upto
                upto = b
        kept.append(text[upto:])
        return doc, len(text), removed, n, hashlib.sha256(b"".join(kept)).hexdigest()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    for batch in batches:
        rows = []
        doc, tie = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        place, size, text = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        for k in range(batch.num_rows):
            if place[k] is None:
                raw = text[k].as_py() or ""
                raw = raw if isinstance(raw, bytes) else raw.encode()
                if pending is not None and pending[:2] == (doc[k], tie[k]):
                    rows.append(figures(doc[k], raw, [(0, len(raw))] if len(raw) >= LENGTH else []))
                    continue
                if pending is not None:
                    rows.append(figures(pending[0], *pending[2:]))
                pending = (doc[k], tie[k], raw, [])
            elif pending is not None and pending[:2] == (doc[k], tie[k]):
                start = (place[k] >> 14) & 0x7FFFFFFF
                pending[3].append((start, start + size[k]))
        if rows:
            yield out(rows)
    if pending is not None:
        yield out([figures(pending[0], *pending[2:])])


#: Keys that may be broadcast to pick documents, about 200 bytes each in a hash table; more are joined by a shuffle.
MAX_BROADCAST = 300_000


def _pick(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return docs.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys, ["doc", "tie"], how)


def _sorted_with(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts and the rows that belong to them, texts first."""
    texts = docs.select("doc", "tie", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("size"), "text")
    others = rows.select("doc", "tie", "place", "size", F.lit(None).cast("string").alias("text"))
    return texts.unionByName(others).repartition("doc", "tie").sortWithinPartitions("doc", "tie", F.col("place").asc_nulls_first())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    least = -(2**63)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    segments = docs.mapInArrow(_segments, "key bigint, seg bigint, doc bigint, tie bigint, place bigint")
    settled = segments.repartition("key").sortWithinPartitions("key", "seg", "doc", "tie", "place").mapInArrow(_settle, "kind int, doc bigint, tie bigint, place bigint, size bigint")
    settled = scratch.keep(settled, "settled", ("kind",))
    shared = settled.filter("kind = 1")
    keys = scratch.keep(shared.select("doc", "tie").distinct(), "shared")
    cores = _sorted_with(_pick(docs, keys, "left_semi"), shared).mapInArrow(_cores, "core bigint, doc bigint, tie bigint, place bigint, left binary, right binary")
    merged = cores.repartition("core").sortWithinPartitions("core", "doc", "tie", "place").mapInArrow(_merge, "doc bigint, tie bigint, place bigint, size bigint")
    merged = scratch.keep(merged, "merged")
    intervals = settled.filter("kind = 0").select("doc", "tie", "place", "size").unionByName(merged.select("doc", "tie", "place", "size"))
    twins = docs.groupBy("doc", "tie").count().filter("count > 1").select("doc", "tie")
    touched = scratch.keep(intervals.select("doc", "tie").unionByName(twins).distinct(), "touched")
    whole = _pick(docs, touched, "left_anti").select("doc", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    cut = _sorted_with(_pick(docs, touched, "left_semi"), intervals).mapInArrow(_finish, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    out = whole.unionByName(cut)
    return out.select(F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
