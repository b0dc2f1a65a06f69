"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit predicts that bit from hashed byte n-grams of the text; the
loss-weighted distance to each codeword decides, and a small gap between the two nearest codewords flags ambiguity.

Features: the share of each hashed 1-, 2- and 3-gram of letters (lower-cased ASCII, other bytes as they are; digits,
punctuation and blanks count as one separator), square-rooted, over the whole text. Classifiers: logistic regression on at most
``max_fit`` labelled documents, equally many of each label where there are enough, chosen by a hash of the text, so that equal
corpora give equal models. One sampled document in ``HOLD`` is left out at first: how often a bit is right on those is
the weight of its loss; then all are learned from. Tasks turn the sample into features, so that no texts reach the driver.

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; rows without a label are not learned
from; texts whose two nearest codewords are equally near take the language that is first by name, with score and gap of the tie; with a single language the answer is that language, with none it is ``und``; repeated rows are predicted alike;
an empty table gives an empty result; other columns are kept and never used, but
for columns named like the new ones, which are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import kernels as K
from .common import bounded_batches, without

UNKNOWN = "und"
WIDTH = 1 << 13
MAX_FIT = 4000
BATCH = 500
HOLD = 5
SPARE = 30  # hashes below a threshold vary in number; with so many more, fewer than the room are as good as never left
_CLASS = K.LOWERED.copy()
_CLASS[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 0


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray  # labels x bits, +1 or -1
    weights: np.ndarray  # WIDTH x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int, bits: int | None = None, seed: int = 11) -> np.ndarray:
    """n codewords of +1/-1: all splits into two parts for few languages, else the best of some seeded random codes."""
    if n <= 6 and bits is None:
        return np.array([[1 if i == 0 or (m >> (i - 1)) & 1 == 0 else -1 for m in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng, width = np.random.default_rng(seed), bits or max(15, 6 * int(np.ceil(np.log2(n))))
    tried = [rng.choice(np.array([-1, 1], np.int8), (n, width)) for _ in range(50)]
    apart = []
    for c in tried:
        same = c.astype(np.float32) @ c.T.astype(np.float32)  # whole numbers, so exact
        np.fill_diagonal(same, -width)
        apart.append(width - same.max())
    return tried[int(np.argmax(apart))]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the 1-, 2- and 3-grams that end at each byte, as three rows."""
    c = _CLASS[data].astype(np.uint32)
    out = np.empty((3, len(c)), np.uint32)
    out[0] = c
    two = c.copy()
    two[1:] += c[:-1] << np.uint32(8)
    three = two.copy()
    three[2:] += c[:-2] << np.uint32(16)
    out[1], out[2] = two + np.uint32(1 << 24), three + np.uint32(1 << 25)
    return ((out * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def counts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features that occur, their square-rooted shares) of a text, summed in slices of bounded size."""
    total = np.zeros(WIDTH)
    for i in range(0, len(data), K.SLICE):
        lead = min(2, i)
        total += np.bincount(_grams(data[i - lead : i + K.SLICE])[:, lead:].ravel(), minlength=WIDTH)
    seen = np.flatnonzero(total)
    return seen, np.sqrt(total[seen] / max(1, len(data)))


def _train(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rows: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of every bit at once, by gradient steps with momentum over batches of ``rows``."""
    w, b = np.zeros((WIDTH, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    steps = -(-len(rows) // BATCH)
    for _ in range(-(-epochs // steps) if steps else 0):
        for k in range(steps):
            own = rows[k::steps]
            x = dense(features, own)
            gap = (1 / (1 + np.exp(-(x @ w + b))) - y[own]) * (weight[own] / weight[own].sum())
            vw = 0.9 * vw - rate * (x.T @ gap + decay * w)
            vb = 0.9 * vb - rate * gap.sum(0)
            w, b = w + vw, b + vb
    return w, b


def dense(features: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        at, value = features[r]
        x[i, at] = value
    return x


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Logistic regression for every bit at once, in at least ``steps`` steps over at most ``BATCH`` documents each."""
    names = sorted(set(labels))
    if len(names) < 2:
        return Model(names, np.ones((len(names), 1), np.int8), np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(names))
    of = np.searchsorted(names, labels)
    y = (code[of] > 0).astype(np.float32)
    weight = (1 / np.bincount(of, minlength=len(names)))[of].astype(np.float32)[:, None]
    every = np.argsort(of, kind="stable")  # label by label, so that each batch has all of them
    # Every HOLD-th document of a label is held back to see how far each bit can be trusted.
    place = np.empty(len(of), np.int64)
    place[every] = np.arange(len(of)) - np.searchsorted(of[every], of[every])
    held = place % HOLD == HOLD - 1
    trust = np.ones(code.shape[1], np.float32)
    if held.any():
        w, b = _train(features, y, weight, every[~held[every]], steps, rate, decay)
        rows = np.flatnonzero(held)
        right = np.concatenate([(dense(features, part) @ w + b > 0) == (y[part] > 0) for part in np.array_split(rows, -(-len(rows) // BATCH))])
        # A bit that is often wrong on either of its sides counts for less; one that is no better than chance for nothing.
        side = np.stack([y[rows] > 0, y[rows] == 0]) * weight[rows]
        sure = (side * right).sum(1) / np.maximum(side.sum(1), 1e-9)
        trust = np.maximum(np.where((side.sum(1) > 0).all(0), sure.sum(0) - 1, 2 * sure.max(0) - 1), 0.0).astype(np.float32)
        trust = trust if trust.any() else np.ones_like(trust)
    return Model(names, code, *_train(features, y, weight, every, steps, rate, decay), trust)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label number, score, gap) for rows of margins: the codeword of least trust-weighted logistic loss."""
    loss = np.stack([(np.logaddexp(0, -margins * c) * model.trust).sum(1) for c in model.code], 1)
    rank = np.argsort(loss, axis=1, kind="stable")
    best = rank[:, 0]
    likely = np.exp(loss.min(1, keepdims=True) - loss)
    score = 1 / likely.sum(1)
    second = np.take_along_axis(loss, rank[:, 1:2], 1)[:, 0] if loss.shape[1] > 1 else loss[:, 0] + np.inf
    return best, score, second - loss.min(1)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", max_fit: int = MAX_FIT) -> Model:
    """Fit on at most ``max_fit`` labelled documents with different texts, for each label those of smallest text hash.

    Every label has the same room, so that a rare one is learned as well; room that rare labels leave goes to the others. Of more labels than ``max_fit``
    the ``max_fit`` with most different texts are learned (ties by name), with one document each. A
    threshold on the hash, from each label's number of different texts, leaves about 1.5 times the room and ``SPARE`` more
    before rows are put in order. One task fits the sample, of at most six bytes for each feature of a sampled document, and the driver gets
    the model alone. Copies count once: they are kept or left together.
    """
    bounded_batches(labelled.sparkSession)
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    different = known.select("label", h.alias("h")).distinct()
    counts = {r["label"]: r["n"] for r in different.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_fit).collect()}
    room = rooms(counts, max_fit)
    bound = [(name, int(min(1.0, (1.5 * room[name] + SPARE) / n) * (1 << 40)), room[name]) for name, n in counts.items()]
    bounds = F.broadcast(labelled.sparkSession.createDataFrame(bound, "label string, bound bigint, room int"))  # at most max_fit rows
    sample = known.withColumn("h", h).join(bounds, "label").filter("h < bound").select("label", "h", "room", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(3))
            made = [counts_of(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            packed = [seen.astype("<u2").tobytes() + share.astype("<f4").tobytes() for seen, share in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["label", "h", "room", "features"])

    # Features are sorted instead of texts: a long text does not travel.
    made = sample.mapInArrow(featured, "label string, h bigint, room int, features binary")
    place = F.row_number().over(W.partitionBy("label").orderBy("h", "features"))
    rows = made.dropDuplicates(["h", "label"]).withColumn("place", place).filter("place <= room").select("h", "label", "features")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (taken := list(batches)):
            return
        table = pa.Table.from_batches(taken).sort_by([("h", "ascending"), ("label", "ascending")])
        features = []
        for f in table.column("features"):
            raw = f.as_py()
            n = len(raw) // 6
            features.append((np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<f4", n, 2 * n)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(features, table.column("label").to_pylist()))], pa.binary())], names=["model"])

    made_model = rows.repartition(1).mapInArrow(fitted, "model binary").first()  # at most max_fit rows
    return pickle.loads(made_model["model"]) if made_model else fit([], [])


def rooms(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many documents of each label fit into ``total``: all of a rare one's, and equal parts of what is left."""
    out, left = {}, total
    for i, name in enumerate(sorted(counts, key=lambda c: (counts[c], c))):
        out[name] = min(counts[name], left // (len(counts) - i))
        left -= out[name]
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", min_gap: float = 0.2) -> DataFrame:
    """docs and the columns lang_pred, score (0 to 1) and ambiguous (the two nearest codewords are less than min_gap apart)."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, "lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x bits, a few hundred kB
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at))
            margins = np.zeros((len(offsets) - 1, m.weights.shape[1]))
            for k in np.flatnonzero(np.diff(offsets)):
                seen, share = counts_of(data[offsets[k] : offsets[k + 1]])
                margins[k] = share @ m.weights[seen] + m.bias
            letters = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\pL"), False).to_numpy(zero_copy_only=False)
            if m.labels:
                best, score, gap = decode(m, margins)
            else:
                best, score, gap, letters = np.zeros(len(margins), int), np.zeros(len(margins)), np.zeros(len(margins)), np.zeros(len(margins), bool)
            names = [m.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, gap < min_gap, True))], names=schema.names)

    return docs.mapInArrow(predict, schema)
