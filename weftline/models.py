"""External models as plug-ins, with offline stand-ins.

The stand-ins are deterministic and make the engine run without a network; they are no measure of a model's quality.
"""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.buckets import BucketStore
from .session import settle


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class LanguageModel(Protocol):
    def extract(self, text: str) -> str: ...

    def keywords(self, query: str) -> tuple[list[str], list[str]]: ...

    def summarize(self, name: str, parts: list[str]) -> str: ...

    def generate(self, prompt: str) -> Iterator[str]: ...


class HashingEmbedder:
    """Signed counts of hashed words, with length 1."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1 if h >> 31 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class OverlapReranker:
    """Share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(re.findall(r"\w+", query.lower()))
        return [len(words & set(re.findall(r"\w+", t.lower()))) / max(1, len(words)) for t in texts]


class RuleModel:
    """Capitalised words as entities, neighbours in a sentence as relations; frequent long words as keywords."""

    def extract(self, text: str) -> str:
        lines: list[str] = []
        for sentence in re.split(r"[.!?\n]+", text):
            names = list(dict.fromkeys(re.findall(r"\b[A-ZÀ-Ý]\w{2,}", sentence)))
            said = sentence.strip()
            lines += [f"entity<|#|>{n}<|#|>concept<|#|>{said}" for n in names]
            lines += [f"relation<|#|>{a}<|#|>{b}<|#|>co-occurrence<|#|>{said}" for a, b in zip(names, names[1:], strict=False)]
        return "\n".join([*lines, "<|COMPLETE|>"])

    def keywords(self, query: str) -> tuple[list[str], list[str]]:
        words = Counter(w for w in re.findall(r"\w+", query) if len(w) > 3)
        ranked = sorted(words, key=lambda w: (-words[w], -len(w), w))
        return ranked[:3], ranked[:8]

    def summarize(self, name: str, parts: list[str]) -> str:
        return " ".join(dict.fromkeys(parts))[:2000]

    def generate(self, prompt: str) -> Iterator[str]:
        yield prompt[-500:]


def with_attempts(call: Callable, attempts: int = 3, wait: float = 0.5) -> Callable:
    """A call to a service that is tried again, each time after a longer wait; the last failure is raised."""

    def tried(*args):
        for k in range(1, attempts + 1):
            try:
                return call(*args)
            except Exception:
                if k == attempts:
                    raise
                time.sleep(wait * k)

    return tried


@dataclass(frozen=True)
class Limits:
    """What a service allows: calls at a time and calls a second over the whole job, tries of a call, and calls of one wave, after which
    the responses are stored."""

    in_flight: int = 10
    per_second: float = float("inf")
    attempts: int = 3
    wait: float = 0.5
    wave: int = 2000


def in_lanes(rows: DataFrame, keys: list[str], text: str, call: Callable[[str], str], limits: Limits) -> DataFrame:
    """keys, response and error of a call for each row. Rows are dealt to ``in_flight`` tasks that call one after the other, each
    with its share of the calls a second; a call that fails for good gives an error in its row, and the others go on."""
    tried, gap = with_attempts(call, limits.attempts, limits.wait), limits.in_flight / limits.per_second

    def lane(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for batch in batches:
            said: list[str | None] = []
            failed: list[str | None] = []
            for value in batch[text].fillna(""):
                time.sleep(max(0.0, free - time.monotonic()))
                free = max(free, time.monotonic()) + gap
                try:
                    said.append(tried(value))
                    failed.append(None)
                except Exception as e:
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}"[:2000])
            yield batch[keys].assign(response=said, error=failed)

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, text).repartition(limits.in_flight).mapInPandas(lane, f"{types}, response string, error string")


def ask(rows: DataFrame, key: str, text: str, call: Callable[[str], str], store: BucketStore, limits: Limits) -> DataFrame:
    """Calls for the rows whose key the store (key, response) has not; responses are stored wave by wave -> (key, error) of the calls that failed.

    A job that is lost, or run again after failures, calls only what is not stored.
    """
    missing = rows.select(key, text).dropDuplicates([key])
    missing = settle(missing.join(store.near(missing).select(key), key, "left_anti"), "asked", False)
    waves = max(1, -(-missing.count() // limits.wave))
    failed = None
    for wave in range(waves):
        said = settle(in_lanes(missing.filter(F.pmod(F.xxhash64(key), F.lit(waves)) == wave), [key], text, call, limits), "said", False)
        store.append(said.filter(F.col("error").isNull()).select(key, "response"))
        own = said.filter(F.col("error").isNotNull()).select(key, "error")
        failed = own if failed is None else failed.unionByName(own)
    return failed


def embed_column(model: Embedder, batch: int = 10) -> Column:
    """A function of a text column. ``batch`` texts go to the model at a time."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            values = series.fillna("").tolist()
            embed_some = with_attempts(model.embed)
            yield pd.Series([v for i in range(0, len(values), batch) for v in embed_some(values[i : i + batch])], dtype=object)

    return embed


def rerank_column(model: Reranker, query: str) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(query, texts.fillna("").tolist()))

    return score


def extract_responses(chunks: DataFrame, model: LanguageModel, keys: list[str]) -> DataFrame:
    """keys and response: the model reads every chunk once."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(model.extract)

    return chunks.select(*keys, read(F.col("content")).alias("response"))


def keywords_column(model: LanguageModel) -> Callable[[Column], Column]:
    """A function of a text column: (high, low) keywords of each question."""

    @F.pandas_udf("high array<string>, low array<string>")
    def keywords(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.keywords(t) for t in texts.fillna("")], columns=["high", "low"])

    return keywords


def summarize_column(model: LanguageModel, limits: Limits = Limits()) -> Column:  # noqa: B008
    @F.pandas_udf("string")
    def summarize(names: pd.Series, parts: pd.Series) -> pd.Series:
        tried = with_attempts(model.summarize, limits.attempts, limits.wait)
        return pd.Series([tried(n, list(p)) for n, p in zip(names, parts, strict=True)])

    return summarize
