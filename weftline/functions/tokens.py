"""Tokens: runs of anything but white space, or those of another tokenizer."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


class Tokenizer(Protocol):
    """Column functions: tokens of a text as an array, the text of an array of tokens, and their number."""

    def encode(self, text: Column) -> Column: ...

    def decode(self, tokens: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...


class Words:
    """Words between white space, in the JVM."""

    def encode(self, text: Column) -> Column:
        return tokens(text)

    def decode(self, tokens: Column) -> Column:
        return F.array_join(tokens, " ")

    def count(self, text: Column) -> Column:
        return token_count(text)


class Vocabulary:
    """Ids of a tokenizer with a vocabulary. ``load`` is called once in a worker and returns (encode, decode) for single texts."""

    def __init__(self, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]]):
        made: list = []

        def model() -> tuple:
            if not made:
                made.append(load())
            return made[0]

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return texts.fillna("").map(model()[0])

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            return ids.map(lambda x: model()[1]([int(i) for i in x]))

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, tokens: Column) -> Column:
        return self._decode(tokens)

    def count(self, text: Column) -> Column:
        return F.size(self._encode(text))


WORDS = Words()
