"""Word error rate: word-level edit distance over the length of the reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of words, a row at a time."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([number[w] for w in b], np.int64)
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, w in enumerate(a):
        step = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != number[w]))])
        row = np.minimum.accumulate(step - place) + place
    return int(row[-1])


def error_rate(reference: str | None, other: str | None) -> float:
    """0 if both are empty, 1 if only the reference is; nulls count as empty."""
    a, b = (reference or "").split(), (other or "").split()
    return word_distance(a, b) / len(a) if a else float(bool(b))


@F.pandas_udf(T.DoubleType())
def _wer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([error_rate(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def wer(reference: Column, other: Column) -> Column:
    return _wer(reference, other)
