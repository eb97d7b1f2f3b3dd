"""Alignment of whole prints: the best diagonal of a band, linear in length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BAND, BIT_ERROR = 120, 2


def top_count(x: np.ndarray, y: np.ndarray, errors: int = BIT_ERROR) -> int:
    """Most words of one diagonal j - i in [-BAND, BAND) that differ in `errors` bits at most."""
    top = 0
    for d in range(-BAND, BAND):
        a, b = x[max(0, -d) :], y[max(0, d) :]
        m = min(len(a), len(b))
        if m > top:
            top = max(top, int(np.count_nonzero(np.bitwise_count(a[:m] ^ b[:m]) <= errors)))
    return top


def top_share(x: np.ndarray, y: np.ndarray) -> float:
    """The best diagonal's share of the shorter print."""
    n = min(len(x), len(y))
    return top_count(x, y) / n if n else 0.0


def seek_share(x: np.ndarray, y: np.ndarray, start: int, end: int) -> float:
    """The longer print against the shorter one from `start` to `end`, as a share of what the shorter one has there;
    without 0 < start < end: of whole prints."""
    if len(y) > len(x):
        x, y = y, x
    if 0 < start < end:
        x, y = x[start:end], y[start:end]
    return top_count(x, y) / len(y) if len(y) else 0.0


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """The strict form: one bit at most may differ, and the result is a distance; 0 where nothing aligns."""
    top = top_count(x, y, BIT_ERROR - 1)
    return 1 - top / min(len(x), len(y)) if top else 0.0


def aligned(pairs: DataFrame, seek: tuple[int, int] | None = None, strict: bool = False) -> DataFrame:
    """(a, b, x array<long>, y array<long>) -> (a, b, score)."""
    one = (lambda x, y: seek_share(x, y, *seek)) if seek else distance if strict else top_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = ([v.values.to_numpy() for v in t.column(k)] for k in (2, 3))
            score = pa.array([one(p, q) for p, q in zip(x, y)], pa.float64())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), score], ["a", "b", "score"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, score double")
