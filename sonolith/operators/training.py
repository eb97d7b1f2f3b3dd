"""Boosted choice of filters and thresholds from labelled pairs of images."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

ROUNDS, CUTS, WIDEST = 16, 24, 16
#: Rows from which candidate thresholds are drawn (of least hash); every row counts in every round.
SAMPLE = 2000


@dataclass(frozen=True)
class Choice:
    """A filter with a threshold: two images agree if their values lie on one side of it."""

    kind: int
    pitch: int
    pitches: int
    frames: int
    cut: float
    weight: float
    error: float


def candidates(pitches: int = features.NOTES, widest: int = WIDEST) -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of all filters whose regions are not empty."""
    out = []
    for kind in range(6):
        for height in range(1, pitches + 1):
            for width in range(1, widest + 1):
                if all(x1 > x0 and y1 > y0 for side in features.regions(kind, width, height) for x0, x1, y0, y1 in side):
                    out += [(kind, pitch, height, width) for pitch in range(pitches - height + 1)]
    return out


def _values(images: pa.Array, filters: list[tuple[int, int, int, int]], pitches: int) -> np.ndarray:
    """(images, filters): filter values at each image's first frame."""
    flat = images.flatten().to_numpy(zero_copy_only=False).reshape(len(images), -1, pitches)
    sums = np.zeros((len(flat), flat.shape[1] + 1, pitches + 1))
    sums[:, 1:, 1:] = flat.cumsum(axis=1).cumsum(axis=2)
    box = lambda x0, x1, y0, y1: sums[:, x1, y1] - sums[:, x0, y1] - sums[:, x1, y0] + sums[:, x0, y0]
    out = np.empty((len(flat), len(filters)))
    for f, (kind, pitch, height, width) in enumerate(filters):
        a, b = (sum((box(x0, x1, y0 + pitch, y1 + pitch) for x0, x1, y0, y1 in side), np.zeros(len(flat))) for side in features.regions(kind, width, height))
        out[:, f] = features.log_difference(a, b)
    return out


def agreement(a: np.ndarray, b: np.ndarray, cut: float) -> np.ndarray:
    """1 where values lie on one side of cut, else -1."""
    return np.where((a < cut) == (b < cut), 1.0, -1.0)


def select(pairs: DataFrame, filters: list[tuple[int, int, int, int]] | None = None, rounds: int = ROUNDS, cuts: int = CUTS, pitches: int = features.NOTES) -> list[Choice]:
    """The filters that tell equal from different pairs best, one a round.

    pairs: same boolean, a and b (frames x pitches as one array<double>, row by row, of one length). A round is one pass: each
    batch sums the weighted errors of all filters and cuts, and the least sum is taken. Weights of rows follow from the
    choices so far, so nothing is kept between rounds but those.
    """
    filters = candidates(pitches) if filters is None else filters
    some = pairs.select("a").orderBy(F.xxhash64("a")).limit(SAMPLE).collect()
    if not some:
        return []
    seen = _values(pa.array([r["a"] for r in some], pa.list_(pa.float64())), filters, pitches)
    grid = np.quantile(seen, (np.arange(cuts) + 0.5) / cuts, axis=0)  # cuts x filters
    chosen: list[Choice] = []

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            same = np.where(t.column(0).to_numpy(zero_copy_only=False), 1.0, -1.0)
            a, b = (_values(t.column(k), filters, pitches) for k in (1, 2))
            weight = np.ones(len(same))
            for c in chosen:
                at = filters.index((c.kind, c.pitch, c.pitches, c.frames))
                weight *= np.exp(-c.weight * same * agreement(a[:, at], b[:, at], c.cut))
            wrong = np.stack([((agreement(a, b, cut) != same[:, None]) * weight[:, None]).sum(axis=0) for cut in grid])
            f, k = np.meshgrid(np.arange(len(filters)), np.arange(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(f.ravel()), pa.array(k.ravel()), pa.array(wrong.ravel()), pa.array(np.full(wrong.size, weight.sum()))], ["f", "k", "wrong", "whole"])

    for _ in range(rounds):
        sums = pairs.select("same", "a", "b").mapInArrow(errors, "f long, k long, wrong double, whole double").groupBy("f", "k").agg(F.sum("wrong").alias("wrong"), F.sum("whole").alias("whole"))
        best = sums.select("f", "k", (F.col("wrong") / F.col("whole")).alias("error")).orderBy(F.round("error", 12), "f", "k").limit(1).head()
        error = min(max(best["error"], 1e-9), 1 - 1e-9)
        chosen.append(Choice(*filters[best["f"]], float(grid[best["k"], best["f"]]), 0.5 * math.log((1 - error) / error), best["error"]))
    return chosen


def rates(pairs: DataFrame, chosen: list[Choice], pitches: int = features.NOTES) -> DataFrame:
    """(bits, same, n): pairs by the number of choices on which their images disagree."""
    filters = [(c.kind, c.pitch, c.pitches, c.frames) for c in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = (_values(t.column(k), filters, pitches) for k in (1, 2))
            bits = sum((agreement(a[:, i], b[:, i], c.cut) < 0).astype(np.int64) for i, c in enumerate(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(bits), t.column(0)], ["bits", "same"])

    return pairs.select("same", "a", "b").mapInArrow(run, "bits long, same boolean").groupBy("bits", "same").agg(F.count("*").alias("n"))
