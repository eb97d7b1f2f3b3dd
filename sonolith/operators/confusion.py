"""Counts over all pairs of vectors, by blocks; no pair is ever a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1000


def _counts(la: np.ndarray, a: np.ndarray, lb: np.ndarray, b: np.ndarray, own: bool, near: float) -> np.ndarray:
    """(2, 2, dim): pairs and near pairs of each component, by different and same label; own: of one block."""
    out = np.zeros((2, 2, a.shape[1]), np.int64)
    step = max(1, (1 << 20) // len(b))
    for k in range(0, len(a), step):
        told = np.ones((len(a[k : k + step]), len(b)), bool)
        if own:
            told &= np.arange(len(b))[None, :] > np.arange(k, k + len(told))[:, None]
        same = la[k : k + step, None] == lb[None, :]
        for at, which in enumerate((told & ~same, told & same)):
            out[0, at] += np.count_nonzero(which)
        for c in range(a.shape[1]):
            close = told & (np.abs(a[k : k + step, None, c] - b[None, :, c]) < near)
            hits = np.count_nonzero(close & same)
            out[1, :, c] += (np.count_nonzero(close) - hits, hits)
    return out


def all_pairs(vectors: DataFrame, near: float = 0.1) -> DataFrame:
    """(label, embedding) -> (component from 0, same, pairs, near) over all pairs of rows.

    Work is quadratic in the rows; blocks of about BLOCK rows meet each other once.
    """
    n = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.select((F.monotonically_increasing_id()).alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    blocks = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("label", "v")).alias("m"))
    blocks = blocks.select("block", F.transform("m", lambda r: r["label"]).alias("labels"), F.flatten(F.transform("m", lambda r: r["v"])).alias("flat"))
    left = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(n - 1).cast("long"))))
    pairs = left.join(blocks.toDF("other", "labels2", "flat2"), "other").select("labels", "flat", "labels2", "flat2", (F.col("block") == F.col("other")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                la, a, lb, b = (t.column(i)[k].values.to_numpy() for i in range(4))
                got = _counts(la, a.reshape(len(la), -1), lb, b.reshape(len(lb), -1), t.column(4)[k].as_py(), near)
                dim = got.shape[2]
                arrays = [pa.array(np.tile(np.arange(dim), 2)), pa.array(np.repeat([False, True], dim)), pa.array(got[0].ravel()), pa.array(got[1].ravel())]
                yield pa.RecordBatch.from_arrays(arrays, ["component", "same", "pairs", "near"])

    told = pairs.mapInArrow(run, "component long, same boolean, pairs long, near long")
    return told.groupBy("component", "same").agg(F.sum("pairs").alias("pairs"), F.sum("near").alias("near")).where("pairs > 0")
