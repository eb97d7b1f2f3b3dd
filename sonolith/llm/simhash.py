"""SimHash near-duplicates by pigeonring filtering (operator 10).

A 64-bit fingerprint is a ring of M = 16 segments of 4 bits. If two fingerprints differ in at most T bits, some segment
i starts a chain whose every prefix of l segments holds at most floor(l * T / M) differing bits. For T = 2 the first
seven budgets are zero, so the 28 bits of seven consecutive segments are an equality key; a candidate is then dropped
as soon as a longer prefix of its chain exceeds its budget, and only survivors get the full Hamming check.

Equal fingerprints are one class from the start. A key that more than HOT classes share is split exactly: the other 36
bits form 4 blocks of 9, of which at most T = 2 can differ, so each class goes to the 6 keys that add two equal blocks.
Then 18 bits are free, so a key holds 2^18 classes at most; where it holds many, the partners of each class are looked
up one by one (all ways to change up to T of the free bits) in place of comparing all pairs.
Within a key the links are reduced to a chain per group, so near-copy groups never produce their quadratic pair set.

Texts that are alike but not within two bits (a stage on five-word shingles at Jaccard 0.8) need another index, as no
key of a 64-bit print survives the ten or so bits they differ in: `near_copies`, where chains prune the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, chain, forest, join_unique, materialise, partitions, runs, whole_runs
from .components import connected, smallest

SEGMENTS, BITS = 16, 4
DISTANCE = 2
HOT = 1024
SHINGLE = 3


def budgets(distance: int, segments: int = SEGMENTS) -> list[int]:
    return [length * distance // segments for length in range(1, segments + 1)]


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: A-Z lower-cased, words at ASCII white space, XXH64 (seed 42) of word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        rows = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number). Null and blank texts have fingerprint zero. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py() or b"", shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ring turned so that segment `start` comes first (most significant)."""
    left = (start * BITS).astype(np.uint64)
    right = (np.uint64(64) - left) & np.uint64(63)
    return np.where(left == 0, fp, (fp << left) | (fp >> right))


def _links(fp: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within one key whose chain from `start` keeps its budgets; the chain of all segments is the distance.

    A prefix of nine segments is tested for all pairs, longer ones only for those that passed the one before."""
    turned = _rotated(fp, np.full(len(fp), start))
    a_out, b_out, n = [], [], len(fp)
    step = max(1, (1 << 21) // n)
    allowed = budgets(distance)
    over = lambda diff, length: np.bitwise_count(diff >> np.uint64(64 - length * BITS)) > allowed[length - 1]
    for k in range(0, n - 1, step):
        diff = turned[k : k + step, None] ^ turned[None, k + 1 :]
        a, b = np.nonzero(np.triu(~over(diff, 9)))
        diff = diff[a, b]
        for length in (12, 15, SEGMENTS):
            ok = ~over(diff, length)
            a, b, diff = a[ok], b[ok], diff[ok]
        a_out.append(a + k)
        b_out.append(b + k + 1)
    return np.concatenate(a_out), np.concatenate(b_out)


def _partners(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted fingerprints that differ in 1 to `distance` of the bits in which any of them differ."""
    free = [np.uint64(1) << np.uint64(b) for b in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> b & 1]
    a_out, b_out = [], []
    for size in range(1, distance + 1):
        for bits in combinations(free, size):
            other = fp ^ np.bitwise_or.reduce(np.array(bits))
            at = np.searchsorted(fp, other)
            hit = (at < len(fp)) & (fp[np.minimum(at, len(fp) - 1)] == other) & (fp < other)
            a_out.append(np.flatnonzero(hit))
            b_out.append(at[hit])
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64),) * 2


def _edges(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (start, key, sub, fp) sorted by the first three: a chain of links for each near group of each key."""
    for t in whole_runs(batches, 3):
        start, key, sub, fp = (t.column(i).to_numpy() for i in range(4))
        at = runs(start, key, sub)
        a_out, b_out = [], []
        for s, e in zip(at[:-1], at[1:]):
            if e - s < 2:
                continue
            own = np.sort(fp[s:e].view(np.uint64))
            found = _partners(own, distance) if e - s > HOT and sub[s] else _links(own, int(start[s]), distance)
            a, b = chain(forest(e - s, *found))
            a_out.append(own[a].view(np.int64))
            b_out.append(own[b].view(np.int64))
        if a_out:
            arrays = [pa.array(np.concatenate(x)) for x in (a_out, b_out)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def fingerprint_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp long, distinct; a written table) -> links (a, b) that connect exactly what differs in at most `distance`
    (0 to 2) bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the keys of this index are exact up to 2 bits")
    exact = sum(b == 0 for b in budgets(distance)) if distance else SEGMENTS
    exact = min(exact, 7)
    turn = F.expr(f"shiftleft(fp, start * {BITS}) | IF(start = 0, 0L, shiftrightunsigned(fp, 64 - start * {BITS}))")
    rows = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start"))
    rows = rows.withColumn("turned", turn)
    rows = rows.withColumn("key", F.shiftrightunsigned("turned", 64 - exact * BITS))
    hot = materialise(rows.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    rows = attach(rows, hot, ["start", "key"])
    rest = 64 - exact * BITS  # 36 bits: 4 blocks of 9
    block = [F.shiftrightunsigned("turned", rest - 9 * (k + 1)).bitwiseAND(F.lit(511)) for k in range(4)]
    finer = [F.lit(k << 18).bitwiseOR(F.shiftleft(block[i], 9)).bitwiseOR(block[j]) + 1 for k, (i, j) in enumerate(combinations(range(4), 2))]
    subs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*[c.cast("long") for c in finer]))
    rows = rows.select("start", "key", F.explode(subs).alias("sub"), "fp")
    rows = rows.repartition(partitions(rows), "start", "key", "sub").sortWithinPartitions("start", "key", "sub")
    return rows.mapInArrow(lambda batches: _edges(batches, distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id) of every document; component_id is the smallest doc_id reachable by links.

    Null, empty and blank texts share fingerprint zero and are linked like any other. Repeated rows and equal texts
    are one class. Rows with a null doc_id take part and get the component of their fingerprint (null if no member
    has an id). An empty table gives an empty result; other columns of docs are not read.
    """
    marks = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(marks.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("id")), "classes")
    roots = connected(fingerprint_links(classes.select(F.col("node").alias("fp")), distance))
    comp = materialise(smallest(classes, roots).withColumnRenamed("node", "fp"), "components")
    return join_unique(marks, comp, "fp", "inner").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, jaccard: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) by the Jaccard likeness of word shingles; see nearcopies."""
    from . import nearcopies

    return nearcopies.near_copies(docs, jaccard, shingle)


# -- chains over wider prints ---------------------------------------------------------------------------------------------


def votes(hashes: np.ndarray) -> np.ndarray:
    """128-bit SimHash (two words) of distinct shingle hashes: a bit is 1 where over half of them have it."""
    ones, wide = np.zeros(128, np.int64), 1 << 14
    for k in range(0, len(hashes), wide):
        part = hashes[k : k + wide]
        both = np.stack((part, (part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)), axis=1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * ones > len(hashes)).tobytes(), ">u8").astype(np.uint64)


def chained(a: np.ndarray, b: np.ndarray, distance: int, segments: int = SEGMENTS) -> np.ndarray:
    """Whether pairs of 128-bit prints (rows of two words) have a chain of consecutive segments, around the ring, whose every
    prefix of l segments differs in l * distance / segments bits at most; all pairs within `distance` bits do."""
    diff = np.ascontiguousarray((a ^ b).astype(">u8")).view(np.uint8).reshape(len(a), 16)
    counts = np.bitwise_count(diff).reshape(len(a), segments, 16 // segments).sum(axis=2, dtype=np.int16)
    sums = np.concatenate((np.zeros((len(a), 1), np.int16), np.cumsum(np.concatenate((counts, counts), axis=1), axis=1, dtype=np.int16)), axis=1)
    alive = np.ones((len(a), segments), bool)
    for length, budget in enumerate(budgets(distance, segments), 1):
        alive &= sums[:, length : length + segments] - sums[:, :segments] <= budget
    return alive.any(axis=1)


def hex16(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))
