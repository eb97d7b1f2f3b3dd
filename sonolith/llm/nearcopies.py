"""Near copies by the Jaccard likeness of word shingles: operator 10 for texts further apart than two bits.

Texts of equal shingle sets are one class. Operator 10's pigeonring index over their 64-bit SimHashes proposes what lies
within two bits (`ring_pairs`). For those further apart a class has BANDS keys of ROWS min-hashes each; of two classes that
share a key the 128-bit SimHashes must keep the pigeonring budgets of DISTANCE bits (simhash.chained). What either proposes
is compared by its whole shingle sets, so nothing below the bound is linked; only texts of such pairs are shuffled. A pair at likeness s shares no key with
chance (1 - s^ROWS)^BANDS: 2.7e-5 at 0.8, less above. (A 64-bit SimHash is no index here: at 0.8 it differs in about 10
bits, and keys that survive 12 differing bits are 5 bits wide.)

A key of up to SMALL classes is compared pair by pair. A larger one first links each STAR members to one of them and
those to each other; what the verified links of all keys left in different components is then compared pair by pair
too, where its key lies, so a large group costs a row a member and key, and no pair of a key goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim_memory, discard, join_unique, materialise, partitions, pieces, runs, whole_runs, with_ids
from .components import connected, smallest
from .simhash import chained, fingerprint_links, votes

JACCARD = 0.8
SHINGLE = 5
BANDS, ROWS = 20, 4
SMALL, STAR = 32, 64
#: Bits of 128 in which SimHashes may differ: at a likeness of 0.8 they differ in 20 with a deviation of 4; unlike texts in 64.
DISTANCE = 48
_MIX = np.random.default_rng(10).integers(0, 2**63, (2, BANDS * ROWS, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; words as in simhash.simhash. Fewer words: one of them all."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a non-empty shingle set."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1 << 12):
        mixed = hashes[None, k : k + (1 << 12)] * _MIX[0]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _MIX[1]).min(axis=1))
    raw = least.reshape(BANDS, ROWS)
    return np.fromiter((xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)), np.uint64, BANDS).view(np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text), written, so that a row keeps its number."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), "numbered")


def _marks(rows: DataFrame, shingle: int) -> DataFrame:
    """(uid, doc_id, cls, n, keys, s1, s2); texts stay behind, as a worker's way back would hold them a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        claim_memory(__name__, lambda: None)  # what an earlier stage's tasks left in this worker goes
        for b in pieces(batches):
            cls, size, keys, print_ = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py() or b"", shingle)
                cls.append(xxh64_intdigest(h.tobytes(), 7) if len(h) else 0)
                size.append(len(h))
                keys.append(band_keys(h) if len(h) else [])
                print_.append(votes(h))
            bits = np.array(print_, np.uint64).reshape(-1, 2).view(np.int64)
            more = [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *more], ["uid", "doc_id", "cls", "n", "keys", "s1", "s2"])

    return rows.mapInArrow(run, "uid long, doc_id long, cls long, n long, keys array<long>, s1 long, s2 long")


def ring_pairs(classes: DataFrame) -> DataFrame:
    """(uid, s1) of classes -> pairs (a, b) of uid that connect all whose SimHashes s1 differ in at most two bits: operator
    10's index over the distinct ones, and a chain of those that share one."""
    prints = materialise(classes.groupBy(F.col("s1").alias("fp")).agg(F.min("uid").alias("uid")), "prints")
    near = fingerprint_links(prints.select("fp"))
    near = near.join(prints.toDF("a", "p"), "a").join(prints.toDF("b", "q"), "b").select("p", "q")
    equal = classes.select(F.lag("uid").over(Window.partitionBy("s1").orderBy("uid")).alias("p"), F.col("uid").alias("q")).where("p IS NOT NULL")
    return near.unionByName(equal).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _fits(n: np.ndarray, m: np.ndarray, jaccard: float) -> np.ndarray:
    return np.minimum(n, m) >= jaccard * np.maximum(n, m) - 1e-9


def _pairs(uid: np.ndarray, n: np.ndarray, comp: np.ndarray, print_: np.ndarray, jaccard: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a key in different components whose sizes and chains allow the likeness, some rows at a time."""
    step = max(1, (1 << 18) // len(uid))
    for k in range(0, len(uid) - 1, step):
        ok = (comp[k : k + step, None] != comp[None, :]) & _fits(n[k : k + step, None], n[None, :], jaccard)
        ok &= np.arange(len(uid))[None, :] > np.arange(k, min(k + step, len(uid)))[:, None]
        a, b = np.nonzero(ok)
        a += k
        ok = chained(print_[a], print_[b], DISTANCE)
        yield uid[a[ok]], uid[b[ok]]


def _stars(uid: np.ndarray, n: np.ndarray, print_: np.ndarray, jaccard: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each STAR members with the first of them, and of each first with the next one."""
    order = np.argsort(uid, kind="stable")
    lead = order[np.arange(len(uid)) // STAR * STAR]
    firsts = order[::STAR]
    a, b = np.concatenate((lead, firsts[:-1])), np.concatenate((order, firsts[1:]))
    ok = (a != b) & _fits(n[a], n[b], jaccard)
    a, b = a[ok], b[ok]
    ok = chained(print_[a], print_[b], DISTANCE)
    return [(uid[a[ok]], uid[b[ok]])]


def _batch(found: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)


def _columns(t: pa.Table, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first n columns, and the SimHashes in the two after them."""
    cols = [t.column(i).to_numpy() for i in range(n + 2)]
    return cols[:n], np.stack(cols[n:], axis=1).view(np.uint64)


def _first(batches: Iterator[pa.RecordBatch], jaccard: float, small: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid, n, s1, s2) sorted by key -> pairs (a, b), and the members of large keys as (uid, -1, key, n)."""
    for t in whole_runs(batches, 1):
        (key, uid, n), print_ = _columns(t, 3)
        at, found = runs(key), []
        for s, e in zip(at[:-1], at[1:]):
            if e - s < 2:
                continue
            if e - s <= small:
                both = list(_pairs(uid[s:e], n[s:e], uid[s:e], print_[s:e], jaccard))
            else:
                both = _stars(uid[s:e], n[s:e], print_[s:e], jaccard)
                found.append((uid[s:e], np.full(e - s, -1), key[s:e], n[s:e]))
            found += [(np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)) for a, b in both]
        yield from _batch(found, ["a", "b", "key", "n"])


def _second(batches: Iterator[pa.RecordBatch], jaccard: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid, n, comp, s1, s2, keys, text) sorted by key -> links between different components.

    A pair is compared under the smallest key that it shares: if that is no large one, `_first` has compared it."""
    claim_memory(__name__, lambda: None)
    last = np.iinfo(np.int64).max
    for t in whole_runs(batches, 1):
        (key, uid, n, comp), print_ = _columns(t, 4)
        keys = t.column(6).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        at = runs(key)
        for s, e in zip(at[:-1], at[1:]):
            if (comp[s:e] == comp[s]).all():
                continue
            texts, known, root, found = t.column(7).slice(s, e - s), {}, {}, []

            def whole(k: int) -> np.ndarray:
                if k not in known:
                    known[k] = shingles(texts[k].as_py(), shingle)
                return known[k]

            def top(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for a, b in _pairs(np.arange(e - s), n[s:e], comp[s:e], print_[s:e], jaccard):
                ok = np.where(keys[s + a] == keys[s + b], keys[s + a], last).min(axis=1, initial=last) == key[s]
                for i, j in zip(a[ok].tolist(), b[ok].tolist()):
                    x, y = top(int(comp[s + i])), top(int(comp[s + j]))
                    if x == y:
                        continue
                    p, q = whole(i), whole(j)
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    if same >= jaccard * (len(p) + len(q) - same) - 1e-9:
                        root[max(x, y)] = min(x, y)
                        found.append((min(uid[s + i], uid[s + j]), max(uid[s + i], uid[s + j])))
            if found:
                yield from _batch([tuple(np.array(found, np.int64).T)], ["a", "b"])


def _verified(pairs: DataFrame, rows: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """The pairs whose whole shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory(__name__, lambda: None)
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = shingles(x.as_py(), shingle), shingles(y.as_py(), shingle)
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= jaccard * (len(p) + len(q) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid"))
    texts = materialise(with_ids(rows.select("uid", "text"), ends, "uid"), "texts")
    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return materialise(both.mapInArrow(run, "a long, b long"), "links")


def near_copies(docs: DataFrame, jaccard: float = JACCARD, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest doc_id reachable by pairs of texts whose
    shingle sets have a Jaccard likeness of `jaccard` or more.

    Null, empty and blank texts are one class. Rows with a null doc_id take part and get the component of their class
    (null if no member has an id). An empty table gives an empty result; other columns of docs are not read.
    """
    numbered = _numbered(docs)
    marks = materialise(_marks(numbered, shingle), "marks")
    classes = materialise(marks.groupBy("cls").agg(F.min("doc_id").alias("id"), F.min("uid").alias("uid")), "classes")
    reps = materialise(marks.select("uid", "n", "keys", "s1", "s2").join(classes.select("uid"), "uid", "left_semi"), "reps")
    rows = reps.select(F.explode("keys").alias("key"), "uid", "n", "s1", "s2")
    rows = rows.repartition(partitions(rows), "key").sortWithinPartitions("key")
    first = materialise(rows.mapInArrow(lambda it: _first(it, jaccard, small), "a long, b long, key long, n long"), "pairs")
    told = first.where("b >= 0").select("a", "b").unionByName(ring_pairs(reps.where("n > 0").select("uid", "s1")))
    links = _verified(materialise(told.distinct(), "pairs"), numbered, jaccard, shingle)
    roots = connected(links)
    hot = first.where("b < 0").select("key", F.col("a").alias("uid"), "n")
    if not hot.isEmpty():
        left = hot.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("comp"))
        left = materialise(left, "left")
        open_ = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        left = materialise(left.join(open_, "key", "left_semi"), "left")  # the rest is one component a key
        for more in (marks.select("uid", "s1", "s2", "keys"), numbered.select("uid", "text")):
            left = left.join(with_ids(more, left.select("uid"), "uid"), "uid")
        left = left.repartition(partitions(left), "key").sortWithinPartitions("key")
        told = left.select("key", "uid", "n", "comp", "s1", "s2", "keys", "text").mapInArrow(lambda it: _second(it, jaccard, shingle), "a long, b long")
        rest = materialise(told, "links")
        if not rest.isEmpty():
            roots = connected(links.unionByName(rest))
    discard(first)
    comp = smallest(classes.select(F.col("uid").alias("node"), "id"), roots).withColumnRenamed("node", "uid")
    comp = materialise(classes.join(comp, "uid").select("cls", "component_id"), "components")
    return join_unique(marks.select("doc_id", "cls"), comp, "cls", "inner").select("doc_id", "component_id")
