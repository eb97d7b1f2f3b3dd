"""Embedding near-duplicates by a pivot-permutation index (operator 5).

Reference points (pivots) are a bounded sample of the vectors themselves; their number grows with the root of the
table's. Each vector is described by its nearest pivots in order of closeness and filed in their inverted lists, one set
of lists a label and length. Within a list two vectors are a candidate if they share at least SHARED pivots; candidates
are verified by their cosine in double precision. A pair that meets in several lists counts in the first of its shared
pivots only, so lists return sums (links of each vector) and chains (who hangs together), never pairs. A list of more
than SPLIT members is dealt again by a second shared pivot; what is still long is cut into chunks, and every pair of
chunks is a task's block of bounded size. Equal vectors are one class from the start. Lengths that few vectors have are
compared exactly, in the same blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, chain, forest, join_unique, materialise, partitions, runs, text_key, whole_runs
from .components import connected, smallest

COSINE, SHARED = 0.93, 2
#: How many pivots describe a vector: the least of these numbers whose index finds the share RECALL of PROBES pairs that
#: lie just above the bound, each a vector of the sample and a random one beside it.
NEAREST, RECALL, PROBES = (8, 12, 16, 24, 32, 48), 0.99, 1000
#: Pivots of a length: PIVOTS_A_ROOT times the square root of its vectors, within these bounds.
PIVOTS_A_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 6, 1024, 8192
#: Vectors looked at for each pivot wanted, and the likeness (around the sample's mean) above which two pivots would
#: describe the same place: in a crowd of near-copies many tied pivots would make the order of the nearest arbitrary.
SAMPLE, APART = 4, 0.8
#: Lengths that get pivots (the most common ones); vectors of other lengths are compared exactly.
DIMENSIONS = 64
SPLIT, CHUNK = 1024, 1024
EXACT = -1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks]).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, h1, h2, label, dim, embedding): h1 and h2 tell label and vector apart, null where a row cannot link.

    Floats stay floats: half the bytes to move, and the same doubles in the end."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), text_key(F.col("label"), dict(vectors.dtypes)["label"]).alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    key = lambda salt: F.when(F.col("ok"), F.xxhash64(F.lit(salt), "label", "embedding"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", key(1).alias("h1"), key(2).alias("h2"), "label", F.size("embedding").alias("dim"), "embedding")
    return materialise(rows, "vectors")


def _classes(rows: DataFrame) -> DataFrame:
    """(h1, h2, node, id, n, label, dim, embedding): distinct vectors that can link."""
    classes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2")
    out = classes.agg(F.min("uid").alias("node"), F.min("vec_id").alias("id"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("label", "dim", "embedding")])
    return materialise(out, "classes")


def wanted(n: int) -> int:
    """Pivots for n vectors."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS_A_ROOT * math.sqrt(n))))


def choose(sample: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit pivots, mean) of unit vectors: taken one by one where, seen from the mean, they are no nearer than APART to
    those before; vectors that share a direction are thus told apart as well as others."""
    mean = sample.mean(axis=0)
    apart = sample - mean
    norm = np.sqrt((apart * apart).sum(axis=1, keepdims=True))
    apart = apart / np.where(norm > 1e-12, norm, 1)
    chosen, n, kept = np.empty((pivots, sample.shape[1])), 0, []
    for k, v in enumerate(apart):
        if n == pivots:
            break
        if n == 0 or (chosen[:n] @ v).max() < APART:
            chosen[n], n = v, n + 1
            kept.append(k)
    return chosen[:n].copy(), mean


def tuned(sample: np.ndarray, pivots: np.ndarray, mean: np.ndarray, cosine: float, shared: int) -> int:
    """The number of nearest pivots that the sample's own spread asks for."""
    rng = np.random.default_rng(1)
    x = sample[:PROBES]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    norm = np.sqrt((side * side).sum(axis=1, keepdims=True))
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * side / np.where(norm > 0, norm, 1)
    a, b = (describe(v, pivots, mean, NEAREST[-1]) for v in (x, y))
    for n in NEAREST:
        met = (a[:, :n, None] == b[:, None, :n]).any(axis=2).sum(axis=1)
        if n >= len(pivots) or (met >= min(shared, n)).mean() >= RECALL:
            break
    return n


def _fit(classes: DataFrame, pivots: int | None, nearest: int | None, cosine: float, shared: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """(pivots, mean, number of nearest ones) of each of the DIMENSIONS most common lengths, from the vectors of least
    hash, so reruns agree."""
    common = classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    out = {}
    for r in common:
        p = pivots or wanted(r["n"])
        some = classes.where(F.col("dim") == r["dim"]).select("embedding").orderBy("h1", "h2").limit(SAMPLE * p)
        sample = _unit(np.array([x[0] for x in some.collect()], np.float64))
        chosen, mean = choose(sample, p)
        out[r["dim"]] = chosen, mean, nearest or tuned(sample, chosen, mean, cosine, shared)
    return out


def describe(x: np.ndarray, pivots: np.ndarray, mean: np.ndarray, nearest: int) -> np.ndarray:
    """(n, nearest) pivots of unit vectors, closest first."""
    k, out = min(nearest, len(pivots)), []
    for s in range(0, len(x), 4096):
        near = -((x[s : s + 4096] - mean) @ pivots.T)
        top = np.argpartition(near, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int32)


def _describe(classes: DataFrame, fitted: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> DataFrame:
    """(node, n, label, dim, embedding, pivots): the nearest ones; the list EXACT alone for lengths without pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("dim").to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                if int(d) in fitted:
                    ids = describe(_unit(_matrix(part.column("embedding"), int(d))), *fitted[int(d)])
                else:
                    ids = np.full((part.num_rows, 1), EXACT, np.int32)
                told = pa.ListArray.from_arrays(np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, told], [*part.schema.names, "pivots"])

    slim = classes.select("node", "n", "label", "dim", "embedding")
    fields = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes)
    return materialise(slim.mapInArrow(run, f"{fields}, pivots array<int>"), "described")


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)): how many pivots each two descriptions share."""
    out = np.zeros((len(a), len(b)), np.int8)
    for u in a.T:
        for v in b.T:
            out += u[:, None] == v[None, :]
    return out


def _counts_here(a: np.ndarray, b: np.ndarray, pivot: int, second: int) -> np.ndarray:
    """Of pairs of descriptions, those that count in this list: its pivot is the least they share and, where the list is
    dealt again, its second pivot the next."""
    met = (a[:, :, None] == b[:, None, :]).any(axis=2)
    told = np.sort(np.where(met, a, np.iinfo(np.int32).max), axis=1)
    here = told[:, 0] == pivot
    return here & (told[:, 1] == second) if second != EXACT else here


def _block(t: pa.Table, cosine: float, shared: int) -> list[tuple]:
    """Links and chains of one block (rows of one list and one pair of chunks)."""
    x = _unit(_matrix(t.column("embedding"), int(t.column("dim")[0].as_py())))
    lists = t.column("pivots").combine_chunks()
    desc = lists.flatten().to_numpy().reshape(len(x), -1)
    own, node, n = (t.column(c).to_numpy() for c in ("chunk", "node", "n"))
    pivot, second, i, j = (int(t.column(c)[0].as_py()) for c in ("pivot", "second", "i", "j"))
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    a_out, b_out = [], []
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        ok = shared_counts(desc[rows], desc[right]) >= min(shared, desc.shape[1])
        if i == j:
            ok &= rows[:, None] < right[None, :]
        ok &= x[rows] @ x[right].T >= cosine
        a, b = np.nonzero(ok)
        a_out.append(rows[a])
        b_out.append(right[b])
    if not a_out:
        return []
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    if not len(a):
        return []
    here = np.concatenate([_counts_here(desc[a[s : s + 65536]], desc[b[s : s + 65536]], pivot, second) for s in range(0, len(a), 65536)])
    links = np.bincount(a[here], n[b[here]], len(x)) + np.bincount(b[here], n[a[here]], len(x))
    some = np.flatnonzero(links)
    u, v = chain(forest(len(x), a, b))
    return [(node[some], node[some], links[some].astype(np.int64)), (node[u], node[v], np.zeros(len(u), np.int64))]


def _count_links(batches: Iterator[pa.RecordBatch], cosine: float, shared: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by their five keys: (a, a, links of a in this block) and (a, b, 0) chains."""
    for t in whole_runs(batches, 5):
        at = runs(*[t.column(c).to_numpy() for c in range(5)])
        outs = [o for s, e in zip(at[:-1], at[1:]) if e - s > 1 for o in _block(t.slice(s, e - s), cosine, shared)]
        if outs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*outs)], ["a", "b", "links"])


def _filed(described: DataFrame) -> DataFrame:
    """Every member of every block: the keys k1, k2, second, i, j, then chunk, pivot and the vector."""
    keys = ["k1", "k2"]
    cell = lambda salt: F.xxhash64(F.lit(salt), "label", "dim", "pivot")
    lists = described.withColumn("pivot", F.explode("pivots")).withColumns({"k1": cell(1), "k2": cell(2)})
    long = materialise(lists.where(f"pivot <> {EXACT} AND size(pivots) > 1").groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") > SPLIT), "long")
    lists = attach(lists, long, keys)
    again = F.array_remove("pivots", F.col("pivot"))
    lists = lists.withColumn("second", F.explode(F.when(F.col("members").isNull(), F.array(F.lit(EXACT))).otherwise(again))).drop("members")
    keys = ["k1", "k2", "second"]
    sizes = materialise(lists.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") > CHUNK), "sizes")
    lists = attach(lists, sizes, keys)
    chunks = F.coalesce(F.ceil(F.col("members") / CHUNK), F.lit(1)).cast("int")
    lists = lists.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lists = lists.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    return lists.select(*keys, "i", "j", "chunk", "pivot", "node", "n", "dim", "embedding", "pivots")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, nearest: int | None = None, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Null labels, null or empty vectors, all-zero ones and those with a null or non-finite component link with nothing.
    Labels of any type are compared as they are. Vectors of different lengths never link. Equal vectors of a label link
    with each other. Every row is a vector of its own, repeated vec_ids too; a row without vec_id counts as a link and
    is never kept, and a component of such rows alone has no id. Other columns are not read; an empty table stays empty.
    """
    rows = _rows(vectors)
    classes = _classes(rows)
    described = _describe(classes, _fit(classes, pivots, nearest, cosine, shared))
    lists = _filed(described)
    keys = ["k1", "k2", "second", "i", "j"]
    lists = lists.repartition(partitions(lists), *keys).sortWithinPartitions(*keys, "node")
    told = materialise(lists.mapInArrow(lambda b: _count_links(b, cosine, shared), "a long, b long, links long"), "links")
    sums = told.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected(told.where("links = 0").select("a", "b"))
    comp = smallest(classes.select("node", "id"), roots)
    per_class = classes.select("h1", "h2", "node", "n").join(sums, "node", "left").join(comp, "node").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = join_unique(rows.select("vec_id", "h1", "h2"), materialise(per_class, "linked"), ["h1", "h2"])
    comp_id = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("vec_id"), F.lit(False)).alias("kept"))
