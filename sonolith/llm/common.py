"""Helpers shared by the corpus operators: reading, durable intermediate tables, run-wise batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, shared_dir  # noqa: F401

#: The ASCII white space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table made on the driver (one a source) up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small_side(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver rows for a join; its size is known, so the other side need not be shuffled by a hot key."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


#: Rows of a table of keys up to which join_unique broadcasts it.
JOIN_ROWS = 50_000


def join_unique(big: DataFrame, small: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """Equi-join (left or inner) of big with small, which has one row a key at most.

    A small of up to JOIN_ROWS rows is broadcast. Else a key with more than a quarter of a partition's share of big's rows is hot; there are fewer than four a partition of
    those, so their rows of small are broadcast and no hot key goes through the shuffle. Both sides should be written
    tables, as they are read more than once. Null keys match nothing, and with `left` never travel.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if small.count() <= JOIN_ROWS:
        return big.join(F.broadcast(small), keys, how)
    parts = partitions(big)
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    bound = max(16, big.count() // (4 * parts))
    hot = big.where(known).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > bound).select(*keys)
    out = [big.where(known).join(small, keys, how)]
    few = hot.collect()  # fewer than 4 * parts keys
    if few:
        hot = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in few], hot.schema))
        some = F.broadcast(small.join(hot, keys, "left_semi"))
        cold = big.where(known).join(hot, keys, "left_anti").join(small, keys, how)
        out = [big.join(hot, keys, "left_semi").join(some, keys, how), cold]
    if how == "left":
        more = [c for c in small.columns if c not in keys]
        types = dict(small.dtypes)
        lost = big.where(f"NOT ({known})").select(*keys, *[c for c in big.columns if c not in keys], *[F.lit(None).cast(types[c]).alias(c) for c in more])
        out.append(lost)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


#: Words of 64 ids up to which with_ids broadcasts them (67 million ids in a row).
ID_WORDS = 1 << 20


def with_ids(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of big whose `key`, a long, is in ids(key); repeats and nulls in ids do no harm, null keys match nothing.

    Tasks get the ids as bits, 64 a word, so big and its texts stay where they lie. Ids too far apart for that are joined
    by a shuffle."""
    word, bits = fresh(big, "_word", "_bits")
    at = f"CAST(CAST(`{key}` AS BIGINT) & 63 AS INT)"
    told = ids.where(f"`{key}` IS NOT NULL").groupBy(F.expr(f"shiftright(CAST(`{key}` AS BIGINT), 6)").alias(word))
    words = materialise(told.agg(F.expr(f"bit_or(shiftleft(1L, {at}))").alias(bits)), "words")
    if words.count() > ID_WORDS:
        return big.join(ids, key, "left_semi")
    met = big.join(F.broadcast(words), F.expr(f"shiftright(CAST(`{key}` AS BIGINT), 6)") == F.col(word))
    return met.where(f"getbit({bits}, {at}) = 1").select(*[F.col(f"`{c}`") for c in big.columns])


def attach(big: DataFrame, small: DataFrame, keys: str | list[str]) -> DataFrame:
    """Left join of big with small (one row a key, a written table): broadcast where it has few rows, else by join_unique."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, "left")
    return join_unique(materialise(big, "big"), small, keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body (Catalyst would inline a plain alias into lambdas)."""
    return F.transform(F.array(value), body)[0]


#: Rows of an Arrow batch that a Python worker unpacks at a time.
PIECE_ROWS = 500


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices (views, no copies), so that unpacked texts and results of few rows are held."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2 * PIECE_ROWS) -> Iterator[None]:
    """What is written inside hands texts to Python workers in batches of so many rows at most: an executor holds each
    batch in its own memory, as it grows and as it is sent, and the worker holds it again."""
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


_claimed: list[tuple[object, Callable[[], None]]] = []


def claim_memory(owner: object, forget: Callable[[], None]) -> None:
    """Called when a task starts in a Python worker: caches that another owner left there in earlier tasks are dropped
    (workers are reused), so that a chain of operators needs as much memory as its largest one."""
    if _claimed and _claimed[0][0] is owner:
        return
    while _claimed:
        _claimed.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)
    _claimed.append((owner, forget))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start offsets, with the total length last, of runs of equal rows in sorted key columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Regroup sorted Arrow batches so that no run of equal keys (the first n_keys columns) spans two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        if held:
            last = [held[-1].column(i)[-1].as_py() for i in range(n_keys)]
            if all(k[-1] == v for k, v in zip(keys, last)):
                held.append(b)  # the run that is open goes on through the whole batch
                continue
        cut = int(runs(*keys)[-2])
        if cut or not held:
            head = [*held, b.slice(0, cut)] if cut else []
        else:
            head = held
        if head:
            yield pa.Table.from_batches(head)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each of n nodes under the edges a-b; vectorised label propagation."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(before, label):
            return label
    return label


def chain(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the members of each label one after the other: linear in number, and no member is hot."""
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return order[:-1][same], order[1:][same]


def text_key(c: Column, kind: str) -> Column:
    """A string that tells values of any type apart; null stays null."""
    if kind == "binary":
        return F.hex(c)
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")))) if kind.startswith(("array", "struct", "map", "variant")) else c.cast("string")
