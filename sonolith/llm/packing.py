"""Mixture-controlled packing (operator 3).

Every source is a queue of token ids. Deficit round-robin gives each window of 2048 tokens each queue's quantum of its
target proportion, in whole tokens, and carries what rounding leaves owing to the next window. With cumulative
proportions Q_s (tokens a window, exact fractions) the carried deficits have a closed form: before window w queue s
has been served floor(w Q_s) - floor(w Q_{s-1}) tokens, every window is full, and each queue is within one token of its
share at all times. So any partition can cut its documents without knowing what others do; deficits carry across
windows and partitions alike. Given proportions hold until a queue can't meet them; that queue then leaves the round,
and in the end the rest is served by what remains, so all queues end together. The last partial window is cut into
sequences of powers of two, which need no padding.

Tokenising writes ids once; only numbers are sorted and summed to place them (blocks of about sqrt(n) documents in each
queue), and one exchange brings ids to their blocks for cutting.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim_memory, materialise, partitions, pieces, small_batches, small_side
from .tokens import default_tokenizer, tokenizer

WINDOW = 2048
END_ID = 1


@dataclass
class Phase:
    """Windows `first` .. `first + count` - 1 in which queue k gets its part of cum[k + 1] - cum[k] of cum[-1]."""

    first: int
    count: int
    cum: list[int]
    start: list[int]  # tokens each queue had given before

    def served(self, k: int, w: int) -> int:
        """Tokens that queue k gives in the phase's first w windows."""
        return w * WINDOW * self.cum[k + 1] // self.cum[-1] - w * WINDOW * self.cum[k] // self.cum[-1]

    def before(self, k: int, w: int) -> int:
        """Tokens of the phase's window w that stand before those of queue k."""
        return (w + 1) * WINDOW * self.cum[k] // self.cum[-1] - w * WINDOW * self.cum[k] // self.cum[-1]

    def window(self, k: int, pos: int) -> int:
        """The window that takes the queue's token pos (counted from the phase's start)."""
        part = self.cum[k + 1] - self.cum[k]
        w = min(max(pos * self.cum[-1] // (WINDOW * part), 0), self.count - 1)
        while self.served(k, w) > pos:
            w -= 1
        while self.served(k, w + 1) <= pos:
            w += 1
        return w


@dataclass
class Plan:
    phases: list[Phase]
    totals: list[int]
    tail_first: int  # sequence id
    tail_start: list[int]  # tokens of each queue before the tail
    tail_at: list[int]  # place of each queue in the tail
    tail_ends: list[int]  # ends of the tail's sequences

    def pieces(self, k: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the queue's tokens start .. start + length, in order."""
        pos, end = start, start + length
        for p in self.phases:
            stop = p.start[k] + p.served(k, p.count)
            while pos < min(end, stop):
                w = p.window(k, pos - p.start[k])
                begin = p.start[k] + p.served(k, w)
                n = min(end, p.start[k] + p.served(k, w + 1)) - pos
                yield p.first + w, p.before(k, w) + pos - begin, n
                pos += n
        while pos < end:
            at = self.tail_at[k] + pos - self.tail_start[k]
            i = bisect_right(self.tail_ends, at)
            n = min(end - pos, self.tail_ends[i] - at)
            yield self.tail_first + i, at - (self.tail_ends[i - 1] if i else 0), n
            pos += n


def queues(totals: list[int]) -> list[int]:
    """Queue of each source: its own where it fills at least a token a window, else one shared with other small ones."""
    whole, out, shared, load, n = sum(totals), [0] * len(totals), None, 0, 0
    for i in sorted(range(len(totals)), key=lambda i: -totals[i]):
        if totals[i] * WINDOW >= whole:
            out[i], n = n, n + 1
        else:
            if shared is None:
                shared, n = n, n + 1
            out[i], load = shared, load + totals[i]
    if shared is not None and load * WINDOW < whole and n > 1:  # even together too small: they join the smallest queue
        out = [min(q, shared - 1) for q in out]
    return out


def plan(totals: list[int], weights: list[int] | None = None) -> Plan:
    """totals: tokens of each queue. weights: whole-number target proportions; none: the queues' own proportions."""
    left, first, phases = list(totals), 0, []
    served = [0] * len(totals)

    def run(parts: list[int], count: int) -> None:
        nonlocal first
        cum = [0]
        for x in parts:
            cum.append(cum[-1] + x)
        p = Phase(first, count, cum, list(served))
        for k in range(len(totals)):
            n = p.served(k, count)
            served[k] += n
            left[k] -= n
        phases.append(p)
        first += count

    active = [bool(weights and weights[k] and left[k]) for k in range(len(totals))]
    while any(active):
        parts = [weights[k] if active[k] else 0 for k in range(len(totals))]
        small = [k for k, x in enumerate(parts) if x and x * WINDOW < sum(parts)]
        if small:  # beside what is left of the others: such a queue ends the round, its rest goes by shares
            active = [a and k not in small for k, a in enumerate(active)]
            continue
        # a queue may be served a token more than its share, so one is kept back
        count = min(max(0, left[k] - 1) * sum(parts) // (parts[k] * WINDOW) for k in range(len(totals)) if active[k])
        if count:
            run(parts, count)
        active = [a and max(0, left[k] - 1) * sum(parts) >= parts[k] * WINDOW for k, a in enumerate(active)]
    rest = sum(left)
    if rest >= WINDOW:
        small = [k for k in range(len(totals)) if left[k] and left[k] * WINDOW < rest]
        parts = [0 if k in small else left[k] for k in range(len(totals))]  # crumbs of ended queues go to the tail
        run(parts, sum(parts) // WINDOW)
    at, places = 0, []
    for k in range(len(totals)):
        places.append(at)
        at += left[k]
    ends, power, done = [], 1 << 62, 0
    while done + WINDOW < at:  # only crumbs of very many queues reach this
        done += WINDOW
        ends.append(done)
    while done < at:
        while power > at - done:
            power //= 2
        done += power
        ends.append(done)
    return Plan(phases, totals, first, list(served), places, ends)


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Written table (row, doc_id, source, n, ids): ids little-endian unsigned 16-bit where the vocabulary allows, else
    32-bit; null text counts as empty, so every row has the closing id at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        narrow = len(tok.vocab) + len(tok.special) < 1 << 16
        close = end_id.to_bytes(4, "little")
        for b in pieces(batches):
            ids = [tok.ids(t.as_py() or "") + close for t in b.column("text")]
            n = [len(x) // 4 for x in ids]
            if narrow:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    rows = slim.mapInArrow(run, "doc_id long, source string, n long, ids binary")
    with small_batches(docs.sparkSession):
        return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "ids")


def shared_queues(tokens: list[int], weights: list[int]) -> tuple[list[int], list[int]]:
    """(queue of each source, target of each queue): sources whose target is under a token a window share one queue, at their
    targets' sum, or join the smallest other one where even that is too little. Sources without a target share one as well."""
    whole = sum(weights)
    able = [i for i, w in enumerate(weights) if w * WINDOW >= whole and w]
    place, rates = {i: q for q, i in enumerate(able)}, [weights[i] for i in able]
    small = [i for i, w in enumerate(weights) if w and i not in place]
    if small:
        load = sum(weights[i] for i in small)
        if load * WINDOW >= whole or not able:
            rates.append(load)
            place |= dict.fromkeys(small, len(rates) - 1)
        else:
            least = min(range(len(rates)), key=lambda q: (rates[q], q))
            rates[least] += load
            place |= dict.fromkeys(small, least)
    if len(place) < len(weights):
        place |= {i: len(rates) for i in range(len(weights)) if i not in place}
        rates.append(0)
    return [place[i] for i in range(len(weights))], rates


def pack(docs: DataFrame, path: str | None = None, weights: Callable[[list], list[int]] | dict[str | None, int] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, padded_length, row): one row a piece.

    Every id of every row of docs lies in exactly one piece; repeated doc_ids are rows of their own (`row` tells them
    apart). Null sources form a queue. Null or empty texts are their closing id. weights: target proportions of
    sources in whole numbers, by name or as a function of the sources by code point, null last (default: each source's
    own share, which can be held to the end). A source that runs out leaves the others to fill the windows by their
    targets; sources without a target come when all others are used up. Other columns of docs are not read.
    """
    rows = tokenised(docs, path or default_tokenizer())
    told = rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).collect()  # a row a source
    told.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names = [r["source"] for r in told]
    if weights:
        given = list(weights(names)) if callable(weights) else [weights.get(s, 0) for s in names]
        place, rates = shared_queues([r["tokens"] for r in told], given)
    else:
        place, rates = queues([r["tokens"] for r in told]), None
    n_queues = max(place, default=-1) + 1
    totals, counts = [0] * n_queues, [0] * n_queues
    for r, q in zip(told, place):
        totals[q] += r["tokens"]
        counts[q] += r["docs"]
    schedule = plan(totals, rates)
    small = [(r["source"], q, math.isqrt(counts[q] - 1) + 1) for r, q in zip(told, place)]
    small = small_side(docs.sparkSession, small, "_source string, queue int, blocks long")
    placed = rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    sums = placed.groupBy("queue", "block").agg(F.sum("n").alias("tokens"))
    base = sums.select("queue", "block", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("block")) - F.col("tokens")).alias("base"))
    base = base.repartition(partitions(docs), "queue", "block")  # else the join would deal the ids anew, by queue alone
    within = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = starts.join(base, ["queue", "block"]).withColumn("at", F.col("at") + F.col("base"))
    cut = starts.select("doc_id", "source", "row", "queue", "at", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory(__name__, lambda: None)  # the tokenizer's cache goes
        for b in pieces(batches, 100):
            out: list[list] = [[] for _ in range(10)]
            for doc, source, row, q, at, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                wide = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                for seq, offset, length in schedule.pieces(q, at, n):
                    crc = zlib.crc32(memoryview(wide)[4 * start : 4 * (start + length)])
                    for x, v in zip(out, (doc, start, length, crc, n, seq, offset, source, 0, row)):
                        x.append(v)
                    start += length
            lengths = [schedule.tail_ends[s - schedule.tail_first] - (schedule.tail_ends[s - schedule.tail_first - 1] if s > schedule.tail_first else 0) if s >= schedule.tail_first else WINDOW for s in out[5]]
            out[8] = lengths
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded_length", "row"])

    return cut.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, padded_length long, row long")
