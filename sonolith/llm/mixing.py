"""Mixing sources to target weights by entropy balancing (operator 1).

Each source s has a token target t_s. The rates r_i of its documents minimise the generalised entropy
sum r log r - r subject to 0 <= r <= CAP and sum size_i r_i = t_s. The convex dual has one multiplier a source, and its
optimum is r_i = min(CAP, exp(lambda_s x_i)) with x_i = size_i / mean size. Newton steps (kept inside a bracket) run on
sums of a (source, size) histogram that one pre-aggregated pass makes: it is exact, since rates depend on nothing
else, and it stays small and distributed; one row a source reaches the driver in each step. Sums are of decimals, so
they do not depend on how rows are dealt.

Rates become whole copies cell by cell of that histogram. All documents of a cell have one rate, so a cell owes a whole
number of additional copies; what rounding leaves over is carried in words from cell to cell, longest first. Who of the
cell gets them is decided by the hash of the row: the threshold is the hash of the last one that does. No text moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, fresh, join_unique, materialise, small_side, text_key

SHARE = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
#: Newton steps after which a source that has not met its target is an error; a bracket halves in each at worst.
STEPS = 200
#: Relative gap to the target at which a source is done, and the digits that terms of sums keep behind the point.
GAP, DIGITS = 1e-9, 9


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weights(sources: list[str | None]) -> list[float]:
    return [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sources))]


def fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Share total by weight; what exceeds cap * size stops there and its excess is reshared until none is above.

    A source stops once the common share a weight passes cap * size / weight, so one walk by that bound does all rounds."""
    target = [0.0] * len(sizes)
    able = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: cap * sizes[i] / weights[i])
    left, weight = float(total), math.fsum(weights[i] for i in able)
    for k, i in enumerate(able):
        if left * weights[i] <= cap * sizes[i] * weight:
            for j in able[k:]:
                target[j] = left * weights[j] / weight
            break
        target[i] = float(cap * sizes[i])
        left = max(0.0, left - target[i])
        weight = math.fsum(weights[j] for j in able[k + 1 :]) if k % 64 == 0 else weight - weights[i]
    return target


def _by_source(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Inner null-safe join of df with one small row for each of its sources."""
    small = small_side(df.sparkSession, rows, f"_source string, {columns}")
    return df.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def solve(hist: DataFrame, stats: dict, cap: float) -> dict:
    """lambda of each source (None: every rate at the cap). hist: (source, size, n)."""
    lam, low, high = {}, {}, {}
    for s, (n, size, target) in stats.items():
        if size == 0:
            lam[s] = 0.0
        elif target >= cap * size * (1 - 1e-12):
            lam[s] = None
        else:
            lam[s], low[s], high[s] = 0.0, -math.inf, math.inf
    open_ = set(low)
    for _ in range(STEPS):
        if not open_:
            break
        rows = [(s, float(lam[s]), stats[s][1] / stats[s][0]) for s in open_]
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))
        flat = F.col("lam") * x >= math.log(cap)
        exact = lambda term: F.sum(F.round(term, DIGITS).cast(f"decimal(38,{DIGITS})")).cast("double")
        sums = _by_source(hist, rows, "lam double, mean double").groupBy("source").agg(
            exact(F.col("n") * F.col("size") * raw).alias("got"),
            exact(F.when(~flat, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"),
        )
        for r in sums.collect():  # one row a source
            s, gap = r["source"], r["got"] - stats[r["source"]][2]
            if abs(gap) <= GAP * max(1.0, stats[s][2]):
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < step < high[s]:  # also nan
                ends = (low[s], high[s])
                step = sum(ends) / 2 if all(map(math.isfinite, ends)) else (2 * lam[s] - 1 if gap > 0 else 2 * lam[s] + 1)
            if step == lam[s]:  # the bracket is down to neighbouring doubles
                open_.discard(s)
            lam[s] = step
    if open_:
        raise ArithmeticError(f"{len(open_)} sources did not meet their targets")
    return lam


def _row_hash(docs: DataFrame, order: str) -> Column:
    """Hash of a row: of `order` and, so that ties differ, of all its columns."""
    return F.xxhash64(*([order] if order in docs.columns else []), *[text_key(F.col(f"`{c}`"), t) for c, t in docs.dtypes])


#: Leading bits of the hash by which rows of a cell are counted, level by level: 64 ranges of the one before each time.
LEVELS = (6, 12, 18)


def _thresholds(slim: DataFrame, cells: DataFrame) -> DataFrame:
    """cells(source, size, more) -> (source, size, last): the hash of the more-th row of the cell by rising hash.

    slim: source, size, hash of every row. Each level keeps the one range of a cell that holds the threshold, so a task sees
    64 counts of a hot cell, and only what the last level leaves of it (a row in 262,144) is sorted."""
    key = ["source", "size"]
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    asked = cells.where("more > 0").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "more")
    rows = slim
    for bits in LEVELS:
        ranged = rows.withColumn("range", F.shiftright("hash", 64 - bits))  # in the order of the hashes
        counts = ranged.groupBy(*key, "range").agg(F.count("*").alias("rows"))
        w = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("rows").over(w)).join(asked, same)
        hit = counts.where("upto >= more AND upto - rows < more").select("_source", "_size", F.col("range").alias("_range"), (F.col("more") - (F.col("upto") - F.col("rows"))).alias("more"))
        hit = materialise(hit, "ranges")
        rows = materialise(ranged.join(hit.drop("more"), same & (F.col("range") == F.col("_range"))).select(*key, "hash"), "within")
        asked = hit.drop("_range")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("hash")))
    return placed.join(asked, same & (F.col("at") == F.col("more"))).select(*key, F.col("hash").alias("last"))


def mix(docs: DataFrame, weights: Callable[[list], list] = default_weights, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs plus size, source_size, target, rate and copies (0 to cap, rounded up); every row stays, in any order.

    docs needs source and size (words). weights: function of the sources by code point, null last. A null source is a
    source; documents of size 0 keep one copy and take no words; an empty table stays empty. Rows that are equal in
    every column are rows of their own but are treated alike, so their cell may miss its share by what they are.
    Columns of docs named as the new ones are replaced. Copies depend on rows and settings only, not on how rows are dealt.
    """
    docs = docs.drop("source_size", "target", "rate", "copies")
    slim = materialise(docs.select("source", F.col("size").cast("long").alias("size"), _row_hash(docs, "doc_id").alias("hash")), "sizes")
    hist = materialise(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    rows = hist.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # one row a source
    names = [r["source"] for r in rows]
    targets = fill([r["size"] for r in rows], weights(names), share * sum(r["size"] for r in rows), cap)
    stats = {r["source"]: (r["n"], r["size"], t) for r, t in zip(rows, targets)}
    lam = solve(hist, stats, cap)
    told = [(s, size, target, lam[s], size / n if size else 1.0) for s, (n, size, target) in stats.items()]
    cells = _by_source(hist, told, "source_size long, target double, _lam double, _mean double")
    tilt = F.exp(F.least(F.col("_lam") * F.col("size") / F.col("_mean"), F.lit(math.log(cap))))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("_lam").isNull(), F.lit(float(cap))).otherwise(F.least(tilt, F.lit(float(cap))))
    cells = cells.withColumn("rate", rate).withColumn("base", F.when(F.col("size") == 0, 1).otherwise(F.floor("rate")).cast("long"))
    given = materialise(_rounded(cells), "given")
    last = materialise(_thresholds(slim, given), "last")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    cells = given.join(last.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "last"), same, "left").drop("_s", "_z")
    hash_, cell, s_, z_, told_ = fresh(docs, "_hash", "_cell", "_source", "_size", "_told")
    told = F.struct("source_size", "target", "rate", "base", "last").alias(told_)
    cells = materialise(cells.select(F.xxhash64("source", "size").alias(cell), F.col("source").alias(s_), F.col("size").alias(z_), told), "cells")
    out = docs.withColumn(hash_, _row_hash(docs, "doc_id")).withColumn(cell, F.xxhash64("source", F.col("size").cast("long")))
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells.withColumnRenamed(cell, f"{cell}2"))
        out = out.join(cells, (F.col(cell) == F.col(f"{cell}2")) & F.col("source").eqNullSafe(F.col(s_)) & (F.col("size") == F.col(z_)))
    else:  # cells of one hash are told apart by source and size
        whole = cells.groupBy(cell).agg(F.collect_list(F.struct(s_, z_, told_)).alias(told_))
        out = join_unique(materialise(out, "rows"), materialise(whole, "cells"), cell, "inner")
        own = F.filter(told_, lambda c: c[s_].eqNullSafe(F.col("source")) & (c[z_] == F.col("size")))
        out = out.withColumn(told_, own[0][told_])
    t = F.col(told_)
    copies = t["base"] + F.when(F.col(hash_) <= t["last"], 1).otherwise(0)
    return out.select(*docs.columns, *[t[c].alias(c) for c in ("source_size", "target", "rate")], copies.cast("int").alias("copies"))


def _rounded(cells: DataFrame) -> DataFrame:
    """cells(source, size, n, rate, base, ...) plus `more`: additional copies of each cell, so that a source's words are those
    of its rates up to half a document; a source's cells, not its rows, are walked in order."""

    def run(key, t):
        t = t.sort_by([("size", "descending")])
        more, owed = [], 0.0
        for size, n, base, rate in zip(*(t.column(c).to_pylist() for c in ("size", "n", "base", "rate"))):
            owed += (rate - base) * n * size
            k = 0 if size == 0 or rate == base else min(n, max(0, math.floor(owed / size + 0.5)))
            owed -= k * size
            more.append(k)
        return t.append_column("more", pa.array(more, pa.int64()))

    fields = ", ".join(f"`{c}` {k}" for c, k in cells.dtypes)
    return cells.groupBy("source").applyInArrow(run, f"{fields}, more long")


def repeated(mixed: DataFrame) -> DataFrame:
    """Every row as often as its copies say."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
