"""Signal operators: windows over frames, folds, quantisers and iterative fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from . import frames

#: Fixed values of the feature extraction: smoothing coefficients and the Gray code of the four levels.
FIR = (0.25, 0.75, 1.0, 0.75, 0.25)
GRAY = (0, 1, 3, 2)


def fir(rows: DataFrame, keys: list[str], frame: str, value: str, coefficients=FIR) -> DataFrame:
    """rows plus `smooth`: the weighted sum of each value and its predecessors; the first len - 1 frames of a song give none.
    Frames count from 0 within the keys."""
    w, n = frames.over(keys, frame), len(coefficients)
    smooth = sum((F.lit(c) * F.lag(value, n - 1 - k).over(w) for k, c in enumerate(coefficients)), F.lit(0.0))
    return frames.windowed(rows, keys, frame, n - 1, {"smooth": smooth}).where(F.col(frame) >= n - 1)


def decimate(rows: DataFrame, keys: list[str], frame: str, value: str, factor: int) -> DataFrame:
    """Mean of each whole block of `factor` frames, which count from 0."""
    block = F.floor(F.col(frame) / factor).alias("block")
    return rows.groupBy(*keys, block).agg(F.avg(value).alias("mean"), F.count("*").alias("_n")).where(F.col("_n") == factor).drop("_n")


def quantise(value: Column, t0: float, t1: float, t2: float) -> Column:
    return F.when(value < t1, F.when(value < t0, 0).otherwise(1)).otherwise(F.when(value < t2, 2).otherwise(3))


def pack_gray(levels: str) -> str:
    """SQL: array of levels 0..3 -> one unsigned word, two Gray-coded bits each."""
    return f"aggregate({levels}, 0L, (w, q) -> w * 4 + element_at(array(0L, 1L, 3L, 2L), CAST(q AS INT) + 1))"


def normalised(values: str, least: float = 0.01) -> str:
    """SQL: array over its L2 norm, zeros where the norm is below `least`."""
    norm = f"sqrt(aggregate({values}, 0D, (s, x) -> s + x * x))"
    return f"transform({values}, x -> IF({norm} < {least}D, 0D, x / {norm}))"


def real_note(bin_: str, rate: float, frame: int) -> str:
    """SQL: pitch of a spectrum bin in semitones above an A, 0 to 12."""
    octave = f"(ln({bin_} * {rate}D / {frame} / (440D / 16)) / ln(2D))"
    return f"12 * ({octave} - floor({octave}))"


def note_of(bin_: str, rate: float, frame: int) -> str:
    """SQL: pitch class 0..11 of a spectrum bin."""
    return f"CAST(floor({real_note(bin_, rate, frame)}) AS INT)"


def note_parts(bin_: str, energy: str, rate: float, frame: int) -> str:
    """SQL: array of (note, energy): a bin's energy shared between its pitch class and the nearer neighbour."""
    shared = "array(named_struct('note', CAST(floor(r) AS INT), 'energy', e * (1 - abs(r - floor(r) - 0.5D))), named_struct('note', CAST((floor(r) + IF(r - floor(r) < 0.5D, 11, 1)) % 12 AS INT), 'energy', e * abs(r - floor(r) - 0.5D)))"
    return f"flatten(transform(array({real_note(bin_, rate, frame)}), r -> flatten(transform(array({energy}), e -> {shared}))))"


def lloyd(values: DataFrame, column: str, levels: int) -> list[float]:
    """Thresholds of a Lloyd-Max quantiser of non-null values, to convergence.

    Levels start evenly from the least to the greatest value; centroids and midpoints alternate until the mean
    distortion changes by no more than rounding. A value on a threshold belongs above it, and a level without values
    moves to the middle of its cell. Values are counted once; a round is one aggregation of those counts to a row a
    level. Distortion falls in every round, so the loop ends.
    """
    v = materialise(values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")), "values")
    low, high, whole = v.agg(F.min("v"), F.max("v"), F.sum("n")).head()
    if low is None or levels < 2:
        discard(v)
        return []
    stop = max(2.220446049250313e-16 * abs(high), 1e-7)
    points = [low + k * (high - low) / (levels - 1) for k in range(levels)]
    middle = lambda: [(a + b) / 2 for a, b in zip(points, points[1:])]
    loss, change = 1.0, 1.0
    while change > stop:
        cuts = middle()
        cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v")))
        point = F.element_at(F.array(*map(F.lit, points)), cell + 1)
        rows = v.groupBy(cell.alias("k")).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"), F.sum(F.col("n") * (F.col("v") - point) ** 2).alias("loss")).collect()
        means = {r["k"]: r["m"] for r in rows}
        ends = [low, *cuts, high]
        points = [means.get(k, (ends[k] + ends[k + 1]) / 2) for k in range(levels)]
        now = sum(r["loss"] for r in rows) / whole
        change, loss = abs(loss - now), now
    discard(v)
    return middle()


def set_bit_steps(words: str) -> str:
    """SQL: for each word, how far each set bit lies above the one before it (the first: above bit 0), with a 0 at the
    end; words are first combined with their predecessors by exclusive or."""
    changed = f"transform({words}, (word_, nth_) -> (word_ ^ IF(nth_ = 0, 0L, get({words}, nth_ - 1))) & 4294967295L)"
    places = "filter(sequence(1, 32), p -> shiftright(x, p - 1) & 1 = 1)"
    steps = f"transform(array({places}), ps -> concat(transform(ps, (p, k) -> p - IF(k = 0, 0, get(ps, k - 1))), array(0)))[0]"
    return f"flatten(transform({changed}, x -> {steps}))"


def packed_bits(values: str, width: int) -> str:
    """SQL: string of hex bytes of values of `width` bits laid one after the other from the low end of the first byte."""
    bits = f"flatten(transform({values}, v -> transform(sequence(0, {width - 1}), b -> shiftright(v, b) & 1)))"
    one = " + ".join(f"{1 << j} * coalesce(get(bits, 8 * k + {j}), 0)" for j in range(8))
    byte = f"lpad(hex({one}), 2, '0')"
    each = f"transform(sequence(0, CAST(ceil(size(bits) / 8) AS INT) - 1), k -> {byte})"
    return f"transform(array({bits}), bits -> IF(size(bits) = 0, '', array_join({each}, '')))[0]"


def compressed(words: str) -> str:
    """SQL: binary form of a print. Four bytes, high first, tell its length; then the bit steps follow in 3 bits each,
    where 7 stands for 7 or more, then what the long ones have above 7, in 5 bits each."""
    head = f"lpad(hex(size({words})), 8, '0')"
    body = f"transform(array({set_bit_steps(words)}), s -> concat({packed_bits('transform(s, v -> least(v, 7))', 3)}, {packed_bits('transform(filter(s, v -> v >= 7), v -> v - 7)', 5)}))[0]"
    return f"unhex(concat({head}, {body}))"
