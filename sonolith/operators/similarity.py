"""Lossless similarity joins over fingerprints.

Prints meet in cells: chunks of a bucket of song lengths against chunks of the same bucket and of its neighbours. A print
travels as its two short parts and one place of a low bit a word, deflated (a quarter of a byte a word), never as keys or
whole words. In a cell every pair within the gate is compared: first by one bit a word, 64 at a time, which rules out all
but a few, then wholly. So nothing is missed, and what is shuffled does not grow with the pairs.

`plan` and `ladder` say which keys of equal bands would miss nothing at a given share; joins no longer use them, as a row
a key took many times the disk of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..schema import DOM_WORDS, MATCH_CP, MATCH_SCORE, R_WORDS
from ..storage import materialise


@dataclass(frozen=True)
class Keys:
    """Keys of `take` out of `group` bands of `width` positions; they miss nothing from `least` common positions on."""

    width: int
    group: int
    take: int
    least: int

    @property
    def positions(self) -> int:
        return self.width * self.take


def plan(share: float, width: int, group: int, take: int) -> Keys | None:
    """A group without `take` equal bands has (group - take + 1) differences; floor(n / span) groups must not hold them all."""
    span = width * group
    kept, most = (group - take + 1) / span, (1 - share) * (1 + 1e-9)
    return Keys(width, group, take, floor(kept * (span - 1) / (kept - most)) + 1) if kept > most else None


def ladder(share: float, limits: tuple[int, ...] = (40, 90, 200, 500), rows: float = 1.0, positions: int = 14) -> list[Keys]:
    """The keys of most positions for each length limit, at no more than `rows` keys a word; stronger ones for longer prints."""
    shapes = [(w, g, t) for w in range(1, 7) for g in range(1, 11) for t in range(1, g + 1) if comb(g, t) <= rows * w * g and w * t <= positions]
    found = [k for k in (plan(share, *s) for s in shapes) if k]
    out: list[Keys] = []
    for limit in limits:
        fit = [k for k in found if k.least <= limit]
        if fit:
            best = max(fit, key=lambda k: (k.positions, -comb(k.group, k.take) / (k.width * k.group), -k.least))
            if not out or best.positions > out[-1].positions:
                out.append(best)
    return out


BUCKET = "CAST(IF(songlen <= 0, -9, floor(ln(songlen) / ln(1.11D))) AS INT)"

#: Most prints and words of a chunk; a bucket of song lengths with more is dealt out to several chunks.
CHUNK_ROWS, CHUNK_WORDS = 16_384, 1 << 24
#: Pairs held at a time while a cell is compared, and positions while candidates are.
STEP_PAIRS, STEP_WORDS = 1 << 21, 1 << 22
_SLIM = "cls binary, songlen long, n long, bucket int, r binary, dom binary, low binary"
_LINKS = "a binary, b binary, cp double, fm double"


def _slim(fp: DataFrame) -> DataFrame:
    """(soid, cls, songlen, n, bucket, r, dom, low) of prints that can match at all, written: `low` is the deflated place of
    each word's low bit, `cls` a 128-bit hash of all that scores depend on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            soid, songlen, bucket = b.column(0), b.column(1), b.column(2)
            (r, r_at), (dom, dom_at), (words, at) = (_flat(b.column(k)) for k in (3, 4, 5))
            if (np.diff(r_at) != R_WORDS).any() or (np.diff(dom_at) != DOM_WORDS).any():
                raise ValueError(f"a print has {R_WORDS} r words and {DOM_WORDS} dom words")
            words = words.view(np.uint64)
            place = np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1))  # 64 for a word of 0
            r, dom = r.astype("<u4"), dom.astype("<u2")
            cls, parts = [], ([], [], [])
            for k, length in enumerate(songlen.to_pylist()):
                three = r[r_at[k] : r_at[k + 1]].tobytes(), dom[dom_at[k] : dom_at[k + 1]].tobytes(), place[at[k] : at[k + 1]].tobytes()
                cls.append(blake2b(b"%d," % length + b"".join(three), digest_size=16).digest())
                for out, one in zip(parts, (three[0], three[1], zlib.compress(three[2], 1))):
                    out.append(one)
            arrays = [soid, pa.array(cls, pa.binary()), songlen, pa.array(np.diff(at), pa.int64()), bucket, *(pa.array(p, pa.binary()) for p in parts)]
            yield pa.RecordBatch.from_arrays(arrays, ["soid", "cls", "songlen", "n", "bucket", "r", "dom", "low"])

    rows = fp.where("soid IS NOT NULL AND songlen >= 0 AND size(cprint) > 0 AND r32 IS NOT NULL AND dom16 IS NOT NULL")
    rows = rows.selectExpr("soid", "CAST(songlen AS BIGINT) AS songlen", f"{BUCKET} AS bucket", "r32", "dom16", "cprint")
    return materialise(rows.mapInArrow(run, f"soid {dict(fp.dtypes)['soid']}, {_SLIM}"), "slim")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin, from 0."""
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _cells(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Rows (bucket, kind, i, j, side, ...) of the cells in which prints meet: chunk i of a bucket on the left (side 0), chunk j
    of the same (kind 0) or a neighbouring bucket on the right (side 1). Without `right`, left meets itself once: side 2
    is on both, and only the next bucket is a neighbour."""
    spark = left.sparkSession

    def chunks(df: DataFrame) -> dict[int, int]:
        told = df.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()  # some hundred buckets
        return {r["bucket"]: max(-(-r["rows"] // CHUNK_ROWS), -(-r["words"] // CHUNK_WORDS)) for r in told}

    k_left = chunks(left)
    k_right = k_left if right is None else chunks(right)
    steps = (1,) if right is None else (-1, 0, 1)

    def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], side: int) -> DataFrame:
        """To each chunk of the other side's buckets within reach."""
        sign = 1 if side == 0 else -1
        told = [(b, k, b + sign * s if side else b, s, other[b + sign * s]) for b, k in own.items() for s in steps if b + sign * s in other]
        known = spark.createDataFrame(told, "bucket int, k int, cell int, kind int, others int")
        met = df.join(F.broadcast(known), "bucket").withColumn("own", F.expr("CAST(pmod(xxhash64(cls), k) AS INT)"))
        met = met.withColumn("other", F.explode(F.expr("sequence(0, others - 1)")))
        i, j = ("own", "other") if side == 0 else ("other", "own")
        return met.select("cell", "kind", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), *_COLUMNS)

    parts = [dealt(left, k_left, k_right, 0), dealt(left if right is None else right, k_right, k_left, 1)]
    if right is None:
        known = spark.createDataFrame(list(k_left.items()), "bucket int, k int")
        met = left.join(F.broadcast(known), "bucket").withColumn("own", F.expr("CAST(pmod(xxhash64(cls), k) AS INT)"))
        met = met.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        parts.append(met.select(F.col("bucket").alias("cell"), F.lit(0).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), *_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_COLUMNS = ("cls", "songlen", "n", "r", "dom", "low")


class _Side:
    """Prints of one side of a cell, by song length."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("songlen", "ascending"), ("cls", "ascending")])
        self.cls, self.songlen, self.n = t.column("cls").combine_chunks(), t.column("songlen").to_numpy(), t.column("n").to_numpy()
        rows = t.num_rows
        self.r = np.frombuffer(b"".join(t.column("r").to_pylist()), "<u4").reshape(rows, -1)
        self.dom = np.frombuffer(b"".join(t.column("dom").to_pylist()), "<u2").reshape(rows, -1)
        self.place = np.frombuffer(b"".join(zlib.decompress(x) for x in t.column("low").to_pylist()), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        wide = -(-int(self.n.max(initial=0)) // 64)
        self.plane = np.zeros((wide, rows), np.uint64)  # bit p of row k: word p of print k is odd
        for k in range(rows):
            bits = np.packbits(self.place[self.at[k] : self.at[k + 1]] == 0).tobytes()
            self.plane[: -(-len(bits) // 8), k] = np.frombuffer(bits.ljust(-(-len(bits) // 8) * 8, b"\0"), np.uint64)


def _candidates(x: _Side, y: _Side, share: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that the odd bits alone do not rule out: where they differ the low bits do too, and so they do beyond the
    shorter print, where only one side's bits are set."""
    spare = (1 - share) * (1 + 1e-9)
    room_x, room_y = (spare * x.n).astype(np.float32) + np.float32(0.01), (spare * y.n).astype(np.float32) + np.float32(0.01)
    low, high = np.searchsorted(y.songlen, -(-10 * x.songlen // 11)), np.searchsorted(y.songlen, 11 * x.songlen // 10, "right")
    at = 0
    while at < len(x.n):
        end = at + 1
        while end < len(x.n) and end - at < 512 and (end + 1 - at) * (high[end] - low[at]) <= STEP_PAIRS:
            end += 1
        s, e = int(max(low[at], at + 1) if itself else low[at]), int(high[end - 1])
        if e > s:
            room = np.maximum(room_x[at:end, None], room_y[None, s:e])
            differ = np.zeros(room.shape, np.uint32)
            wide = min(-(-int(x.n[at:end].max()) // 64), len(y.plane))
            a = None
            for w in range(wide):
                if a is None:
                    differ += np.bitwise_count(x.plane[w, at:end, None] ^ y.plane[w, None, s:e])
                    if w + 1 == wide or w % 4 == 3:
                        alive = differ <= room
                        if w + 1 == wide or 16 * np.count_nonzero(alive) < alive.size:
                            a, b = np.nonzero(alive)
                            count, space = differ[a, b], room[a, b]
                            a, b = a + at, b + s
                else:  # few are left: one by one
                    count = count + np.bitwise_count(x.plane[w, a] ^ y.plane[w, b])
                    ok = count <= space
                    a, b, count, space = a[ok], b[ok], count[ok], space[ok]
            if a is not None and len(a):
                near = 10 * np.abs(x.songlen[a] - y.songlen[b]) <= np.minimum(x.songlen[a], y.songlen[b])
                near &= np.minimum(x.n[a], y.n[b]) > share * (1 - 1e-9) * np.maximum(x.n[a], y.n[b])
                near &= (a < b) if itself else True
                yield a[near], b[near]
        at = end


def _told(x: _Side, y: _Side, a: np.ndarray, b: np.ndarray, share: float) -> pa.RecordBatch:
    """The scores of index pairs whose share of low bits is above `share`, or so near that rounding might matter."""
    common, longer = np.minimum(x.n[a], y.n[b]), np.maximum(x.n[a], y.n[b])
    ends = np.cumsum(common)
    within = np.arange(ends[-1]) - np.repeat(ends - common, common)
    same = x.place[np.repeat(x.at[a], common) + within] == y.place[np.repeat(y.at[b], common) + within]
    cp = np.add.reduceat(same, ends - common, dtype=np.int64) / longer
    ok = cp > share * (1 - 1e-9)
    a, b, cp = a[ok], b[ok], cp[ok]
    fm = np.zeros(len(a))
    for k in range(0, len(a), 1 << 14):
        p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
        v = x.r[p] ^ y.r[q]
        r = np.bitwise_count(v & np.uint32(0x55555555)) + 4 * np.bitwise_count(v & np.uint32(0xAAAAAAAA)).astype(np.int64) + 4 * np.bitwise_count(v & (v >> np.uint32(1)) & np.uint32(0x55555555)).astype(np.int64)
        d = np.bitwise_count(x.dom[p] ^ y.dom[q])
        fm[k : k + (1 << 14)] = np.clip(2.0 * ((1.0 - (r.sum(axis=1) + d.sum(axis=1, dtype=np.int64)) / 25584.0) - 0.5), 0.0, 1.0)
    return pa.RecordBatch.from_arrays([x.cls.take(pa.array(a)), y.cls.take(pa.array(b)), pa.array(cp), pa.array(fm)], ["a", "b", "cp", "fm"])


def _compare(t: pa.Table, share: float) -> pa.Table:
    """All matches of a cell; a chunk may have no print."""
    empty = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("cp", pa.float64()), ("fm", pa.float64())])
    side = t.column("side").to_numpy()
    both = bool((side == 2).any())
    if not both and (side == side[0]).all():
        return empty.empty_table()
    x = _Side(t.filter(pa.array(side != 1)))
    y = x if both else _Side(t.filter(pa.array(side == 1)))
    out = []
    for a, b in _candidates(x, y, share, both):
        words = np.cumsum(np.minimum(x.n[a], y.n[b]))
        cuts = np.unique(np.append(np.searchsorted(words, np.arange(0, words[-1] if len(words) else 0, STEP_WORDS)), len(a)))
        out += [_told(x, y, a[s:e], b[s:e], share) for s, e in zip(cuts[:-1], cuts[1:])]
    return pa.Table.from_batches(out, empty)


def scored_pairs(fp: DataFrame, share: float = MATCH_CP, left: DataFrame | None = None) -> DataFrame:
    """(a, b, cp, fm): every pair of soid in the gate whose share of equal low bits is above `share` (give or take the
    rounding of doubles), once; a < b within fp, or a of `left` against another b of fp.

    Equal prints are one class; classes are compared, and their pairs spread to the members when they are read."""
    rows = _slim(fp)
    return _scored(rows, _classes(rows), share, None if left is None else _slim(left))


def _classes(rows: DataFrame) -> DataFrame:
    """One print of each class of slim rows, written."""
    return materialise(rows.dropDuplicates(["cls"]).drop("soid"), "classes")


def _scored(rows: DataFrame, classes: DataFrame, share: float, asked: DataFrame | None = None) -> DataFrame:
    """scored_pairs of slim rows and their classes, with themselves or with those that are asked for (slim as well)."""
    cells = _cells(classes, None) if asked is None else _cells(_classes(asked), classes)
    links = materialise(cells.groupBy("cell", "kind", "i", "j").applyInArrow(lambda t: _compare(t, share), _LINKS), "links")
    one, two = (rows if asked is None else asked).selectExpr("cls AS a", "soid AS p"), rows.selectExpr("cls AS b", "soid AS q")
    met = links.join(one, "a").join(two, "b").where("p <> q")
    if asked is not None:
        return met.select(F.col("p").alias("a"), F.col("q").alias("b"), "cp", "fm")
    equal = one.join(two, F.col("a") == F.col("b")).where("p < q").selectExpr("p AS a", "q AS b", "1D AS cp", "1D AS fm")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "cp", "fm").unionByName(equal)


def similarity_join(fp: DataFrame, score: float = MATCH_SCORE, share: float = MATCH_CP, left: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of all pairs whose blended score exceeds `score`: a < b, or a of `left` against every other print.
    share must bound the score (see schema)."""
    return _blended(scored_pairs(fp, share, left), score)


def _blended(found: DataFrame, score: float) -> DataFrame:
    found = found.select("a", "b", F.expr(scores.polynomial("cp", "fm")).alias("score"))
    return found.where(F.col("score") > score)


def all_pairs_results(fp: DataFrame, cp: float = 0.72, fm: float = 0.72) -> DataFrame:
    """(a, b, cp, fm) of pairs in the gate whose two scores both exceed their thresholds."""
    return scored_pairs(fp, cp).where((F.col("cp") > cp) & (F.col("fm") > fm))


def probe(fp: DataFrame, queries: DataFrame, score: float = MATCH_SCORE) -> DataFrame:
    """(soid, match, score) of what matches each of the query prints (soid and the six fields), best first; a query's own
    row does not count."""
    hits = similarity_join(fp, score, left=queries).select(F.col("a").alias("soid"), F.col("b").alias("match"), "score")
    return hits.orderBy("soid", F.desc("score"), "match")


def second_hop(fp: DataFrame, queries: DataFrame, score: float = MATCH_SCORE) -> DataFrame:
    """(origin, soid, match, score): what matches the matches of each query, but for the query itself."""
    rows = _slim(fp)
    classes = _classes(rows)  # written once for both hops
    first = materialise(_blended(_scored(rows, classes, MATCH_CP, _slim(queries)), score).select(F.col("a").alias("origin"), F.col("b").alias("soid")), "first")
    hops = materialise(rows.join(first.select("soid").distinct(), "soid", "left_semi"), "hops")
    second = _blended(_scored(rows, classes, MATCH_CP, hops), score).select(F.col("a").alias("soid"), F.col("b").alias("match"), "score")
    return first.join(second, "soid").where("match <> origin").select("origin", "soid", "match", "score")


def without_overreach(links: DataFrame, factor: float = 1.05) -> DataFrame:
    """Directed matches (a, m, score) less those m that have a better friend: some e other than a with
    score(m, e) > factor * score(a, m). The two best friends of each m decide, so one aggregated row a print is joined."""
    both = links.selectExpr("a", "b AS m", "score").unionByName(links.selectExpr("b AS a", "a AS m", "score"))
    best = both.groupBy(F.col("a").alias("m")).agg(F.max(F.struct("score", F.col("m").alias("e"))).alias("first"))
    rest = both.join(best.withColumnRenamed("m", "a"), "a").where("m <> first.e").groupBy(F.col("a").alias("m")).agg(F.max("score").alias("second"))
    other = F.when(F.col("first.e") == F.col("a"), F.col("second")).otherwise(F.col("first.score"))
    told = both.join(best, "m").join(rest, "m", "left").withColumn("other", other)
    return told.where(F.col("other").isNull() | (F.col("other") <= F.lit(factor) * F.col("score"))).select("a", "m", "score")
