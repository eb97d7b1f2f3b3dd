"""Similarity algebra as SQL text over columns: inlined by the analyzer, no Python on the way.

Every function takes SQL names of arrays of non-negative BIGINT words and returns a SQL expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def popcount(x: str) -> str:
    return f"bit_count({x} & 4294967295L)"


def low(x: str) -> str:
    """Lowest set bit, 0 for 0."""
    return f"({x} & -{x})"


def total(array: str) -> str:
    return f"aggregate({array}, 0L, (s, v) -> s + v)"


def dibit(x: str) -> str:
    """c1 + 4 c2 + 9 c3 over the two-bit values of a word, in closed form."""
    return f"(bit_count({x} & 1431655765L) + 4 * bit_count({x} & 2863311530L) + 4 * bit_count({x} & shiftright({x}, 1) & 1431655765L))"


def r_distance(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (x, y) -> CAST({dibit('(x ^ y)')} AS BIGINT))")


def dom_distance(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (x, y) -> CAST(bit_count(x ^ y) AS BIGINT))")


def confidence(r: str, dom: str) -> str:
    """fm from the two distances; 25584 = 9 * 348 * 8 + 66 * 8."""
    return f"greatest(least(2D * ((1D - ({r} + {dom}) / 25584D) - 0.5D), 1D), 0D)"


def fm(a: str, b: str) -> str:
    return confidence(r_distance(f"{a}.r32", f"{b}.r32"), dom_distance(f"{a}.dom16", f"{b}.dom16"))


def shorter(a: str, b: str) -> str:
    return f"least(size({a}), size({b}))"


def cp(a: str, b: str) -> str:
    """Share of positions with equal low bits, of the longer length."""
    n = shorter(a, b)
    hits = total(f"zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x, y) -> IF({low('x')} = {low('y')}, 1L, 0L))")
    return f"IF({n} = 0, 0D, {hits} / CAST(greatest(size({a}), size({b})) AS DOUBLE))"


def gate(la: str, lb: str) -> str:
    """Song lengths within a tenth of the shorter one."""
    return f"(10 * abs({la} - {lb}) <= least({la}, {lb}))"


def polynomial(cp_: str, fm_: str) -> str:
    return f"((0.012985D + 0.263439D * {fm_} - 0.683234D * {cp_} + 1.592623D * {cp_} * {cp_} * {cp_} + 0.06348D) / 1.2489D)"


def blend(a: str, b: str) -> str:
    """The score; 0 outside the gate."""
    once = f"transform(array({cp(a + '.cprint', b + '.cprint')}), share -> {polynomial('share', fm(a, b))})[0]"  # the share of low bits enters four times
    return f"IF({gate(a + '.songlen', b + '.songlen')}, {once}, 0D)"


def whole_hamming(a: str, b: str) -> str:
    n = shorter(a, b)
    bits = total(f"zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x, y) -> CAST(bit_count(x ^ y) AS BIGINT))")
    return f"IF({n} = 0, 1D, 1D - {bits} / CAST(32 * {n} AS DOUBLE))"


def tanimoto(a: str, b: str) -> str:
    n = shorter(a, b)
    part = lambda op: total(f"zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x, y) -> CAST(bit_count(x {op} y) AS BIGINT))")
    return f"CASE WHEN {n} = 0 THEN 0D WHEN {part('|')} = 0 THEN 1D ELSE {part('&')} / CAST({part('|')} AS DOUBLE) END"


def signed(x: str) -> str:
    return f"IF({x} >= 2147483648L, {x} - 4294967296L, {x})"


def pearson(a: str, b: str) -> str:
    """|correlation| of the signed words over the common length; NaN where a side has no variance."""
    n = shorter(a, b)
    xs, ys = (f"transform(slice({v}, 1, {n}), x -> CAST({signed('x')} AS DOUBLE))" for v in (a, b))
    add = lambda arr: f"aggregate({arr}, 0D, (s, v) -> s + v)"
    prod = lambda p, q: add(f"zip_with({p}, {q}, (u, w) -> u * w)")
    nn = f"CAST({n} AS DOUBLE)"
    vx, vy = (f"({nn} * {prod(v, v)} - {add(v)} * {add(v)})" for v in (xs, ys))
    top = f"({nn} * {prod(xs, ys)} - {add(xs)} * {add(ys)})"
    some = lambda v: f"array_min({v}) < array_max({v})"
    return f"IF({some(xs)} AND {some(ys)}, abs({top}) / (sqrt({vx}) * sqrt({vy})), DOUBLE('NaN'))"


def merged(a: str, b: str) -> str:
    """OR of two word arrays, the longer one's tail kept."""
    return f"zip_with({a}, {b}, (x, y) -> coalesce(x, 0L) | coalesce(y, 0L))"


def contained(a: str, u: str) -> str:
    """How far words of print a lie within union u, blended and clamped to 0..1; each distance is summed once."""
    r = total(f"zip_with({a}.r32, {u}.r32, (x, y) -> CAST({dibit('(x & ~y)')} AS BIGINT))")
    d = total(f"zip_with({a}.dom16, {u}.dom16, (x, y) -> CAST(bit_count(x & ~y) AS BIGINT))")
    n = shorter(f"{a}.cprint", f"{u}.cprint")
    hits = total(f"zip_with(slice({a}.cprint, 1, {n}), slice({u}.cprint, 1, {n}), (x, y) -> IF((x & ~y) = 0 OR {low('x')} = {low('y')}, 1L, 0L))")
    share = f"IF(size({a}.cprint) = 0, 0D, {hits} / CAST(size({a}.cprint) AS DOUBLE))"
    parts = f"named_struct('share', {share}, 'conf', {confidence(r, d)})"
    return f"transform(array({parts}), p -> greatest(0D, least(1D, {polynomial('p.share', 'p.conf')})))[0]"


def problem(dom: str, cprint: str, length: str, songlen: str) -> str:
    """What makes a print useless, or NULL: silence, or fewer words than its first minute should give. The length of the
    metadata counts; where it is missing or 0, the print's own."""
    seconds = f"least(coalesce(nullif({length}, 0), {songlen}), 60)"
    return f"CASE WHEN forall({dom}, x -> x = 0) THEN 'silent track: dom is 0' WHEN size({cprint}) < floor({seconds} * 15.8D) THEN 'small print' END"


def key_window(a: str, width: int = 240) -> str:
    """The part of a print that index keys keep, chosen by its length."""
    return f"slice({a}, CASE WHEN size({a}) >= 944 THEN 705 WHEN size({a}) >= 704 THEN 465 ELSE 1 END, {width})"


FP = "STRUCT<songlen BIGINT, bit_rate BIGINT, num_errors BIGINT, r32 ARRAY<BIGINT>, dom16 ARRAY<BIGINT>, cprint ARRAY<BIGINT>>"


def register(spark: SparkSession) -> None:
    """SQL surface: fprint_cmp, fprint_eq, fprint_neq, fprint_match, fprint_songlen, fprint_num_errors (null in, null out)."""
    two = f"a {FP}, b {FP}"
    strict = lambda x: f"IF(a IS NULL OR b IS NULL, NULL, {x})"
    made = {
        "fprint_cmp": (two, "DOUBLE", strict(blend("a", "b"))), "fprint_eq": (two, "BOOLEAN", strict(f"{blend('a', 'b')} > 0.98D")),
        "fprint_neq": (two, "BOOLEAN", strict(f"{blend('a', 'b')} <= 0.98D")), "fprint_match": (two, "BOOLEAN", strict(f"{blend('a', 'b')} > 0.6D")),
        "fprint_songlen": (f"a {FP}", "BIGINT", "a.songlen"), "fprint_num_errors": (f"a {FP}", "BIGINT", "a.num_errors"),
    }
    for name, (args, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
