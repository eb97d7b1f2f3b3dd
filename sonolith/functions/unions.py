"""Unions of prints and their scores, as SQL text over structs with r32, dom16, cprint (prints also songlen, unions also
min_songlen and max_songlen), and the fold of groups into unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scores

PARTS = ("r32", "dom16", "cprint")


def of_two(a: str, b: str) -> str:
    """Union of two prints."""
    parts = ", ".join(f"'{p}', {scores.merged(f'{a}.{p}', f'{b}.{p}')}" for p in PARTS)
    return f"named_struct('min_songlen', least({a}.songlen, {b}.songlen), 'max_songlen', greatest({a}.songlen, {b}.songlen), {parts})"


def with_print(u: str, a: str) -> str:
    """Union u grown by print a; a minimum of 0 counts as not set."""
    parts = ", ".join(f"'{p}', {scores.merged(f'{u}.{p}', f'{a}.{p}')}" for p in PARTS)
    low = f"IF({u}.min_songlen = 0, {a}.songlen, least({u}.min_songlen, {a}.songlen))"
    return f"named_struct('min_songlen', {low}, 'max_songlen', greatest({u}.max_songlen, {a}.songlen), {parts})"


def against(u1: str, u2: str) -> str:
    """How far union u1 lies within union u2; 0 where their song lengths don't meet."""
    apart = f"{u1}.max_songlen < {u2}.min_songlen OR {u2}.max_songlen < {u1}.min_songlen"
    return f"IF({apart}, 0D, {scores.contained(u1, u2)})"


def what_if(u1: str, u2: str, a: str) -> str:
    """How far u1 would lie within u2 if print a joined u2; song lengths are not looked at."""
    return f"transform(array({with_print(u2, a)}), grown -> {scores.contained(u1, 'grown')})[0]"


def folded(prints: DataFrame, group: str) -> DataFrame:
    """prints(group, songlen, r32, dom16, cprint) -> (group, u): one union a group.

    Words are OR-ed by position with map-side combination, so a group of any size is spread over its positions; only
    one finished union a group (as long as its longest print) comes together at the end.
    """
    part = lambda p, k: f"transform({p}, (w, i) -> named_struct('part', {k}, 'pos', i, 'word', w))"
    rows = prints.select(F.col(group).alias("g"), "songlen", F.explode(F.expr(f"concat({', '.join(part(p, k) for k, p in enumerate(PARTS))})")).alias("c"))
    words = rows.groupBy("g", "c.part", "c.pos").agg(F.expr("bit_or(c.word)").alias("word"))
    cells = words.groupBy("g").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == k, F.struct("pos", "word")))).alias(p) for k, p in enumerate(PARTS)])
    lengths = prints.groupBy(F.col(group).alias("g")).agg(F.min("songlen").alias("min_songlen"), F.max("songlen").alias("max_songlen"))
    whole = lengths.join(cells.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2")), "left")
    values = [F.coalesce(F.transform(p, lambda c: c["word"]), F.array().cast("array<bigint>")).alias(p) for p in PARTS]
    return whole.select(F.col("g").alias(group), F.struct("min_songlen", "max_songlen", *values).alias("u"))
