"""What an index over prints needs: key windows, node tests, insertion penalties and splits, as SQL over columns.

Spark has no index tree; blocks of prints sorted by song length (`blocks`) take the place of its nodes, and the node
test prunes blocks before a search looks at their prints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, unions

LONGEST = 100_000


def descend(q: str, low: str, high: str, share: str) -> str:
    """Whether a search for song length q looks into a node of lengths low..high whose containment score is share."""
    gap = f"CASE WHEN {q} < {low} THEN ({low} - {q}) / CAST({low} AS DOUBLE) ELSE ({q} - {high}) / CAST({q} AS DOUBLE) END"
    return f"""CASE WHEN {q} BETWEEN {low} AND {high} THEN {share} > CASE WHEN {q} > 150 THEN 0.10D WHEN {q} > 40 AND {q} < 46 THEN 0.03D ELSE 0.08D END
      WHEN {q} < 61 THEN {gap} < IF({q} < 30, 0.8D, 0.6D) AND {share} > 0.08D
      WHEN {q} < 155 THEN {gap} < IF({q} < 110, 0.07D, 0.05D) AND {share} > IF({q} > 150, 0.15D, 0.08D) ELSE false END"""


def penalty(u: str, a: str) -> str:
    """Cost of putting print a into union u: what of it lies outside, and how much the range of song lengths grows."""
    share = scores.contained(a, u)
    grown = f"(greatest({u}.max_songlen, {a}.songlen) - least({u}.min_songlen, {a}.songlen))"
    old = f"({u}.max_songlen - {u}.min_songlen)"
    outside = f"transform(array({share}), s -> IF(s > 0, (1 - s) * 100, 100D))[0]"
    return f"IF({u} IS NULL OR {a} IS NULL, 1e10D, {outside} + IF({grown} > 0, ({grown} - {old}) / CAST({grown} AS DOUBLE) * 2000, 0D))"


def same(a: str, b: str) -> str:
    """Whether two prints are equal, word for word."""
    return f"{a} <=> {b}"


def key(cprint: str, window: bool = True) -> str:
    """Words an index key keeps: a window of 240, or all of a print; prints of absurd length are an error."""
    kept = scores.key_window(cprint) if window else cprint
    return f"IF(size({cprint}) > {LONGEST}, raise_error('print too long'), {kept})"


def blocks(prints: DataFrame, size: int = 256) -> DataFrame:
    """prints plus `block`: neighbours by song length, about `size` to a block, split as a range exchange splits.

    Where a tree would split a full page at the middle of its song lengths, a range exchange places all rows at once.
    """
    n = max(1, prints.count() // size)
    dealt = prints.repartitionByRange(n, "songlen", "soid")
    return dealt.withColumn("block", F.spark_partition_id())


def split(entries: DataFrame, node: str) -> DataFrame:
    """entries(node, soid, songlen) plus side 0 or 1: the nearer end of the node's song lengths; nodes of equal lengths are
    halved by soid, and the nodes of one entry stay whole. Each side gets an entry at least."""
    w = Window.partitionBy(node)
    rows = entries.withColumns({"_low": F.min("songlen").over(w), "_high": F.max("songlen").over(w), "_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy("songlen", "soid"))})
    near = F.when(F.col("songlen") - F.col("_low") <= F.col("_high") - F.col("songlen"), 0).otherwise(1)
    halves = F.when(F.col("_at") * 2 <= F.col("_n") + F.col("_n") % 2, 0).otherwise(1)
    return rows.withColumn("side", F.when(F.col("_low") == F.col("_high"), halves).otherwise(near)).drop("_low", "_high", "_n", "_at")


def nodes(prints: DataFrame) -> DataFrame:
    """(block, u) of blocks()."""
    return unions.folded(prints, "block")
