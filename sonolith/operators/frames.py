"""Frames of songs at any length: numbering, prefix sums and moving windows without a task that holds a whole song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

BLOCK = 4096


def numbered(rows: DataFrame, song: str, order: str, name: str = "frame") -> DataFrame:
    """rows plus their number within the song from 0, in order.

    Rows are dealt by ranges of (song, order), numbered within each range, and moved on by what earlier ranges hold: one
    row a song and range is summed up, whatever the length of a song.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(parts, song, order).withColumn("_part", F.spark_partition_id()), "frames")
    within = Window.partitionBy("_part", song).orderBy(order)
    counts = dealt.groupBy("_part", F.col(song).alias("_song")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_song").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), "_song", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_at", F.row_number().over(within) - 1)
    out = own.join(starts, (F.col("_part") == F.col("_p")) & F.col(song).eqNullSafe(F.col("_song")))
    return out.withColumn(name, (F.col("_at") + F.col("_start")).cast("long")).drop("_part", "_p", "_song", "_at", "_start")


def prefix_sums(rows: DataFrame, keys: list[str], frame: str, value: str, name: str = "prefix", block: int = BLOCK) -> DataFrame:
    """rows plus the running sum of value by keys up to and with each frame: within blocks, plus the sums of the blocks
    before."""
    cut = rows.withColumn("_block", F.floor(F.col(frame) / block))
    own = Window.partitionBy(*keys, "_block").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0))).drop("_sum")
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = cut.withColumn("_own", F.sum(value).over(own)).join(bases, same)
    return out.withColumn(name, F.col("_own") + F.col("_base")).drop("_block", "_b", "_own", "_base", *[f"_{k}" for k in keys])


def windowed(rows: DataFrame, keys: list[str], frame: str, reach: int, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows plus columns over `Window.partitionBy(*keys, "_block").orderBy(frame)` that look back `reach` rows at most.

    A block carries the last `reach` rows of the one before it and gives them back afterwards.
    """
    own = F.floor(F.col(frame) / block)
    after = F.floor((F.col(frame) + reach) / block)
    cut = rows.withColumn("_block", F.explode(F.array_distinct(F.array(own, after)))).withColumns(columns)
    return cut.where(F.col("_block") == own).drop("_block")


def over(keys: list[str], frame: str) -> Window:
    """The window that columns of `windowed` are over."""
    return Window.partitionBy(*keys, "_block").orderBy(frame)


def hops(rows: DataFrame, song: str, frame: str, value: str, size: int, hop: int) -> DataFrame:
    """(song, start, values): every whole window of `size` frames, one each `hop` frames."""
    last = F.floor(F.col(frame) / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col(frame) - (size - 1)) / hop))
    spread = rows.select(song, frame, value, F.explode(F.when(first <= last, F.sequence(first, last))).alias("window"))
    cut = spread.groupBy(song, "window").agg(F.sort_array(F.collect_list(F.struct(frame, value))).alias("v"))
    return cut.where(F.size("v") == size).select(song, (F.col("window") * hop).alias("start"), F.transform("v", lambda x: x[value]).alias("values"))
