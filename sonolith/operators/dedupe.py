"""Suspects, best-copy election, and the deduplication of songs by their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..storage import discard, materialise

#: Likeness of albums and of names that count as the same.
ALBUM_RATIO, NAME_RATIO = 0.5, 0.8


def suspects(scored: DataFrame, oid: str, value: str, mean: float = 0.7, more_than: int = 3) -> DataFrame:
    """(oid, mean, n, values): ids whose mean likeness stays low although they matched often."""
    told = scored.groupBy(F.col(oid).alias("oid")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    low = told.where((F.col("mean") < mean) & (F.col("n") > more_than))
    lists = scored.join(low.select(F.col("oid").alias(oid)), oid, "left_semi").groupBy(F.col(oid).alias("oid")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return low.join(lists, "oid")


def _rank(bitrate: str, errors: str) -> list[Column]:
    """Columns whose least struct is the best copy."""
    good = F.col(errors) <= 1
    return [(~good).alias("k1"), F.when(good, -F.col(bitrate)).alias("k2"), F.col(errors).alias("k3"), (-F.col(bitrate)).alias("k4")]


def elect(rows: DataFrame, group: str, bitrate: str = "bit_rate", errors: str = "num_errors", order: str = "soid") -> DataFrame:
    """rows with `place`: 1 is the copy of a group to keep. Among copies of at most one error the bit rate decides, then
    the errors; without any such copy the errors decide, then the bit rate."""
    w = Window.partitionBy(group).orderBy(*_rank(bitrate, errors), order)
    return rows.withColumn("place", F.row_number().over(w))


def dupe_table(pairs: DataFrame, elected: DataFrame, group: str = "grp") -> DataFrame:
    """(oid, dupe_of): for each copy that is not its group's best, the best one."""
    best = elected.where("place = 1").select(group, F.col("soid").alias("dupe_of"))
    return elected.where("place > 1").select("soid", group).join(best, group).select(F.col("soid").alias("oid"), "dupe_of")


def graph(results: DataFrame, polynomial) -> DataFrame:
    """results(oid1, oid2, cp, fm) -> undirected edges (oid1, oid2, weight), each once."""
    ends = [F.least("oid1", "oid2").alias("oid1"), F.greatest("oid1", "oid2").alias("oid2")]
    return results.select(*ends, F.expr(polynomial("cp", "fm")).alias("weight")).groupBy("oid1", "oid2").agg(F.max("weight").alias("weight"))


def both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """pairs (oid1, oid2, ...) in both orientations."""
    turned = pairs.select(F.col("oid2").alias("oid1"), F.col("oid1").alias("oid2"), *more)
    return pairs.select("oid1", "oid2", *more).unionByName(turned).dropDuplicates(["oid1", "oid2"])


def same_song(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """(oid1, oid2) of pairs(oid1, oid2, sm) whose metadata say that they are one recording.

    songs: oid, artists array, album, title. Albums are equal, or alike by ALBUM_RATIO with or without the second one's
    remarks. Unless the names are equal (sm = 1): both or neither album and title are live, both or neither are clean
    edits with the same remark, an artist is shared and the names are alike by NAME_RATIO.
    """
    told = songs.select(
        "oid", "artists", F.lower("album").alias("album"), F.lower("title").alias("title"),
    ).select(
        "*", names.joined_words(F.col("album")).alias("album_words"), names.joined_words(F.regexp_replace("album", names.REMARK, "")).alias("bare_words"),
        F.struct(names.is_live(F.col("album")).alias("a"), names.is_live(F.col("title")).alias("t")).alias("live"),
        F.struct(names.clean_remark(F.col("album")).alias("a"), names.clean_remark(F.col("title")).alias("t")).alias("clean"),
    )
    one, two = (told.select(F.col("oid").alias(f"oid{k}"), F.struct(*[c for c in told.columns if c != "oid"]).alias(f"s{k}")) for k in (1, 2))
    rows = pairs.select("oid1", "oid2", "sm").join(one, "oid1").join(two, "oid2")
    equal = F.col("s1.album") == F.col("s2.album")
    rows = rows.withColumn("like", F.when(equal, 1.0).otherwise(F.greatest(names.ratio("s1.album_words", "s2.album_words"), names.ratio("s1.album_words", "s2.bare_words"))))
    alike = (F.col("s1.live") == F.col("s2.live")) & (F.col("s1.clean") == F.col("s2.clean")) & F.arrays_overlap("s1.artists", "s2.artists") & (F.col("sm") >= NAME_RATIO)
    return rows.where((F.col("like") >= ALBUM_RATIO) & ((F.col("sm") == 1.0) | alike)).select("oid1", "oid2")


def _processed(marks: DataFrame) -> DataFrame:
    """(seed, v): which seeds mark v as a copy -> (v) that are never seeds, if seeds are taken by rising id and a marked one
    is passed over. Ids are settled once all who could mark them are; each round settles every id whose markers are."""
    open_ = materialise(marks, "marks")
    passed: list[DataFrame] = []
    while not open_.isEmpty():
        first = open_.select("seed").distinct().join(open_.select(F.col("v").alias("seed")).distinct(), "seed", "left_anti")
        hit = materialise(open_.join(first, "seed", "left_semi").select("v").distinct(), "passed")  # marked by a seed that nobody marks
        passed.append(hit)
        rest = open_.join(hit, "v", "left_anti").join(hit.select(F.col("v").alias("seed")), "seed", "left_anti").join(first, "seed", "left_anti")
        rest = materialise(rest, "marks")
        discard(open_)
        open_ = rest
    out = marks.select("v").limit(0)
    for p in passed:
        out = out.unionByName(p)
    return out.distinct()


def dedupe(pairs: DataFrame, songs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suspects (oid), dupes (oid, dupe_of array), best (oid, best_of array)) of pairs(oid1, oid2, sm).

    songs: oid, artists, album, title, bit_rate, num_errors. Seeds are taken by rising oid; a seed that an earlier one
    made a copy is passed over. A seed with its same songs forms a group and its best member is elected; a seed that has
    no same song among its pairs is a suspect. Each song appears at most once as a seed, and may be a copy of several.
    """
    linked = both_ways(pairs, "sm")
    same = materialise(same_song(linked, songs), "same")
    seeds = linked.select(F.col("oid1").alias("seed")).distinct()
    members = seeds.select("seed", F.col("seed").alias("oid"), F.lit(0).alias("_later")).unionByName(same.select(F.col("oid1").alias("seed"), F.col("oid2").alias("oid"), F.lit(1).alias("_later")))
    group = members.join(songs.select("oid", "bit_rate", "num_errors"), "oid")
    best = group.groupBy("seed").agg(F.min(F.struct(*_rank("bit_rate", "num_errors"), F.col("_later").alias("k5"), "oid")).alias("b")).select("seed", F.col("b.oid").alias("best"))
    placed = materialise(group.select("seed", "oid").join(best, "seed"), "placed")
    marks = placed.where("oid <> best AND oid > seed").select("seed", F.col("oid").alias("v"))
    passed = materialise(_processed(marks), "passed").withColumnRenamed("v", "seed")
    live = placed.join(passed, "seed", "left_anti")
    copies = live.where("oid <> best")
    dupes = copies.groupBy("oid").agg(F.sort_array(F.collect_set("best")).alias("dupe_of"))
    best_of = copies.groupBy(F.col("best").alias("oid")).agg(F.sort_array(F.collect_set("oid")).alias("best_of"))
    alone = live.join(same.select(F.col("oid1").alias("seed")).distinct(), "seed", "left_anti").select(F.col("seed").alias("oid"))
    return alone, dupes, best_of


def add_to_set(rows: DataFrame, column: str, more: DataFrame, key: str = "oid") -> DataFrame:
    """rows with the array `column` joined, without repeats, by the array of the same name in more(key, column)."""
    add = more.select(key, F.col(column).alias("_more"))
    grown = F.array_union(F.coalesce(F.col(column), F.expr("array()").cast(dict(more.dtypes)[column])), "_more")
    return rows.join(add, key, "left").withColumn(column, F.when(F.col("_more").isNull(), F.col(column)).otherwise(grown)).drop("_more")
