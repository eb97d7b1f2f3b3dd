"""Document fingerprints: bottom-k sketches of word-shingle hashes (operator 7, native).

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's shingles. It merges across parts
(merge), and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

K = 128
SHINGLE = 5
_SPACE = 2.0**64


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>, ascending: A-Z lower-cased words at ASCII white space; fewer words than `shingle`: one shingle of
    them all; null, empty or blank text: an empty sketch."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marks = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(m: Column) -> Column:
        whole = F.array(F.xxhash64(m))
        each = F.transform(F.sequence(F.lit(1), F.size(m) - (shingle - 1)), lambda i: F.xxhash64(F.slice(m, i, shingle)))
        return F.when(F.size(m) >= shingle, each).when(F.size(m) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.coalesce(F.slice(F.array_sort(F.array_distinct(let(marks, hashes))), 1, k), F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets, from their sketches."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike (1)."""
    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return F.when(a == b, F.lit(1.0)).otherwise(let(merge(a, b, k), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    rank = (F.element_at(a, k).cast("double") + F.lit(_SPACE / 2)) / F.lit(_SPACE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained (1)."""
    union = distinct_shingles(merge(a, b, k), k)
    est = F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(est)


def as_text(a: Column) -> Column:
    """Hexadecimal digits, 16 for each hash; equal sketches give equal strings."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


#: Rows that a block of neighbouring ids holds, and the most blocks (their bounds are a literal of 8 bytes each).
BLOCK_ROWS, MAX_BLOCKS = 32, 65_536


def _blocks(docs: DataFrame) -> Column:
    """Block number of a doc_id, ascending with it; bounds are quantiles, so blocks stay even whatever the ids."""
    n = docs.count()
    want = max(1, min(MAX_BLOCKS, n // BLOCK_ROWS))
    if want == 1:
        return F.lit(0)
    shares = [i / want for i in range(1, want)]
    bounds = docs.select(F.expr("doc_id").alias("d")).agg(F.percentile_approx("d", shares, 10 * want).alias("q")).head()["q"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse = bounds[step - 1 :: step]
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda row: F.size(F.filter(row, lambda b: b <= F.col("doc_id")))
    lit = lambda x, kind: F.from_json(F.lit(str(x)), kind)
    at = below(lit(coarse, "array<bigint>"))
    return at * step + F.coalesce(below(F.get(lit(fine, "array<array<bigint>>"), at)), F.lit(0))


def with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) with columns `sketch` and `next`, a struct (text, sketch) of the following row by
    (doc_id, text), the first row after the last.

    One exchange of the rows by blocks of neighbouring ids; the block's last row takes the first of the next block
    from a table with one row per block; only those first texts are sketched a second time.
    """
    docs = docs.withColumn("block", _blocks(docs))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    own = F.struct("text", "sketch")
    rows = docs.withColumn("sketch", sketch(F.col("text"), k, shingle)).withColumn("next", F.lead(own).over(order))
    firsts = docs.groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    firsts = firsts.select("block", F.struct(F.col("first.text").alias("text"), sketch(F.col("first.text"), k, shingle).alias("sketch")).alias("first"))
    firsts = materialise(firsts, "firsts")
    names = [r["block"] for r in firsts.select("block").orderBy("block").collect()]  # at most MAX_BLOCKS
    follow = docs.sparkSession.createDataFrame(list(zip(names[-1:] + names[:-1], names)), "block int, next_block int")
    wrap = follow.join(firsts.select(F.col("block").alias("next_block"), "first"), "next_block").select("block", "first")
    tails = rows.join(wrap, "block", "left") if names else rows.withColumn("first", F.lit(None).cast(dict(rows.dtypes)["next"]))
    return tails.withColumn("next", F.coalesce("next", "first")).drop("first", "block")


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    Null text counts as empty. Repeated doc_ids follow each other in the order of their texts, null ids come first; a
    single row is its own next document. Other columns of docs are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, k, shingle)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    swap = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - swap).cast("int")), F.substring(F.col("next.text"), F.lit(1), swap))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, shingle).alias("edited_sketch"), F.col("next.sketch").alias("next_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"), containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_in_edited"),
    )
