"""Regression groups of re-encoded songs, their comparison report, and tables as text or images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

#: Fixed value: how names of re-encoded variants end.
VARIANT = r"(?i)_(\d{5})_s_(\d{2,3})(?:_(vbr))?_-50_\.(mp3|flac)$"
COLUMNS = ("artist", "title", "enc1", "br1", "fq1", "cn1", "is_vbr1", "vol_change1", "enc2", "br2", "fq2", "cn2", "is_vbr2", "vol_change2", "cp", "fm")


def is_variant(path: Column) -> Column:
    return path.rlike(VARIANT)


def grouped(files: DataFrame, path: str = "path") -> DataFrame:
    """files plus dir, base and is_base: variants and their base file share dir and base."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    folder = F.regexp_replace(p, r"/?[^/]*$", "")
    bare = F.when(is_variant(p), F.regexp_replace(name, VARIANT, "")).otherwise(F.regexp_replace(name, r"(?i)\.(mp3|flac)$", ""))
    return files.where(p.rlike(r"(?i)\.(mp3|flac)$")).withColumns({"dir": folder, "base": bare, "is_base": ~is_variant(p)})


def paired_names(files: DataFrame, path: str = "path") -> DataFrame:
    """files plus `song`: what stands before the first hyphen of the base name, the evaluation's key."""
    return files.withColumn("song", F.substring_index(F.element_at(F.split(F.col(path), "/"), -1), "-", 1))


def comparison(songs: DataFrame) -> DataFrame:
    """All pairs within each (dir, base), ordered by fn: the sixteen columns of the report.

    songs: dir, base, fn, artist, title, enc, bit_rate, sample_rate, channels and the print's r32, dom16, cprint. A base
    has a handful of variants, so the equi-join stays linear in the songs. Missing properties take the usual values.
    """
    vbr = F.when(F.lower(F.regexp_extract("fn", VARIANT, 3)) == "vbr", 1).otherwise(0)
    side = songs.select(
        "dir", "base", "fn", "artist", "title", F.coalesce("enc", F.lit("mp3")).alias("enc"), F.coalesce("bit_rate", F.lit(320)).cast("long").alias("br"),
        F.coalesce("sample_rate", F.lit(44100)).cast("long").alias("fq"), F.coalesce("channels", F.lit(2)).cast("long").alias("cn"), vbr.alias("is_vbr"),
        F.when(is_variant(F.col("fn")), -50).otherwise(0).alias("vol_change"), F.struct("r32", "dom16", "cprint").alias("fp"),
    )
    later = side.select("dir", "base", *[F.col(c).alias(f"{c}2") for c in side.columns if c not in ("dir", "base")])
    one = side.select("dir", "base", "artist", "title", *[F.col(c).alias(f"{c}1") for c in side.columns if c not in ("dir", "base", "artist", "title")])
    rows = one.join(later, ["dir", "base"]).where("fn1 < fn2")
    told = [F.expr(scores.cp("fp1.cprint", "fp2.cprint")).alias("cp"), F.expr(scores.fm("fp1", "fp2")).alias("fm")]
    return rows.select("fn1", "fn2", *[F.col(c) for c in COLUMNS[:-2]], *told)


def encoding(value: Column) -> Column:
    """File endings as the report names them."""
    low = F.lower(value)
    return F.when(low == ".mp3", "mp3").when(low.startswith(".fla"), "flac").otherwise(value)


def write_report(rows: DataFrame, path: str) -> None:
    """The sixteen columns, tab-separated with a header, quoted only where needed."""
    named = rows.select(*[encoding(F.col(c)).alias(c) if c.startswith("enc") else F.col(c) for c in COLUMNS])
    named.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def text_table(rows: DataFrame, left: tuple[str, ...] = (), formats: dict | None = None, limit: int = 20) -> str:
    """The first `limit` rows as lines of aligned columns; columns of `left` and strings are flush left."""
    kinds, head = dict(rows.dtypes), rows.columns
    cells = [[(formats or {}).get(c, lambda v: "" if v is None else str(v))(r[c]) for c in head] for r in rows.limit(limit).collect()]
    width = [max(map(len, col)) for col in zip(head, *cells)]
    put = lambda c, v, w: v.ljust(w) if c in left or kinds[c] == "string" else v.rjust(w)
    return "\n".join("  ".join(put(c, v, w) for c, v, w in zip(head, line, width)).rstrip() for line in [head, *cells])


def confusion(scored: DataFrame) -> DataFrame:
    """One row of pairs(same boolean, n, total): mean likeness of equal and of different songs, and the share of the
    equal ones in all (tp, fp, score). n counts the originals."""
    one = scored.agg(F.sum(F.when(F.col("same"), F.col("value")).otherwise(0.0)).alias("diag"), F.sum("value").alias("tot"), F.countDistinct("song").cast("double").alias("n"))
    return one.select((F.col("diag") / F.col("n")).alias("tp"), F.try_divide(F.col("tot") - F.col("diag"), F.col("n") * F.col("n") - F.col("n")).alias("fp"), F.try_divide("diag", "tot").alias("score"))


def image_text(image: np.ndarray) -> str:
    """Rows of numbers, a frame a line."""
    return "\n".join(" ".join(f"{v:.5f}" for v in row) for row in image) + "\n"


#: Colours from low to high values (fixed values of the image export).
RAMP = ((0, 0, 0), (218, 38, 0), (221, 99, 0), (255, 253, 0), (255, 254, 83), (255, 255, 200), (255, 255, 255))


def image_png(image: np.ndarray) -> bytes:
    """A picture of an image, time to the right and pitch upward, coloured by value between its least and greatest."""
    grid = np.asarray(image, float).T[::-1]
    low, high = (grid.min(), grid.max()) if grid.size else (0.0, 0.0)
    at = (grid - low) / (high - low or 1) * (len(RAMP) - 1)
    ramp = np.array(RAMP, float)
    rgb = np.stack([np.interp(at, range(len(RAMP)), ramp[:, c]) for c in range(3)], axis=-1).astype(np.uint8)
    raw = b"".join(b"\x00" + row.tobytes() for row in rgb)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
