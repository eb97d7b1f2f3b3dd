"""Sources: file listings, raw PCM, fingerprint dumps; sinks: dumps and tab-separated reports."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, runs collapsed; the double slash of a network share stays."""
    slashed = F.regexp_replace(path, r"\\", "/")
    return F.concat(F.when(slashed.rlike("^//[^/]"), "/").otherwise(""), F.regexp_replace(slashed, "/+", "/"))


def local_path(path: str) -> str:
    """A path of this machine with ~, variables and links resolved."""
    return os.path.realpath(os.path.expandvars(os.path.expanduser(path)))


def joined(*parts: str) -> str:
    """Parts of a path joined by single slashes; an absolute part starts anew."""
    return posixpath.join(*[p.replace("\\", "/") for p in parts])


def whole(pattern: str) -> str:
    """A pattern that must match all of a name, where patterns are otherwise searched for."""
    return f"^(?:{pattern})$"


def _matcher(patterns: list, name: Column) -> Column:
    """Any of the patterns: regular expressions, compiled ones, or functions from a column to a condition."""
    texts = [p if isinstance(p, str) else ("(?i)" if p.flags & 2 else "") + p.pattern for p in patterns if not callable(p)]
    found = name.rlike("|".join(f"(?:{p})" for p in texts)) if texts else F.lit(False)
    for p in patterns:
        if callable(p):
            found = found | p(name)
    return found


def listing(paths: DataFrame, patterns: list, column: str = "path", limit: int = -1, descending: bool = False, exclude: list | None = None, max_depth: int = -1, top: str = "") -> DataFrame:
    """Paths whose base name fits any of the patterns, by base name, with their folder's depth below the folder `top`.

    Whatever lies under a folder that fits a pattern of exclude is left out, as are paths below max_depth folders (< 0: no
    bound); limit < 0: all, 0: none.
    """
    parts = F.split(normal_path(F.col(column)), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    above = len(top.rstrip("/").split("/")) if top else 0
    kept = paths.withColumns({"name": F.element_at(parts, -1), "depth": F.size(parts) - 1 - above})
    kept = kept.where(_matcher(patterns, F.col("name")))
    if exclude:
        kept = kept.where(~F.exists(F.slice(dirs, above + 1, F.greatest(F.lit(0), F.size(dirs) - above)), lambda d: _matcher(exclude, d)))
    if max_depth >= 0:
        kept = kept.where(F.col("depth") <= max_depth)
    kept = kept.orderBy(F.col("name").desc() if descending else F.col("name").asc(), column)
    return kept if limit < 0 else kept.limit(limit)


def by_folder(listed: DataFrame, column: str = "path") -> DataFrame:
    """(dir, names): the hierarchy of a listing, one row a folder."""
    folder = F.regexp_replace(F.col(column), r"/?[^/]*$", "").alias("dir")
    return listed.groupBy(folder).agg(F.sort_array(F.collect_list("name")).alias("names"))


def find_files(spark: SparkSession, root: str, patterns: list, limit: int = -1, **options) -> DataFrame:
    """(path, modificationTime, length, name, depth) under root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return listing(files.select("path", "modificationTime", "length"), patterns, limit=limit, top=re.sub("/+", "/", top), **options)


def newest_files(spark: SparkSession, root: str, patterns: list, limit: int = -1, descending: bool = True, **options) -> DataFrame:
    """Files by time of modification, the newest first unless asked otherwise."""
    time = F.col("modificationTime")
    out = find_files(spark, root, patterns, **options).orderBy(time.desc() if descending else time.asc(), "path")
    return out if limit < 0 else out.limit(limit)


def read_pcm(spark: SparkSession, root: str) -> DataFrame:
    """(path, samples array<int>) of headerless little-endian 16-bit files."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            samples = [np.frombuffer(x.as_py()[: len(x.as_py()) // 2 * 2], "<i2").astype("int32") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(samples, pa.list_(pa.int32()))], ["path", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, "path string, samples array<int>")


def parse_dump(blocks: DataFrame, column: str = "value") -> DataFrame:
    """KEY=value blocks -> artist, title, album, length, bitrate, format, cprint; MP3 only."""
    field = lambda k: F.regexp_extract(column, rf"(?m)^{k}=(.*)$", 1)
    words = F.expr(f"transform(filter(split(regexp_extract({column}, '(?m)^FINGERPRINT=(.*)$', 1), '[ ,]+'), x -> x <> ''), x -> CAST(conv(x, 16, 10) AS BIGINT))")
    out = blocks.where(F.col(column).contains("FINGERPRINT=")).select(
        *[field(k).alias(k.lower()) for k in ("ARTIST", "TITLE", "ALBUM")], F.expr(f"try_cast(regexp_extract({column}, '(?m)^LENGTH=(.*)$', 1) AS BIGINT)").alias("length"),
        F.expr(f"try_cast(regexp_extract({column}, '(?m)^BITRATE=(.*)$', 1) AS BIGINT)").alias("bitrate"), field("FORMAT").alias("format"), words.alias("cprint"),
    )
    return out.where(F.upper("format") == "MP3")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_dump(spark.read.option("lineSep", "\n\n").text(path))


def dump_block() -> Column:
    """One dump block from artist, title, album, length, bitrate, format and cprint."""
    keys = [F.concat(F.lit(k + "="), F.coalesce(F.col(k.lower()).cast("string"), F.lit(""))) for k in ("ARTIST", "TITLE", "ALBUM", "LENGTH", "BITRATE", "FORMAT")]
    words = F.concat(F.lit("FINGERPRINT="), F.array_join(F.transform("cprint", lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), " "))
    return F.concat_ws("\n", *keys, words, F.lit(""))
