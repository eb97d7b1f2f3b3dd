"""Command line: python -m sonolith.cli generate|collect|chromagram|resample|match|dedupe|report ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import dedupe, extract, features, report, similarity
from .sources import files, tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("sonolith").getOrCreate()


def _audio(spark: SparkSession, root: str):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def generate(a) -> None:
    """Prints of the WAV files under a folder, appended to a table by path."""
    prints = extract.fingerprint(_session(), a.root).withColumn("soid", F.xxhash64("path"))
    tables.append_prints(prints, a.out)


def collect(a) -> None:
    """Dump blocks of the files under a folder: tags and prints."""
    audio = _audio(_session(), a.root)
    rows = extract.fingerprints(audio).join(extract.tags(audio).drop("length"), "path")
    ending = F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows.where("problem IS NULL").select("artist", "title", "album", F.col("songlen").alias("length"), F.col("bit_rate").alias("bitrate"), ending.alias("format"), "cprint").select(files.dump_block().alias("value")).write.text(a.out)


def chromagram(a) -> None:
    """Image of one file, as a picture or as text."""
    samples, rate, _ = extract.decode_wav(Path(a.file).read_bytes())
    image = features.chroma(features.resample(features.downmix(samples), rate))
    out = Path(a.out)
    out.write_bytes(report.image_png(image)) if out.suffix == ".png" else out.write_text(report.image_text(image))


def resample(a) -> None:
    """Mono 16-bit samples of one file at another rate, without a head."""
    samples, rate, _ = extract.decode_wav(Path(a.file).read_bytes())
    Path(a.out).write_bytes(features.resample(features.downmix(samples), rate, a.rate).round().clip(-32768, 32767).astype("<i2").tobytes())


def match(a) -> None:
    """All results among stored prints."""
    rows = similarity.all_pairs_results(_session().read.parquet(a.prints))
    rows.select("cp", "fm", F.lit(0.0).alias("sm"), F.lit("").alias("nm"), F.col("a").cast("string").alias("oid1"), F.col("b").cast("string").alias("oid2")).write.mode("append").parquet(a.out)


def dupes(a) -> None:
    """Duplicates among results, from the songs' metadata."""
    spark = _session()
    _, found, _ = dedupe.dedupe(spark.read.parquet(a.results).select("oid1", "oid2", "sm"), spark.read.parquet(a.songs))
    found.write.parquet(a.out)


def compare(a) -> None:
    """The sixteen-column report of a table of variants."""
    report.write_report(report.comparison(_session().read.parquet(a.songs)), a.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sonolith")
    sub = p.add_subparsers(required=True)
    for name, run, args in (
        ("generate", generate, ("root", "out")), ("collect", collect, ("root", "out")), ("chromagram", chromagram, ("file", "out")), ("resample", resample, ("file", "out")),
        ("match", match, ("prints", "out")), ("dedupe", dupes, ("results", "songs", "out")), ("report", compare, ("songs", "out")),
    ):
        one = sub.add_parser(name, help=run.__doc__)
        for x in args:
            one.add_argument(x)
        if name == "resample":
            one.add_argument("--rate", type=int, default=features.RATE)
        one.set_defaults(run=run)
    a = p.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main(sys.argv[1:])
