"""Saved prints and results: tables as sources and sinks, and the binary form that other tools store."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..operators.dedupe import add_to_set
from ..schema import FIELDS

RESULTS = "cp double, fm double, sm double, nm string, oid1 string, oid2 string"
PRINT_ROW = "songlen long, bit_rate long, num_errors long, r32 array<long>, dom16 array<long>, cprint array<long>"


def to_blob(songlen: int, bit_rate: int, num_errors: int, r32, dom16, cprint) -> bytes:
    """Pickled form of a print: head of three unsigned words, r, dom and cprint, each as bytes, low ends first in cprint."""
    head = struct.pack("<3I", songlen, bit_rate & 0xFFFFFFFF, num_errors & 0xFFFFFFFF)
    return pickle.dumps((head, np.array(r32, ">u4").tobytes(), np.array(dom16, ">u2").tobytes(), np.array(cprint, "<u4").tobytes()), protocol=2)


class _Plain(pickle.Unpickler):
    """Only built-in containers and bytes; a blob cannot name code."""

    def find_class(self, module, name):
        if (module, name) == ("_codecs", "encode"):  # how protocol 2 writes bytes
            import codecs

            return codecs.encode
        raise pickle.UnpicklingError(f"{module}.{name} in a print")


def from_blob(blob: bytes) -> dict:
    import io

    head, r, dom, words = _Plain(io.BytesIO(blob)).load()
    songlen, bit_rate, errors = struct.unpack("<3I", head)
    return {"songlen": songlen, "bit_rate": bit_rate, "num_errors": errors, "r32": np.frombuffer(r, ">u4").astype(np.int64), "dom16": np.frombuffer(dom, ">u2").astype(np.int64), "cprint": np.frombuffer(words, "<u4").astype(np.int64)}


def blobs(prints: DataFrame, key: str = "oid") -> DataFrame:
    """prints(key, six fields) -> (key, fingerprint binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in FIELDS))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([to_blob(*r) for r in rows], pa.binary())], [key, "fingerprint"])

    return prints.select(key, *FIELDS).mapInArrow(run, f"{key} {dict(prints.dtypes)[key]}, fingerprint binary")


def unblobbed(rows: DataFrame, key: str = "oid", column: str = "fingerprint") -> DataFrame:
    """(key, six fields) of stored binary prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [from_blob(x.as_py()) for x in b.column(1)]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([t[f] for t in told], k) for f, k in zip(FIELDS, kinds)]], [key, *FIELDS])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {PRINT_ROW}")


def read_saved(spark: SparkSession, path: str | None = None, url: str | None = None, name: str = "fingerprints", **options) -> DataFrame:
    """Saved prints: Parquet files, or a table behind a JDBC url (split over tasks by the options partitionColumn, lowerBound,
    upperBound and numPartitions)."""
    return spark.read.parquet(path) if url is None else spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def append_prints(prints: DataFrame, target: str) -> None:
    """All rows of prints, in one write, sorted by song length so that searches skip row groups."""
    prints.sortWithinPartitions("songlen").write.mode("append").parquet(target)


def append_results(rows: DataFrame, target: str) -> None:
    """Result pairs (cp, fm, sm, nm, oid1, oid2); rows with a null are dropped, as the table allows none."""
    names = [f.split()[0] for f in RESULTS.split(", ")]
    rows.select(*names).dropna(subset=names).write.mode("append").parquet(target)


def flagged(documents: DataFrame, done: DataFrame, key: str = "oid") -> DataFrame:
    """documents with fingerprinted = 1 where done(key) says so."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(1))
    return documents.join(marks, key, "left").withColumn("fingerprinted", F.coalesce("_done", "fingerprinted")).drop("_done")


def with_dupes(documents: DataFrame, dupes: DataFrame, best: DataFrame) -> DataFrame:
    """documents with dupe_of grown by what is new and best_of set for the elected ones."""
    grown = add_to_set(documents, "dupe_of", dupes)
    set_ = best.select("oid", F.col("best_of").alias("_best"))
    return grown.join(set_, "oid", "left").withColumn("best_of", F.coalesce("_best", "best_of")).drop("_best")


def with_properties(files: DataFrame, properties: DataFrame, key: str = "fn") -> DataFrame:
    """files with encoding, sample rate, bit rate and channels from properties; files that it does not know stay as they are."""
    names = [c for c in ("enc", "sample_rate", "bitrate", "channels") if c in properties.columns]
    new = properties.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    out = files.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) if c in files.columns else F.col(f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


# -- table function and data source ---------------------------------------------------------------------------------------


@udtf(returnType="artist string, title string, album string, length long, bitrate long, format string, cprint array<long>")
class ParseDump:
    """One row for each block of a dump: KEY=value lines, blocks set apart by blank lines; MP3 only."""

    def eval(self, text: str):
        for block in (text or "").split("\n\n"):
            told = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
            if told.get("FORMAT", "").upper() != "MP3" or "FINGERPRINT" not in told:
                continue
            number = lambda k: int(told[k]) if told.get(k, "").isdigit() else None
            words = [int(w, 16) for w in told["FINGERPRINT"].replace(",", " ").split()]
            yield told.get("ARTIST"), told.get("TITLE"), told.get("ALBUM"), number("LENGTH"), number("BITRATE"), told.get("FORMAT"), words


class PcmSource(DataSource):
    """spark.read.format("pcm").load(folder): rows of `chunk` samples of headerless 16-bit files, split over tasks by chunk.

    Files are opened with Hadoop-free reads of a mounted folder; use `files.read_pcm` for stores that only Spark reaches.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "path string, chunk long, samples array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _PcmReader(self.options["path"], int(self.options.get("chunk", 1 << 20)))


class _PcmReader(DataSourceReader):
    def __init__(self, root: str, chunk: int):
        self.root, self.chunk = root, chunk

    def partitions(self) -> list[InputPartition]:
        import os

        root = self.root.removeprefix("file:")
        names = [root] if os.path.isfile(root) else sorted(os.path.join(d, f) for d, _, found in os.walk(root) for f in found if not f.startswith((".", "_")))
        return [InputPartition((n, k)) for n in names for k in range(-(-(os.path.getsize(n) // 2) // self.chunk))]

    def read(self, partition: InputPartition):
        name, k = partition.value
        with open(name, "rb") as f:
            f.seek(2 * k * self.chunk)
            raw = f.read(2 * self.chunk)
        yield name, k, np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").tolist()
