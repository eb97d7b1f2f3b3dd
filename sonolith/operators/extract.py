"""From audio files to fingerprint rows: one file a row, in Arrow batches, no shuffle."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bark, features

#: Seconds of a file that are fingerprinted, and the word counts of r and dom.
SECONDS, R_WORDS, DOM_WORDS = 60, 87, 33
ROWS = "path string, songlen long, bit_rate long, num_errors long, r32 array<long>, dom16 array<long>, cprint array<long>, avg_fit long, avg_dom long, problem string"


def decode_wav(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples int16 (n, channels), rate, decode errors) of a PCM WAV file of 8 to 32 bits; a cut-off file is read as
    far as it goes and counts one error."""
    with wave.open(io.BytesIO(content)) as f:
        channels, width, rate, n = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()
        raw = f.readframes(n)
    whole = len(raw) // (width * channels) * width * channels
    errors = int(whole < n * width * channels)
    raw = raw[:whole]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) << 8
    elif width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, 1:].copy().view("<i2").reshape(-1)
    else:
        x = np.frombuffer(raw, f"<i{width}")
        x = x if width == 2 else (x >> 16).astype(np.int16)
    return x.astype(np.int16).reshape(-1, channels), rate, errors


def decode_pcm(content: bytes, rate: int = 44100, channels: int = 1) -> tuple[np.ndarray, int, int]:
    """Headerless little-endian 16-bit samples."""
    step = 2 * channels
    return np.frombuffer(content[: len(content) // step * step], "<i2").reshape(-1, channels), rate, int(len(content) % step > 0)


def assembled(samples: np.ndarray, rate: int, errors: int, size: int) -> dict:
    """The fields of a print: whole seconds, kilobits a second (rounded up), errors, r, dom and cprint."""
    seconds = len(samples) / rate
    head = samples[: SECONDS * rate]
    mono = features.downmix(head)
    audible = bark.trimmed(head / 32767.0).mean(axis=1)
    found = bark.extract(features.resample(audible, rate, bark.RATE))
    r, dom, fit, harmonic = found or (bytes(4 * R_WORDS), bytes(2 * DOM_WORDS), 0, 0)
    return {
        "songlen": int(seconds), "bit_rate": math.ceil(size * 8 / seconds / 1000) if seconds else 0, "num_errors": errors,
        "r32": np.frombuffer(r, ">u4").astype(np.int64), "dom16": np.frombuffer(dom, ">u2").astype(np.int64), "cprint": features.cprint(mono, rate),
        "avg_fit": fit, "avg_dom": harmonic, "problem": None,
    }


def fingerprint_bytes(content: bytes, decode=decode_wav) -> dict:
    """The fields of one file; `problem` says why a file gives none."""
    try:
        samples, rate, errors = decode(content)
        return assembled(samples, rate, errors, len(content))
    except (wave.Error, EOFError, ValueError, struct.error) as e:
        return {"songlen": 0, "bit_rate": 0, "num_errors": 1, "r32": np.zeros(R_WORDS, np.int64), "dom16": np.zeros(DOM_WORDS, np.int64), "cprint": np.zeros(0, np.int64), "avg_fit": 0, "avg_dom": 0, "problem": str(e) or type(e).__name__}


def fingerprints(files: DataFrame, decode=decode_wav) -> DataFrame:
    """files(path, content) -> one print a file, in parallel; files that cannot be read keep a row with a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: the decoded samples of one song are held
                told = fingerprint_bytes(b.column(1)[k].as_py(), decode)
                arrays = [b.column(0).slice(k, 1)]
                for name in ("songlen", "bit_rate", "num_errors", "r32", "dom16", "cprint", "avg_fit", "avg_dom"):
                    v = told[name]
                    arrays.append(pa.array([v], pa.list_(pa.int64()) if isinstance(v, np.ndarray) else pa.int64()))
                arrays.append(pa.array([told["problem"]], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ROWS.split(", ")])

    return files.select("path", "content").mapInArrow(run, ROWS)


def fingerprint(spark: SparkSession, root: str, decode=decode_wav) -> DataFrame:
    """Prints of the audio files under a path."""
    return fingerprints(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), decode)


def empty_print(length: int = 0) -> str:
    """SQL: a print of zeros with `length` words."""
    words = lambda n: f"array_repeat(0L, {n})"
    return f"named_struct('songlen', 0L, 'bit_rate', 0L, 'num_errors', 0L, 'r32', {words(R_WORDS)}, 'dom16', {words(DOM_WORDS)}, 'cprint', {words(max(0, length))})"


# -- images split over tasks ----------------------------------------------------------------------------------------------

BLOCK = 4096


def sub_prints(images: DataFrame, classifiers=features.CLASSIFIERS, block: int = BLOCK) -> DataFrame:
    """images(song, frame from 0 without gaps, chroma) -> (song, frame, word).

    A song is cut into blocks of frames that repeat the first rows of the next one, so a long song is many tasks' work.
    """
    reach = max(c[3] for c in classifiers) - 1
    own = F.floor(F.col("frame") / block)
    before = F.floor((F.col("frame") - reach) / block)
    rows = images.select("song", "frame", "chroma", F.explode(F.array_distinct(F.array(F.greatest(before, F.lit(0)), own))).alias("block"))
    kind = dict(images.dtypes)["song"]

    def run(key, t):
        t = t.sort_by("frame")
        image = np.array(t.column("chroma").to_pylist(), float).reshape(t.num_rows, -1)
        words = features.sub_prints(image, classifiers)
        if len(words):
            first = t.column("frame").to_numpy()[: len(words)]
            keep = first // block == key[1].as_py()
            words, first = words[keep], first[keep]
        else:
            first = words
        return pa.table({"song": pa.array([key[0].as_py()] * len(words), t.schema.field("song").type), "frame": pa.array(first, pa.int64()), "word": pa.array(words, pa.int64())})

    return rows.groupBy("song", "block").applyInArrow(run, f"song {kind}, frame long, word long")


# -- tags -----------------------------------------------------------------------------------------------------------------

_FRAMES = {"TPE1": "artist", "TIT2": "title", "TALB": "album", "TLEN": "length"}


def read_tags(content: bytes) -> dict[str, str | None]:
    """artist, title, album and length (ms) of an ID3v2 head or, where there is none, an ID3v1 tail."""
    out: dict[str, str | None] = dict.fromkeys(_FRAMES.values())
    if content[:3] == b"ID3" and len(content) >= 10:
        seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        at, end = 10, 10 + seven(content[6:10])
        while at + 10 <= min(end, len(content)) and content[at : at + 4].isalnum():
            size = seven(content[at + 4 : at + 8]) if content[3] >= 4 else int.from_bytes(content[at + 4 : at + 8], "big")
            name, body = content[at : at + 4].decode("ascii"), content[at + 10 : at + 10 + size]
            if name in _FRAMES and body:
                code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
                out[_FRAMES[name]] = body[1:].decode(code, "replace").strip("\x00 ")
            at += 10 + size
    elif len(content) >= 128 and content[-128:-125] == b"TAG":
        part = lambda a, b: content[len(content) - 128 + a : len(content) - 128 + b].split(b"\x00")[0].decode("latin-1").strip() or None
        out["title"], out["artist"], out["album"] = part(3, 33), part(33, 63), part(63, 93)
    return out


def tags(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, artist, title, album, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_tags(x.as_py()) for x in b.column(1)]
            arrays = [pa.array([f[k] for f in found], pa.string()) for k in ("artist", "title", "album", "length")]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["path", "artist", "title", "album", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, artist string, title string, album string, length string")
