"""Secret scans: base patterns and a randomness test battery (operator 9).

Base spans are fixed patterns. The battery looks at every other long token, infers its encoding (the smallest known
alphabet that holds it), and tests it against a uniform random string of that alphabet: chi-squared uniformity of the
symbols, a Wald-Wolfowitz runs test about the alphabet's middle, and lag-one serial correlation. A token must pass all
three as random, and how unlikely ordinary text of its length would come as close to uniform gives its p-value: a
noncentral chi-squared tail, whose shift is how far the corpus's own frequencies of the alphabet's characters (counted
over all texts) are from uniform, times the length. P-values are kept as logarithms, without a floor. Benjamini-Hochberg
control within bands of length turns them into spans: counts of rounded ones are all that is gathered.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces

KINDS = ("assign", "access", "hex", "random")
MIN_GROUP, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
FALSE_SHARE = 0.01
RANDOM_P = 0.01
STEP = 0.25  # of -log10 p in the counts
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
#: Inferred encodings, smallest first.
ENCODINGS = (
    ("digits", string.digits), ("hex", string.digits + "abcdef"), ("HEX", string.digits + "ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"), ("lower36", string.digits + string.ascii_lowercase), ("upper36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/"), ("base64url", string.digits + string.ascii_uppercase + string.ascii_lowercase + "-_"),
)
_SETS = [(name, {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log10_lower(z: float) -> float:
    """log10 of the normal distribution function, also where it is far below the least double."""
    if z > -30:
        return math.log10(max(_upper_normal(-z), 1e-300))
    return (-0.5 * z * z - math.log(-z * math.sqrt(2 * math.pi)) + math.log1p(-1 / (z * z))) / math.log(10)


def _standard(x: float, df: float, shift: float) -> float:
    """The normal deviate of a noncentral chi-squared value, by Sankaran's cube-root form."""
    m, v = df + shift, df + 2 * shift
    h = 1 - 2 * m * (df + 3 * shift) / (3 * v * v)
    p, q = v / (m * m), (h - 1) * (1 - 3 * h)
    mean = 1 + h * p * (h - 1 - 0.5 * (2 - h) * q * p)
    return ((max(x, 0) / m) ** h - mean) / (h * math.sqrt(2 * p) * (1 + 0.5 * q * p))


def chi2_tail(x: float, df: float, shift: float = 0.0) -> float:
    """P(noncentral chi-squared > x)."""
    return _upper_normal(_standard(x, df, shift))


def text_log10p(x: float, symbols: int, length: int, spread: float) -> float:
    """log10 of how likely ordinary text is as close to uniform as chi-squared x tells. spread: symbols times the sum of
    squared shares of the corpus's characters, less 1; 0 (or no such characters) says that text looks random as well."""
    return log10_lower(_standard(x, symbols - 1, length * spread)) if spread > 0 else 0.0


def battery(token: str) -> tuple[int, float, float, float, float] | None:
    """(encoding, chi-squared of uniformity, and the p-values under randomness of uniformity, runs and serial correlation) of
    a token, or None for words and what no encoding holds."""
    seen = set(token)
    for code, (name, place) in enumerate(_SETS):
        if seen <= place.keys():
            break
    else:
        return None
    if name == "base32" and not seen & set("234567") or seen.isdisjoint(string.digits) and len(token) < 32:
        return None  # words
    v = np.array([place[c] for c in token], float)
    n, k = len(v), len(place)
    counts = np.bincount(v.astype(int), minlength=k)
    x = float(((counts - n / k) ** 2).sum() * k / n)
    up = v >= k / 2
    n1, n0 = int(up.sum()), int(n - up.sum())
    if n1 and n0:
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        runs = 1 + int((up[1:] != up[:-1]).sum())
        p_runs = 2 * _upper_normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p_runs = 0.0
    centred = v - v.mean()
    power = float((centred * centred).sum())
    rho = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _upper_normal(abs(rho + 1 / n) * math.sqrt(n))
    return code, x, chi2_tail(x, k - 1), min(1.0, p_runs), min(1.0, p_serial)


def spreads(letters: np.ndarray) -> list[float]:
    """For each encoding: symbols times the sum of squared shares of the corpus's characters (counts by byte), less 1."""
    out = []
    for _, alphabet in ENCODINGS:
        own = letters[[ord(c) for c in alphabet]].astype(float)
        share = own / own.sum() if own.sum() else own
        out.append(float(len(alphabet) * (share * share).sum() - 1) if own.sum() else 0.0)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, in code points."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_GROUP]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def band(length: int) -> int:
    """Bands of length: 20-31, 32-63, 64-127, ..."""
    return max(4, length.bit_length() - 1)


_TEST = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("encoding", pa.int32()), ("x", pa.float64()), ("random", pa.bool_())])
_TEST_SQL = "struct<start:int,end:int,length:int,encoding:int,x:double,random:boolean>"


def _tests(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The battery on every long token that no base span touches; tokens are read whole."""
    out = []
    for m in _TOKEN.finditer(text):
        if not any(s < m.end() and m.start() < e for s, _, e in spans):
            found = battery(m[0])
            if found:
                out.append({"start": m.start(), "end": m.end(), "length": len(m[0]), "encoding": found[0], "x": found[1], "random": min(found[2:]) >= RANDOM_P})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and tests of each text; the first row of every piece also counts the bytes of all its texts."""
    for b in pieces(batches):
        cols: list[list] = [[] for _ in range(6)]
        letters = np.zeros(256, np.int64)
        for t in b.column(1):
            text = t.as_py() or ""
            letters += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
            spans = base_spans(text)
            by = [sum(1 for s in spans if s[1] == k) for k in range(3)]
            base = told(spans)
            for x, v in zip(cols, (*by, hashlib.sha256(base.encode()).hexdigest(), base, _tests(text, spans))):
                x.append(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(_TEST)]
        counted = pa.array([letters.tolist()] + [None] * (b.num_rows - 1), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds)), counted], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tests", "letters"])


def _scored(tests: DataFrame, spread: list[float]) -> DataFrame:
    """tests(t) -> (t, band, score): -log10 p in steps; 0 for tokens that are not random."""
    sizes = [len(a) for _, a in ENCODINGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_pylist()
            score = [int(-text_log10p(r["x"], sizes[r["encoding"]], r["length"], spread[r["encoding"]]) / STEP) if r["random"] else 0 for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([band(r["length"]) for r in rows], pa.int32()), pa.array(score, pa.int32())], ["t", "band", "score"])

    return tests.mapInArrow(run, f"t {_TEST_SQL}, band int, score int")


def thresholds(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> dict[int, int]:
    """Benjamini-Hochberg within each band of length: the least score that is accepted (bands without one are left out)."""
    out = {}
    for b in {k[0] for k in counts}:
        scores = sorted(((s, n) for (x, s), n in counts.items() if x == b), reverse=True)
        whole, above = sum(n for _, n in scores), 0
        for s, n in scores:
            above += n
            if s > 0 and 10 ** (-s * STEP) <= share * above / whole:
                out[b] = s
    return out


def scan(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row; null text counts as empty.

    spans joins kind:start:end by start, then kind; the method's are of kind `random`. Repeated rows give repeated
    results (and count as often in the control of false discoveries). Other columns of docs are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, tests array<{_TEST_SQL}>, letters array<long>"
    rows = materialise(slim.mapInArrow(_scan, schema), "secrets")
    counts = rows.where("letters IS NOT NULL").select(F.posexplode("letters").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows
    letters = np.zeros(256, np.int64)
    for r in counts:
        letters[r["byte"]] = r["n"]
    spread = spreads(letters)
    each = _scored(rows.select(F.explode("tests").alias("t")), spread).groupBy("band", "score").agg(F.count("*").alias("n"))
    least = thresholds({(r["band"], r["score"]): r["n"] for r in each.collect()}, share)  # bands x distinct scores
    found = _accepted(rows.select("base", "tests", *[c for c in rows.columns if c not in ("base", "tests", "letters")]), spread, least)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def _accepted(rows: DataFrame, spread: list[float], least: dict[int, int]) -> DataFrame:
    """rows with spans (base ones and the tokens whose score reaches their band's least one) and n_random."""
    sizes = [len(a) for _, a in ENCODINGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, n = [], []
            for base, tests in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                good = [t for t in tests if t["random"] and band(t["length"]) in least and int(-text_log10p(t["x"], sizes[t["encoding"]], t["length"], spread[t["encoding"]]) / STEP) >= least[band(t["length"])]]
                n.append(len(good))
                if good:
                    old = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                    base = told(sorted(old + [(t["start"], 3, t["end"]) for t in good]))
                spans.append(base)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(spans, pa.string()), pa.array(n, pa.int64())], [*b.schema.names[2:], "spans", "n_random"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, f"{fields}, spans string, n_random long")
