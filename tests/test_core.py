"""Golden values of single operators and equality with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import literal, scores
from sonolith.operators import dedupe, signal, similarity
from sonolith.schema import FIELDS
from sonolith.sources import files
from sonolith.streaming import ingest

COLS = "soid long, songlen long, bit_rate long, num_errors long, r32 array<long>, dom16 array<long>, cprint array<long>"


def words(rng, n, bits=32):
    return [int(x) for x in rng.integers(0, 2**bits, n)]


def some_prints(n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        length = int(rng.choice([0, 3, 20, 36, 60, 300]))
        rows.append([i, int(rng.integers(90, 130)), 128, i % 3, words(rng, 87), words(rng, 33, 16), words(rng, length)])
        if i % 3 == 2:
            twin = rows[-2]
            c = list(twin[6])
            for k in rng.choice(len(c), int(len(c) * rng.choice([0.05, 0.13, 0.16])), replace=False) if c else []:
                c[int(k)] ^= 1 << int(rng.integers(32))
            rows[-1][1], rows[-1][4], rows[-1][5], rows[-1][6] = twin[1] + int(rng.integers(0, 9)), list(twin[4]), list(twin[5]), c
    return [tuple(r) for r in rows]


def low(x):
    return x & -x


def brute_cp(a, b):
    n = min(len(a), len(b))
    return sum(low(x) == low(y) for x, y in zip(a, b)) / max(len(a), len(b)) if n else 0.0


def brute_fm(a, b):
    r = sum((0, 1, 4, 9)[(x ^ y) >> s & 3] for x, y in zip(a[4], b[4]) for s in range(0, 32, 2))
    d = sum((x ^ y).bit_count() for x, y in zip(a[5], b[5]))
    return min(max(2 * ((1 - (r + d) / 25584) - 0.5), 0), 1)


def brute_score(a, b):
    if 10 * abs(a[1] - b[1]) > min(a[1], b[1]):
        return 0.0
    c, f = brute_cp(a[6], b[6]), brute_fm(a, b)
    return (0.012985 + 0.263439 * f - 0.683234 * c + 1.592623 * c**3 + 0.06348) / 1.2489


@pytest.fixture(scope="module")
def fp(spark):
    return spark.createDataFrame(some_prints(), COLS)


def one(spark, expr):
    return spark.sql(f"SELECT {expr} AS x").head()["x"]


def test_blend_of_known_shares(spark):
    for c, f, want in ((1, 1, 1.0003146769), (0, 0, 0.0612258788), (1, 0, 0.7893778526), (0, 1, 0.2721627032)):
        assert abs(one(spark, scores.polynomial(f"{c}D", f"{f}D")) - want) < 1e-9


def test_small_scores(spark):
    assert abs(one(spark, scores.cp("array(12L, 2147483648L, 0L, 7L)", "array(4L, 2147483648L, 0L)")) - 0.75) < 1e-12
    assert one(spark, scores.cp("CAST(array() AS ARRAY<BIGINT>)", "array(4L)")) == 0
    assert one(spark, scores.merged("array(1L, 2L)", "array(4L)")) == [5, 2]
    assert one(spark, scores.gate("100", "110")) and not one(spark, scores.gate("100", "111")) and one(spark, scores.gate("0", "0"))
    assert np.isnan(one(spark, scores.pearson("array(1L, 1L)", "array(1L, 2L)")))
    assert abs(one(spark, scores.pearson("array(1L, 2L, 4L)", "array(4294967295L, 4294967294L, 4294967292L)")) - 1) < 1e-9


def test_scores_equal_brute_force(spark, fp):
    rows = some_prints()
    pairs = fp.select(F.col("soid").alias("a"), F.struct(*FIELDS).alias("fa")).crossJoin(fp.select(F.col("soid").alias("b"), F.struct(*FIELDS).alias("fb"))).where("a % 7 = 0")
    scores.register(spark)
    for r in pairs.selectExpr("a", "b", "fprint_cmp(fa, fb) AS s", "fprint_match(fa, fb) AS m", f"{scores.tanimoto('fa.cprint', 'fb.cprint')} AS t", f"{scores.contained('fa', 'fb')} AS u").collect():
        a, b = rows[r["a"]], rows[r["b"]]
        assert abs(r["s"] - brute_score(a, b)) < 1e-12 and r["m"] == (brute_score(a, b) > 0.6)
        both = list(zip(a[6], b[6]))
        either = sum((x | y).bit_count() for x, y in both)
        assert abs(r["t"] - (0 if not both else sum((x & y).bit_count() for x, y in both) / either)) < 1e-12
        assert 0 <= r["u"] <= 1
    assert spark.sql("SELECT fprint_cmp(NULL, NULL) IS NULL AS x").head()["x"]


def test_similarity_join_loses_nothing(fp):
    rows = some_prints()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and brute_score(a, b) > 0.6}
    got = {(r["a"], r["b"]) for r in similarity.similarity_join(fp).collect()}
    assert got == want and len(want) > 3
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and brute_score(a, b) and brute_cp(a[6], b[6]) > 0.72 and brute_fm(a, b) > 0.72}
    assert {(r["a"], r["b"]) for r in similarity.all_pairs_results(fp).collect()} == want
    plan = similarity.similarity_join(fp)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_key_plans_hold():
    """However differences fall, a group keeps enough equal bands: checked against the worst case for every length."""
    for share in (0.72, 0.854347911716833, 0.95):
        tiers = similarity.ladder(share)
        assert tiers and [k.positions for k in tiers] == sorted({k.positions for k in tiers})
        for k in tiers:
            for n in range(k.least, 3000):
                most = next(m for m in range(int((1 - share) * n) + 1, -1, -1) if n - m > share * n)  # differences of a match
                assert most < (k.group - k.take + 1) * (n // (k.width * k.group)), (share, k, n)


def test_probe_and_second_hop(fp):
    rows = some_prints()
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and brute_score(a, b) > 0.6}
    asked = fp.where("soid % 4 = 0")
    got = similarity.probe(fp, asked).collect()
    assert {(r["soid"], r["match"]) for r in got} == {(a, b) for a, b in near if a % 4 == 0} and got
    assert [(r["soid"], -r["score"]) for r in got] == sorted((r["soid"], -r["score"]) for r in got)
    hops = {(o, a, b) for o, a in near if o % 4 == 0 for x, b in near if x == a and b != o}
    assert {(r["origin"], r["soid"], r["match"]) for r in similarity.second_hop(fp, asked).collect()} == hops


def test_literal_round_trip(spark, fp):
    whole = fp.select(F.struct(*FIELDS).alias("fp")).withColumn("t", F.expr(literal.text_of("fp"))).selectExpr("t", f"fp = {literal.parsed('t')} AS same").collect()
    assert all(r["same"] for r in whole)
    good = whole[5]["t"]
    for bad in (good[:-1], good + "x", good.replace(",", ";", 1), good.replace(",", ", ", 1), "(1,2,3,,,)"):
        with pytest.raises(Exception, match="not a fingerprint"):
            spark.createDataFrame([(bad,)], "t string").selectExpr(f"{literal.parsed('t')} AS x").collect()


def test_overreach(spark):
    rng = np.random.default_rng(2)
    some = {(a, b): round(float(s), 3) for (a, b), s in zip([(a, b) for a in range(12) for b in range(a + 1, 12) if (a * b) % 3], rng.uniform(0.6, 0.7, 66))}
    for given in ({(1, 2): 0.7, (2, 3): 0.9, (1, 4): 0.8}, some):
        both = {**given, **{(b, a): s for (a, b), s in given.items()}}
        want = {(a, m) for (a, m), s in both.items() if not any(x == m and e != a and s2 > 1.05 * s for (x, e), s2 in both.items())}
        links = spark.createDataFrame([(a, b, s) for (a, b), s in given.items()], "a long, b long, score double")
        assert {(r["a"], r["m"]) for r in similarity.without_overreach(links).collect()} == want


def test_quantiser_and_gray(spark):
    rows = [(-0.1, 0), (0.0, 1), (0.03, 1), (0.1, 2), (0.13, 2), (0.3, 3), (0.33, 3), (1000.0, 3)]
    df = spark.createDataFrame(rows, "v double, want int").select(signal.quantise(F.col("v"), 0.0, 0.1, 0.3).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    assert one(spark, signal.pack_gray("array(0, 2, 3)")) == (0 * 16 + 3 * 4 + 2)


def test_notes_and_norm(spark):
    assert [one(spark, signal.note_of(str(b), 1000, 256)) for b in (113, 112, 64)] == [0, 11, 2]
    assert np.allclose(one(spark, signal.normalised("array(0D, 0.001D, 0.002D)")), 0)
    assert np.allclose(one(spark, signal.normalised("array(3D, 4D)")), [0.6, 0.8])


def test_fir_and_decimation(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate((0, 1, 2, 3))], "song int, frame int, v double")
    fir = lambda taps: [r["smooth"] for r in signal.fir(df, ["song"], "frame", "v", taps).orderBy("frame").collect()]
    assert fir((0.5, 0.5)) == [0.5, 1.5, 2.5] and fir((0.5, 0.7, 0.5)) == pytest.approx([1.7, 3.4]) and fir((1.0, -1.0)) == [-1.0] * 3
    assert [r["mean"] for r in signal.decimate(df, ["song"], "frame", "v", 2).orderBy("block").collect()] == [0.5, 2.5]
    assert signal.decimate(df.where("frame < 3"), ["song"], "frame", "v", 2).count() == 1


def brute_code(words):
    """Fields of the compressed form, one bit string each."""
    steps, last = [], 0
    for w in words:
        places = [p for p in range(1, 33) if (w ^ last) >> (p - 1) & 1]
        steps += [b - a for a, b in zip([0, *places], places)] + [0]
        last = w
    out = len(words).to_bytes(4, "big")
    for width, values in ((3, [min(v, 7) for v in steps]), (5, [v - 7 for v in steps if v >= 7])):
        bits = "".join(format(v, f"0{width}b")[::-1] for v in values)
        out += bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    return out


def test_compressor(spark):
    goldens = [([1], [1]), ([7], [73, 0]), ([64], [7, 0]), ([256], [7, 2]), ([1, 0], [65, 0]), ([1, 1], [1, 0])]
    rng = np.random.default_rng(3)
    more = [[], words(rng, 5), words(rng, 40), [4294967295, 0, 2147483648]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate([g for g, _ in goldens] + more)], "i int, w array<long>")
    got = {r["i"]: bytes(r["c"]) for r in rows.selectExpr("i", f"{signal.compressed('w')} AS c").collect()}
    for i, (given, want) in enumerate(goldens):
        assert list(got[i]) == [0, 0, 0, len(given), *want] and got[i] == brute_code(given)
    for i, given in enumerate(more):
        assert got[len(goldens) + i] == brute_code(given)


THIRTY = (435, 219, 891, 906, 184, 572, 301, 892, 875, 121, 245, 146, 640, 137, 938, 25, 668, 288, 848, 790, 141, 890, 528, 145, 289, 861, 339, 769, 293, 757)


@pytest.mark.parametrize("values, levels, want", [((1, 1.1, 1.2, 3, 3.1, 3.2), 2, [2.1]), ((1, 1.1, 1.2), 2, [1.075]), ((1, 1.1, 1.2), 3, [1.05, 1.15]), (THIRTY, 4, [214.77678, 451.5625, 729.04547])])
def test_lloyd(spark, values, levels, want):
    got = signal.lloyd(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", levels)
    assert got == pytest.approx(want, rel=1e-6)


def test_lloyd_of_nothing(spark):
    assert signal.lloyd(spark.createDataFrame([], "v double"), "v", 4) == []
    assert signal.lloyd(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 3) == [2.0, 2.0]


def test_election_and_dupes(spark):
    rows = spark.createDataFrame([(1, 1, 128, 0), (2, 1, 320, 1), (3, 1, 900, 5), (4, 2, 64, 9), (5, 2, 320, 3)], "soid long, grp int, bit_rate int, num_errors int")
    best = {r["grp"]: r["soid"] for r in dedupe.elect(rows, "grp").where("place = 1").collect()}
    assert best == {1: 2, 2: 5}
    assert {(r["oid"], r["dupe_of"]) for r in dedupe.dupe_table(rows, dedupe.elect(rows, "grp")).collect()} == {(1, 2), (3, 2), (4, 5)}
    scored = spark.createDataFrame([(1, 0.1)] * 4 + [(2, 0.1)] * 3 + [(3, 0.9)] * 5, "oid long, v double")
    assert [(r["oid"], r["values"]) for r in dedupe.suspects(scored, "oid", "v").collect()] == [(1, [0.1] * 4)]


def test_files(spark, tmp_path):
    for name in ("b.mp3", "a.flac", "c.txt"):
        (tmp_path / name).write_bytes(np.array([1, -2, 3], "<i2").tobytes())
    names = [r["name"] for r in files.find_files(spark, str(tmp_path), [r"\.mp3$", r"\.flac$"]).collect()]
    assert names == ["a.flac", "b.mp3"] and files.find_files(spark, str(tmp_path), ["."], limit=0).count() == 0
    assert files.newest_files(spark, str(tmp_path), ["."], 2).count() == 2
    assert {tuple(r["samples"]) for r in files.read_pcm(spark, str(tmp_path)).collect()} == {(1, -2, 3)}
    paths = spark.createDataFrame([("//host//a\\b",), ("a//b",)], "p string").select(files.normal_path(F.col("p")).alias("p"))
    assert [r["p"] for r in paths.collect()] == ["//host/a/b", "a/b"]


def test_dumps(spark, tmp_path):
    rows = spark.createDataFrame([("x", "y", None, 10, 128, "MP3", [1, 4294967295]), ("x", "z", "w", 10, 128, "OGG", [5])], "artist string, title string, album string, length int, bitrate int, format string, cprint array<long>")
    rows.select(files.dump_block().alias("value")).coalesce(1).write.text(str(tmp_path / "d"))
    got = files.read_dump(spark, str(tmp_path / "d")).collect()
    assert len(got) == 1 and got[0]["cprint"] == [1, 4294967295] and got[0]["title"] == "y" and got[0]["length"] == 10


def test_stream_ingest_is_idempotent(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    rows = [{"oid": o, "fpath": f"/m/{o}.mp3", "title": t, "artist": "a", "album": "b", "complete": 1, "fingerprinted": 0} for o, t in (("1", "x"), ("2", None), ("1", "x"), ("3", "y"))]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "oid string, fpath string, title string, artist string, album string, complete int, fingerprinted int"
    for k in (1, 2):
        ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(r["oid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]
