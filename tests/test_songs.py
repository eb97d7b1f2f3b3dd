"""Names, groups and deduplication of songs; stored prints; index rules; streams of samples; the command line."""

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import cli, storage
from sonolith.functions import names, scores, unions
from sonolith.operators import dedupe, index, report
from sonolith.sources import files, tables
from sonolith.streaming import windows

PRINT = "soid long, songlen long, bit_rate long, num_errors long, r32 array<long>, dom16 array<long>, cprint array<long>"


def some_prints(n, seed=0, length=20):
    rng = np.random.default_rng(seed)
    draw = lambda k, b: [int(x) for x in rng.integers(0, 2**b, k)]
    return [(i, int(rng.integers(50, 200)), 128, i % 3, draw(87, 32), draw(33, 16), draw(length + i % 4, 32)) for i in range(n)]


def test_names(spark):
    df = spark.createDataFrame([("The  Band", "A song - Live", "Greatest hits (Clean Edit)"), ("b", "live in paris", "cd [bonus disc 2]")], "artist string, title string, album string")
    got = df.select(names.name_key(F.col("artist"), F.col("title")).alias("k"), names.is_live(F.col("title")).alias("l"), names.clean_remark(F.col("album")).alias("c"), names.disc(F.col("album")).alias("d")).collect()
    assert [r["k"] for r in got] == ["thebandasong-live", "bliveinparis"] and [r["l"] for r in got] == [True, True]
    assert not got[0]["c"]["clean"] and got[1]["c"]["remark"] == "" and got[1]["d"] == "disc 2"  # remarks are told from lower-case albums
    low = df.select(names.clean_remark(F.lower("album")).alias("c")).collect()
    assert low[0]["c"]["clean"] and low[0]["c"]["remark"] == "clean edit"
    pairs = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string").select(names.ratio("a", "b").alias("r"))
    assert [r["r"] for r in pairs.collect()] == [0.75, 1.0, None]


def songs_table(n, seed):
    rng = np.random.default_rng(seed)
    albums = ["hits", "hits (clean edit)", "hits live", "other things", "hits [bonus cd2]", "more hits"]
    titles = ["song", "song live", "song (clean edit)", "tune"]
    rows = [(i, [str(rng.choice(list("abc")))], str(rng.choice(albums)), str(rng.choice(titles)), int(rng.choice([64, 128, 320])), int(rng.integers(0, 4))) for i in range(n)]
    pairs = {(a, b): float(rng.choice([1.0, 0.9, 0.5])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25}
    return rows, pairs


def brute_dedupe(rows, pairs):
    """The rules one song after the other."""
    song = {r[0]: r for r in rows}
    near = {}
    for (a, b), sm in pairs.items():
        near.setdefault(a, {})[b] = sm
        near.setdefault(b, {})[a] = sm
    join = lambda t: "".join(re.sub(r"\s+", "", t))
    remark = lambda t: re.search(names.REMARK, t)
    clean = lambda t: (True, remark(t).group(2) or "") if remark(t) and "clean" in remark(t).group(1) else (False, "")
    live = lambda t: bool(re.search(names.LIVE, t))

    def same(x, y, sm):
        _, ar1, al1, ti1 = x[:4]
        _, ar2, al2, ti2 = y[:4]
        if al1 != al2:
            like = [difflib.SequenceMatcher(None, join(al1), join(t)).ratio() for t in (al2, re.sub(names.REMARK, "", al2))]
            if max(like) < 0.5:
                return False
        if sm == 1:
            return True
        return live(al1) == live(al2) and live(ti1) == live(ti2) and clean(al1) == clean(al2) and clean(ti1) == clean(ti2) and bool(set(ar1) & set(ar2)) and sm >= 0.8

    dupes, best_of, alone = {}, {}, []
    for s in sorted(near):
        if s in dupes:
            continue
        group = [song[s]] + [song[m] for m in sorted(near[s]) if same(song[s], song[m], near[s][m])]
        if len(group) == 1:
            alone.append(s)
            continue
        fine = [g for g in group if g[5] <= 1]
        best = max(fine, key=lambda g: (g[4], -g[5])) if fine else max(group, key=lambda g: (-g[5], g[4]))
        for g in group:
            if g[0] != best[0]:
                dupes.setdefault(g[0], set()).add(best[0])
                best_of.setdefault(best[0], set()).add(g[0])
    return alone, dupes, best_of


@pytest.mark.parametrize("n, seed", [(12, 1), (25, 2)])
def test_dedupe(spark, n, seed):
    rows, pairs = songs_table(n, seed)
    songs = spark.createDataFrame(rows, "oid long, artists array<string>, album string, title string, bit_rate long, num_errors long")
    links = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "oid1 long, oid2 long, sm double")
    alone, dupes, best = dedupe.dedupe(links, songs)
    want = brute_dedupe(rows, pairs)
    assert sorted(r["oid"] for r in alone.collect()) == want[0]
    assert {r["oid"]: set(r["dupe_of"]) for r in dupes.collect()} == want[1] and want[1]
    assert {r["oid"]: set(r["best_of"]) for r in best.collect()} == want[2]


def test_graph_and_sets(spark):
    rows = spark.createDataFrame([(2, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (3, 4, 0.0, 0.0)], "oid1 long, oid2 long, cp double, fm double")
    assert {(r["oid1"], r["oid2"]): round(r["weight"], 6) for r in dedupe.graph(rows, scores.polynomial).collect()} == {(1, 2): 1.000315, (3, 4): 0.061226}
    docs = spark.createDataFrame([("a", ["x"], None, 0), ("b", None, ["q"], 0)], "oid string, dupe_of array<string>, best_of array<string>, fingerprinted int")
    dupes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "oid string, dupe_of array<string>")
    best = spark.createDataFrame([("a", ["b"])], "oid string, best_of array<string>")
    got = {r["oid"]: (r["dupe_of"], r["best_of"]) for r in tables.with_dupes(docs, dupes, best).collect()}
    assert got == {"a": (["x", "y"], ["b"]), "b": (["z"], ["q"])}
    assert {r["oid"]: r["fingerprinted"] for r in tables.flagged(docs, docs.where("oid = 'a'")).collect()} == {"a": 1, "b": 0}
    props = spark.createDataFrame([("f", ".mp3", 44100)], "fn string, enc string, sample_rate int")
    assert tables.with_properties(spark.createDataFrame([("f",), ("g",)], "fn string"), props).orderBy("fn").collect()[0]["sample_rate"] == 44100


def test_report(spark, tmp_path):
    names_ = ["/m/a/Song.mp3", "/m/a/Song_44100_s_128_-50_.mp3", "/m/a/Song_22050_s_64_vbr_-50_.FLAC", "/m/b/Song.flac", "/m/a/note.txt"]
    grouped = report.grouped(spark.createDataFrame([(n,) for n in names_], "path string"))
    assert {(r["dir"], r["base"], r["is_base"]) for r in grouped.collect()} == {("/m/a", "Song", True), ("/m/a", "Song", False), ("/m/b", "Song", True)} and grouped.count() == 4
    fp = [r[4:] for r in some_prints(4)]
    rows = [("/m/a", "Song", n, "x", "t", None if i else ".mp3", 128 if i else None, None, None, *fp[i]) for i, n in enumerate(names_[:3])] + [("/m/b", "Song", names_[3], "x", "t", ".flac", 1, 1, 1, *fp[3])]
    schema = "dir string, base string, fn string, artist string, title string, enc string, bit_rate long, sample_rate long, channels long, r32 array<long>, dom16 array<long>, cprint array<long>"
    out = report.comparison(spark.createDataFrame(rows, schema)).orderBy("fn1", "fn2").collect()
    assert len(out) == 3 and out[0]["br1"] == 320 and out[0]["fq1"] == 44100 and out[0]["cn2"] == 2
    assert {(r["is_vbr1"], r["vol_change1"], r["is_vbr2"], r["vol_change2"]) for r in out} == {(0, 0, 1, -50), (0, 0, 0, -50), (1, -50, 0, -50)}
    report.write_report(report.comparison(spark.createDataFrame(rows, schema)).coalesce(1), str(tmp_path / "r"))
    (name,) = (tmp_path / "r").glob("part*")
    lines = name.read_text().splitlines()
    assert lines[0].split("\t") == list(report.COLUMNS) and len(lines) == 4 and lines[1].split("\t")[2] == "mp3"
    text = report.text_table(spark.createDataFrame([("a", 1), ("bcd", 20)], "name string, n int").orderBy("n"))
    assert text == "name   n\na      1\nbcd   20"
    assert {r["song"] for r in report.paired_names(spark.createDataFrame([("/x/a-1.mp3",), ("a-2.mp3",), ("b.mp3",)], "path string")).collect()} == {"a", "b.mp3"}


def test_unions(spark):
    rows = some_prints(9, 3)
    df = spark.createDataFrame(rows, PRINT).withColumn("g", F.col("soid") % 2)
    got = {r["g"]: r["u"] for r in unions.folded(df, "g").collect()}
    for g, u in got.items():
        own = [r for r in rows if r[0] % 2 == g]
        for k, part in ((4, "r32"), (5, "dom16"), (6, "cprint")):
            n = max(len(r[k]) for r in own)
            want = [0] * n
            for r in own:
                for i, w in enumerate(r[k]):
                    want[i] |= w
            assert u[part] == want
        assert (u["min_songlen"], u["max_songlen"]) == (min(r[1] for r in own), max(r[1] for r in own))
    pairs = unions.folded(df, "g").alias("x").join(unions.folded(df, "g").alias("y"), F.expr("x.g <> y.g")).selectExpr("x.u AS u1", "y.u AS u2").crossJoin(df.where("soid = 4").select(F.struct("songlen", "r32", "dom16", "cprint").alias("a")))
    one = pairs.selectExpr(f"{unions.against('u1', 'u2')} AS s", f"{unions.what_if('u1', 'u2', 'a')} AS w", f"{scores.contained('u1', 'u1')} AS whole", f"{scores.contained('a', unions.of_two('a', 'a'))} AS own").collect()
    assert all(r["whole"] == pytest.approx(1) and r["own"] == pytest.approx(1) and r["w"] >= r["s"] for r in one)
    apart = spark.sql("SELECT named_struct('min_songlen', 1L, 'max_songlen', 2L, 'r32', array(1L), 'dom16', array(1L), 'cprint', array(1L)) AS a, named_struct('min_songlen', 3L, 'max_songlen', 4L, 'r32', array(1L), 'dom16', array(1L), 'cprint', array(1L)) AS b")
    assert apart.selectExpr(f"{unions.against('a', 'b')} AS s").head()["s"] == 0


def test_index_rules(spark):
    cases = {(160, 100, 200, 0.11): True, (160, 100, 200, 0.1): False, (43, 40, 50, 0.04): True, (47, 40, 50, 0.04): False, (20, 90, 100, 0.09): True, (20, 101, 110, 0.09): False, (100, 104, 110, 0.09): True, (100, 109, 120, 0.09): False, (154, 150, 152, 0.1): False, (154, 150, 152, 0.16): True, (155, 156, 160, 0.9): False}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "q long, lo long, hi long, share double, want boolean")
    assert all(r["got"] == r["want"] for r in df.selectExpr(f"{index.descend('q', 'lo', 'hi', 'share')} AS got", "want").collect())
    prints = spark.createDataFrame(some_prints(20, 5), PRINT)
    placed = index.blocks(prints, 6)
    assert placed.count() == 20 and placed.select("block").distinct().count() == 3
    ranges = placed.groupBy("block").agg(F.min("songlen").alias("lo"), F.max("songlen").alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(ranges, ranges[1:])) and index.nodes(placed).count() == 3
    own = prints.select(F.struct("songlen", "r32", "dom16", "cprint").alias("a")).selectExpr("a", f"{unions.of_two('a', 'a')} AS u")
    assert all(r["p"] == pytest.approx(0, abs=1e-9) for r in own.selectExpr(f"{index.penalty('u', 'a')} AS p").collect())
    assert own.selectExpr(f"{index.penalty('IF(false, u, NULL)', 'a')} AS p").head()["p"] == 1e10
    sides = index.split(spark.createDataFrame([(1, i, s) for i, s in enumerate((10, 11, 50, 60))] + [(2, i, 7) for i in range(3)] + [(3, 0, 5)], "node long, soid long, songlen long"), "node").collect()
    assert {n: [r["side"] for r in sorted((x for x in sides if x["node"] == n), key=lambda r: r["soid"])] for n in (1, 2, 3)} == {1: [0, 0, 1, 1], 2: [0, 0, 1], 3: [0]}
    assert spark.sql(f"SELECT size({index.key('sequence(1L, 1000L)')}) AS n, size({index.key('sequence(1L, 1000L)', False)}) AS m").head() == (240, 1000)


def test_stored_prints(spark, tmp_path):
    rows = some_prints(6, 8)
    df = spark.createDataFrame(rows, PRINT).withColumnRenamed("soid", "oid")
    back = tables.unblobbed(tables.blobs(df)).orderBy("oid").collect()
    assert [tuple(r) for r in back] == rows
    with pytest.raises(Exception, match="in a print"):
        import pickle

        tables.from_blob(pickle.dumps(print))
    tables.append_prints(df, str(tmp_path / "p"))
    tables.append_prints(df, str(tmp_path / "p"))
    assert tables.read_saved(spark, str(tmp_path / "p")).count() == 12
    results = spark.createDataFrame([(0.9, 0.8, 0.7, "n", "a", "b"), (0.9, None, 0.7, "n", "a", "c")], tables.RESULTS)
    tables.append_results(results, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_listings(spark, tmp_path):
    for name in ("a/x.mp3", "a/skip/y.mp3", "a/b/c/z.flac", "w.MP3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\x01\x00")
    found = lambda *p, **k: [r["name"] for r in files.find_files(spark, str(tmp_path), list(p), **k).collect()]
    assert found(re.compile(r"\.(mp3|flac)$", re.I)) == ["w.MP3", "x.mp3", "y.mp3", "z.flac"] and found(files.whole(r"x\.mp3")) == ["x.mp3"]
    assert found(r"\.", exclude=["^skip$"], max_depth=1) == ["w.MP3", "x.mp3"] and found(lambda c: c.startswith("z"), r"^x") == ["x.mp3", "z.flac"]
    assert found(r"\.", limit=2, descending=True) == ["z.flac", "y.mp3"] and found(r"\.", limit=0) == []
    assert {tuple(r["names"]) for r in files.by_folder(files.find_files(spark, str(tmp_path), [r"\."])).collect()} == {("x.mp3",), ("y.mp3",), ("z.flac",), ("w.MP3",)}
    assert files.joined("a", "b\\c") == "a/b/c" and files.local_path("~").startswith("/")


def test_pcm_source_and_dump_function(spark, tmp_path):
    (tmp_path / "s.pcm").write_bytes(np.arange(10, dtype="<i2").tobytes() + b"\x01")
    spark.dataSource.register(tables.PcmSource)
    rows = spark.read.format("pcm").option("chunk", 4).load(str(tmp_path / "s.pcm")).orderBy("chunk").collect()
    assert [r["samples"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    spark.udtf.register("parse_dump", tables.ParseDump)
    text = "ARTIST=a\nTITLE=t\nLENGTH=5\nFORMAT=MP3\nFINGERPRINT=ff 0a\n\nARTIST=b\nFORMAT=OGG\nFINGERPRINT=1"
    got = spark.createDataFrame([(text,), (None,)], "t string").createOrReplaceTempView("dumps") or spark.sql("SELECT p.* FROM dumps, LATERAL parse_dump(t) p").collect()
    assert [(r["artist"], r["length"], r["bitrate"], r["cprint"]) for r in got] == [("a", 5, None, [255, 10])]


def test_frames_of_a_stream(spark, tmp_path):
    schema = "song string, chunk_no long, samples array<double>"
    rng = np.random.default_rng(9)
    signal = {s: rng.normal(size=100) for s in "ab"}
    cuts = {"a": [0, 7, 50, 51, 100], "b": [0, 100]}
    for batch in range(4):
        rows = [(s, k, signal[s][u:v].tolist()) for s in "ab" for k, (u, v) in enumerate(zip(cuts[s], cuts[s][1:])) if k == batch]
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = windows.frames(stream, 16, 5, limit=90).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["song"], r["start"]): r["samples"] for r in spark.table("heard").collect()}
    assert got == {(s, k): pytest.approx(signal[s][k : k + 16].tolist()) for s in "ab" for k in range(0, 75, 5)}


def test_scratch_is_released(spark):
    df = storage.materialise(spark.range(3), "t")
    root = storage.shared_dir(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
    storage.discard(df)
    fs, path = storage._hadoop(spark, root)
    assert fs.exists(path) and not fs.exists(storage._hadoop(spark, df._sonolith_path)[1])


def test_command_line(spark, tmp_path, capsys):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(22050)
        f.writeframes((9000 * np.sin(np.arange(22050 * 12) / 9)).astype("<i2").tobytes())
    cli.main(["chromagram", str(tmp_path / "a.wav"), str(tmp_path / "a.png")])
    cli.main(["resample", str(tmp_path / "a.wav"), str(tmp_path / "a.pcm"), "--rate", "11025"])
    assert (tmp_path / "a.png").read_bytes()[:4] == b"\x89PNG" and (tmp_path / "a.pcm").stat().st_size == 2 * 11025 * 12
    cli.main(["generate", str(tmp_path / "a.wav"), str(tmp_path / "prints")])
    assert spark.read.parquet(str(tmp_path / "prints")).head()["songlen"] == 12
    cli.main(["match", str(tmp_path / "prints"), str(tmp_path / "results")])
    assert spark.read.parquet(str(tmp_path / "results")).count() == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
