"""Feature extraction: golden values, and kernels against plain loops."""

import math
import wave

import numpy as np
import pytest

from sonolith.operators import bark, extract, features, frames, report

ONE_TO_NINE = np.arange(1.0, 10).reshape(3, 3)
STEPS = np.array([[1.0, 2, 3], [3, 4, 5], [6, 7, 8]])


@pytest.mark.parametrize("image, want", [([[1, 2], [3, 4]], [[1, 3], [4, 10]]), ([[1], [2], [3]], [[1], [3], [6]]), ([[1, 2, 3]], [[1, 3, 6]])])
def test_integral_image(image, want):
    assert features.integral(np.array(image, float))[1:, 1:].tolist() == want


def plain(image, kind, x, y, w, h):
    """Filter value with differences in place of logarithms."""
    return float(features.contrast(features.integral(np.asarray(image, float)), x, kind, y, h, w, features.difference))


def test_filters():
    for (x, y, w, h), want in {(0, 0, 1, 1): 1, (0, 0, 2, 2): 12, (0, 0, 3, 3): 45, (1, 1, 2, 2): 28, (2, 2, 1, 1): 9, (0, 0, 3, 1): 12, (0, 0, 1, 3): 6}.items():
        assert plain(ONE_TO_NINE, 0, x, y, w, h) == want
    for (x, y, w, h), want in {(0, 0, 1, 1): 1, (0, 0, 2, 2): 2, (0, 0, 3, 2): 3}.items():
        assert plain(STEPS, 1, x, y, w, h) == want
    for (x, y, w, h), want in {(0, 0, 2, 1): 2, (0, 0, 2, 2): 4, (0, 0, 2, 3): 6}.items():
        assert plain(STEPS, 2, x, y, w, h) == want
    image = [[1, 2.1, 3.4], [3.1, 4.1, 5.1], [6, 7.1, 8]]
    for (x, y, w, h), want in {(0, 0, 2, 2): 0.1, (1, 1, 2, 2): 0.1, (0, 1, 2, 2): 0.3}.items():
        assert plain(image, 3, x, y, w, h) == pytest.approx(want)
    assert plain(STEPS, 4, 0, 0, 3, 3) == -13 and plain(STEPS, 5, 0, 0, 3, 3) == -15
    sums = features.integral(np.array([[0.0, 1], [2, 3]]))
    assert features.contrast(sums, np.arange(2), 0, 0, 1, 1).tolist() == pytest.approx([0.0, 1.0986123])
    assert features.difference(2, 1) == 1 and features.log_difference(2, 1) == pytest.approx(0.4054651)


def test_calculator():
    image = np.array([[0.0, 1], [2, 3], [4, 5]])
    assert features.sub_prints(image, [(0, 0, 1, 1, 0.01, 1.01, 1.5)]).tolist() == [0, 3, 2]
    assert len(features.sub_prints(np.zeros((15, 12)))) == 0 and len(features.sub_prints(np.ones((16, 12)))) == 1


def one_bin(k):
    e = np.zeros((1, 129))
    e[0, k] = 1
    return e


def test_chroma_fold():
    for k, note in ((113, 0), (112, 11), (64, 2)):
        got = features.fold(one_bin(k), 256, 1000, 10, 510)[0]
        assert got[note] == 1 and got.sum() == 1
    for k, want in ((64, {1: 0.286905, 2: 0.713095}), (113, {0: 0.555242, 11: 0.444758}), (112, {0: 0.401354, 11: 0.598646})):
        got = features.fold(one_bin(k), 256, 1000, 10, 510, interpolate=True)[0]
        assert {i: round(v, 6) for i, v in enumerate(got) if v} == pytest.approx(want, abs=1e-6)


def test_smoothing_and_norms():
    rows = np.array([[0.0, 5], [1, 6], [2, 7], [3, 8]])
    assert features.smooth(rows[:3], (0.5, 0.5)).tolist() == [[0.5, 5.5], [1.5, 6.5]]
    assert features.smooth(rows, (0.5, 0.7, 0.5)) == pytest.approx(np.array([[1.7, 10.2], [3.4, 11.9]]))
    assert (features.smooth(rows, (1, -1)) == -1).all() and len(features.smooth(rows[:1], (1, 1))) == 0
    assert features.normalised(np.array([[0.0, 0.001, 0.002, 0.003]])).tolist() == [[0, 0, 0, 0]]
    assert features.normalised(np.array([[3.0, 4]])) == pytest.approx(np.array([[0.6, 0.8]]))
    assert features.window(10, 1) == pytest.approx([0.08, 0.187619556165, 0.460121838273, 0.77, 0.972258605562, 0.972258605562, 0.77, 0.460121838273, 0.187619556165, 0.08])


def test_downmix():
    assert features.downmix(np.array([[1, 2], [-1, -2], [32767, 32767], [-3, 0]], np.int16)).tolist() == [1, -1, 32767, -1]
    assert features.downmix(np.array([[1, 2, 4]], np.int16)).tolist() == [2] and features.downmix(np.array([[7]], np.int16)).tolist() == [7]


@pytest.mark.parametrize("rate, target", [(44100, 11025), (48000, 11025), (22050, 11025), (8000, 11025), (44100, 8000)])
def test_resampler(rate, target):
    t = np.arange(rate) / rate
    got = features.resample(np.sin(2 * np.pi * 440 * t), rate, target)
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / target)
    assert abs(len(got) - target) <= 1 and np.abs(got - want)[200:-200].max() < 0.01
    high = features.resample(np.sin(2 * np.pi * 0.49 * rate * t), rate, target)
    assert target >= rate or np.abs(high)[200:-200].max() < 0.05  # what the new rate cannot hold is gone
    assert features.resample(t[:100], target, target).tolist() == t[:100].tolist()
    with pytest.raises(ValueError):
        features.resample(t, 1000, target)


@pytest.mark.parametrize("hz, note", [(440, 0), (523.25, 3), (659.25, 7)])
def test_chroma_of_a_tone(hz, note):
    t = np.arange(11025 * 3) / 11025
    image = features.chroma((8000 * np.sin(2 * np.pi * hz * 1.002 * t)).astype(np.int16))
    assert (image.argmax(axis=1) == note).all()


def test_centroids():
    edges = features.band_edges(4, 100, 2000, 512, 8000)
    assert len(edges) == 5 and edges == sorted(edges)
    energy = np.zeros((2, 257))
    energy[0, edges[1] + 1] = 3.0
    got = features.centroids(energy, edges)
    width = edges[2] - edges[1]
    assert got[0, 1] == pytest.approx(1 / width) and got[1].tolist() == pytest.approx([0.5] * 4)


def test_bark_bands():
    of = bark.lines()
    assert of[0] == 0 and of[-1] == 16 and (np.diff(of) >= 0).all() and set(of) == set(range(17))


def test_band_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 40))
    want = [np.corrcoef(np.arange(40), row)[0, 1] ** 2 for row in x]
    assert bark.fits(x) == pytest.approx(np.array(want) ** 0.25)
    assert np.isnan(bark.fits(np.ones((1, 5)))[0]) and bark.fits(np.arange(6.0)[None]) == pytest.approx([1])


def test_packing_of_levels():
    assert bark.packed(np.array([0, 1, 2, 3]), 2) == b"\x1b" and bark.packed(np.array([1, 2, 3, 4]), 6) == bytes([0b00000100, 0b00100000, 0b11000100])


def test_second_extractor():
    t = np.arange(8000 * 20) / 8000
    assert bark.extract(np.sin(t)[: 8000 * 9]) is None
    r, dom, fit, harmonic = bark.extract(0.5 * np.sin(2 * np.pi * 440 * t))
    assert len(r) == 348 and len(dom) == 66 and 0 <= fit <= 3000
    level = np.searchsorted(bark.HARMONIC_CUTS, 4000 * round(440 / 8000 * 8192) / 4096, side="right")
    bits = "".join(f"{b:08b}" for b in dom)
    assert [int(bits[6 * k : 6 * k + 6], 2) for k in range(19)] == [level] * 19  # frames with sound; silence is level 0
    assert bark.trimmed(np.array([[0.0], [1e-9], [0.5], [0.0]])).tolist() == [[0.5], [0.0]]


def wav(path, samples, rate, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())


def test_fingerprints_of_files(spark, tmp_path):
    t = np.arange(22050 * 15) / 22050
    tune = 9000 * np.sin(2 * np.pi * (300 + 200 * np.sign(np.sin(2 * np.pi * t / 1.3))) * t)
    wav(tmp_path / "a.wav", tune, 22050)
    wav(tmp_path / "b.wav", np.repeat(tune, 2), 22050, 2)
    (tmp_path / "c.wav").write_bytes(b"no audio")
    (tmp_path / "d.wav").write_bytes((tmp_path / "a.wav").read_bytes()[:-1001])
    rows = {r["path"][-5]: r for r in extract.fingerprint(spark, str(tmp_path)).collect()}
    a, b, c, d = (rows[k] for k in "abcd")
    assert a["songlen"] == 15 and a["bit_rate"] == 353 and a["num_errors"] == 0 and a["problem"] is None and len(a["cprint"]) > 90
    assert a["cprint"] == b["cprint"] and a["r32"] == b["r32"] and b["bit_rate"] == 706 and len(a["r32"]) == 87 and len(a["dom16"]) == 33
    assert c["problem"] and c["num_errors"] == 1 and c["cprint"] == [] and d["num_errors"] == 1 and d["cprint"][:50] == a["cprint"][:50]
    assert spark.sql(f"SELECT {extract.empty_print(3)} AS p").head()["p"]["cprint"] == [0, 0, 0]


def test_sub_prints_of_split_songs(spark):
    rng = np.random.default_rng(6)
    image = rng.uniform(0, 1, (100, 12))
    rows = [("s", k, row.tolist()) for k, row in enumerate(image)] + [("t", k, row.tolist()) for k, row in enumerate(image[:20])]
    df = spark.createDataFrame(rows, "song string, frame long, chroma array<double>")
    got = {(r["song"], r["frame"]): r["word"] for r in extract.sub_prints(df, block=17).collect()}
    assert [got["s", k] for k in range(85)] == features.sub_prints(image).tolist() and [got["t", k] for k in range(5)] == features.sub_prints(image[:20]).tolist() and len(got) == 90


def test_frames_over_blocks(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=50)
    df = spark.createDataFrame([("s" if k % 50 == k else "t", 100 + 3 * (k % 50), float(v[k % 50])) for k in range(100)], "song string, at long, v double")
    rows = frames.numbered(df, "song", "at")
    assert [r["frame"] for r in rows.where("song = 's'").orderBy("at").collect()] == list(range(50))
    sums = frames.prefix_sums(rows, ["song"], "frame", "v", block=7).where("song = 't'").orderBy("frame").collect()
    assert [r["prefix"] for r in sums] == pytest.approx(np.cumsum(v))
    cut = frames.hops(rows, "song", "frame", "v", 8, 3).where("song = 's'").collect()
    assert {r["start"]: r["values"] for r in cut} == {s: pytest.approx(v[s : s + 8].tolist()) for s in range(0, 43, 3)}


def test_tags():
    frame = lambda name, text: name + (len(text) + 1).to_bytes(4, "big") + b"\x00\x00" + b"\x03" + text
    body = frame(b"TPE1", b"An Artist") + frame(b"TIT2", "Tïtle".encode()) + frame(b"TALB", b"Album")
    head = b"ID3\x03\x00\x00" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127])
    assert extract.read_tags(head + body + b"audio") == {"artist": "An Artist", "title": "Tïtle", "album": "Album", "length": None}
    tail = b"TAG" + b"title".ljust(30, b"\x00") + b"artist".ljust(30, b"\x00") + b"album".ljust(30, b"\x00") + bytes(35)
    assert extract.read_tags(b"audio" * 50 + tail)["artist"] == "artist" and extract.read_tags(b"") == dict.fromkeys(("artist", "title", "album", "length"))


def test_pictures():
    png = report.image_png(np.arange(24.0).reshape(2, 12))
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == (2).to_bytes(4, "big") + (12).to_bytes(4, "big")
    assert report.image_text(np.array([[1, 0.5]])) == "1.00000 0.50000\n" and math.isclose(features.RATE, 11025)


def test_filter_selection(spark):
    """Pairs that only one region tells apart: its filter comes first, and errors equal a count over all rows."""
    from sonolith.operators import training

    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        a = rng.uniform(0, 1, (4, 4))
        b = rng.uniform(0, 1, (4, 4))
        same = bool(k % 2)
        low = rng.uniform() < 0.5
        a[:2, :2] = 3.0 if low else 0.1
        b[:2, :2] = 3.0 if low == same else 0.1
        rows.append((same, a.ravel().tolist(), b.ravel().tolist()))
    df = spark.createDataFrame(rows, "same boolean, a array<double>, b array<double>").repartition(3)
    filters = training.candidates(4, 4)
    chosen = training.select(df, filters, rounds=3, cuts=8, pitches=4)
    first = chosen[0]
    assert (first.kind, first.pitch) == (0, 0) and first.pitches <= 2 and first.frames <= 2 and first.error == 0 and len(chosen) == 3
    told = {(r["bits"], r["same"]): r["n"] for r in training.rates(df, chosen[:1], 4).collect()}
    assert told == {(0, True): 150, (1, False): 150}
    value = lambda x, c: math.log1p(np.array(x).reshape(4, 4)[: c.frames, c.pitch : c.pitch + c.pitches].sum())
    second = training.select(df, [(0, 2, 2, 4)], rounds=1, cuts=5, pitches=4)[0]
    wrong = sum(((value(a, second) < second.cut) == (value(b, second) < second.cut)) != same for same, a, b in rows)
    assert second.error == pytest.approx(wrong / 300) and training.select(df.limit(0), filters, 1) == []
