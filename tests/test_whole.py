"""Queries work on whole texts and whole tables."""

import numpy as np

from sonolith.operators import alignment
from sonolith.plans import audio, catalogue, songs


def some_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_diagonals(x, y, errors=2):
    counts = {}
    for i, u in enumerate(x):
        for j in range(max(0, i - 120), min(len(y), i + 120)):
            if (u ^ y[j]).bit_count() <= errors:
                counts[j - i] = counts.get(j - i, 0) + 1
    return max(counts.values(), default=0)


def test_alignment_of_whole_prints(spark, tmp_path):
    rng = np.random.default_rng(4)
    for n, m, shift in ((500, 420, 30), (260, 600, -119), (300, 300, 119), (5, 1300, 0)):
        x, y = (rng.integers(0, 2**32, k) for k in (n, m))
        for i in range(200, min(n, m - shift)):
            if 0 <= i + shift:
                y[i + shift] = x[i] ^ (1 + 2 * (i % 2))
        a, b = x.tolist(), y.tolist()
        assert alignment.top_share(x, y) == brute_diagonals(a, b) / min(n, m)
        top = brute_diagonals(a, b, 1)
        assert alignment.distance(x, y) == (1 - top / min(n, m) if top else 0.0)
        long, short = (b, a) if m > n else (a, b)
        cut = short[40:300]
        assert alignment.seek_share(x, y, 40, 300) == (brute_diagonals(long[40:300], cut) / len(cut) if cut else 0.0)
    tail = " ".join(f"t{k}" for k in range(1000))
    head = [" ".join(f"{h}{k}" for k in range(1000)) for h in "ab"]
    path = some_documents(spark, tmp_path, [(i, f"{h} {tail}", "en", "s", 1) for i, h in enumerate(head)])
    (row,) = catalogue.alignment_topcount(spark, path).collect()
    assert 0.5 <= row["score"] < 0.52


def test_confusion_counts_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), [float(x) for x in rng.normal(0, 0.2, 3)]) for i in range(1050)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    label, v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32).astype(float)
    upper = np.triu(np.ones((1050, 1050), bool), 1)
    same = label[:, None] == label[None, :]
    want = set()
    for c in range(3):
        close = np.abs(v[:, None, c] - v[None, :, c]) < 0.1
        want |= {(c, s, int((upper & (same == s)).sum()), int((upper & (same == s) & close).sum())) for s in (False, True)}
    assert {tuple(r) for r in audio.confusion_eval(spark, str(tmp_path)).collect()} == want


def test_group_members_are_all_there(spark, tmp_path):
    rows = [(i, "x", "en" if i % 9 else None, "st"[i % 2], 1) for i in range(40)]
    base, n = {}, {}
    for i, _, lang, source, _ in rows:
        base.setdefault((lang, source), i)
        n[lang, source] = n.get((lang, source), 0) + 1
    got = [tuple(r) for r in songs.group_variants_report(spark, some_documents(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=lambda r: r[4]) == [(lang, source, base[lang, source], n[lang, source], i) for i, _, lang, source, _ in rows]


def test_prints_of_whole_texts(spark, tmp_path):
    head = " ".join(f"h{k}" for k in range(948))
    rows = [(i, f"{head} " + " ".join(f"{tail}{k}" for k in range(948)), "en", "s", 9000) for i, tail in enumerate("aab")]
    path = some_documents(spark, tmp_path, rows)
    assert {r["cprint_len"] for r in catalogue.fp_accessors(spark, path).collect()} == {1896}
    assert {(r["a"], r["b"]) for r in catalogue.similarity_matches(spark, path).collect()} == {(0, 1)}
