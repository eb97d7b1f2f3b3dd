"""Near copies against brute force."""

import numpy as np
import pytest

import corpus_pipeline as p
from sonolith.llm import common, nearcopies, simhash
from tests.test_similarity import shuffled


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies_equal_brute_force(spark, small):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4000, int(rng.integers(3, 160)))) for _ in range(40)]
    for base in texts[:25]:
        for edits in (1, 2, 3, 5):
            words = base.split()
            for at in rng.integers(0, len(words), edits):
                words[int(at)] = f"e{int(rng.integers(10**6))}"
            texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "", " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    alike = lambda x, y: x == y or 10 * len(x & y) >= 8 * len(x | y)
    label = list(range(len(texts)))
    while (new := [min(label[j] for j in range(len(texts)) if alike(sets[i], sets[j])) for i in range(len(texts))]) != label:
        label = new
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs, small=small).collect()} == dict(enumerate(label))
    kept = {r["doc_id"] for r in p.simhash_dedup(spark, docs, "").collect()}
    assert kept == set(label) and len(kept) < len(texts) - 20


def test_chains():
    """All pairs within the distance have a chain; the rule against one chain after the other; no pairs at all."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    b = a.copy()
    for k in range(400):
        for bit in rng.choice(128, k // 4, replace=False):
            b[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    got = simhash.chained(a, b, 48)
    for k in range(400):
        x = [int(p) ^ int(q) for p, q in zip(a[k], b[k])]
        ring = [(x[0] << 64 | x[1]) >> (120 - 8 * i) & 255 for i in range(16)]
        some = any(all(sum(ring[(s + i) % 16].bit_count() for i in range(n)) <= n * 48 // 16 for n in range(1, 17)) for s in range(16))
        assert got[k] == some and (some or sum(v.bit_count() for v in ring) > 48)
    assert 190 <= got.sum() < 400 and len(simhash.chained(a[:0], b[:0], 48)) == 0
    assert list(nearcopies._pairs(np.arange(2), np.array([1, 9]), np.arange(2), a[:2], 0.8))[0][0].size == 0


def test_stage_asks_the_pigeonring_index(spark, monkeypatch):
    """Pairs within two bits come from operator 10's index; the stage calls it."""
    rng = np.random.default_rng(12)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 60, np.int64)]
    fps += [fps[k] ^ (1 << k) ^ (1 << (k + 9)) for k in range(20)] + [fps[k] ^ 7 for k in range(20, 30)] + fps[30:35]
    got = {(r["a"], r["b"]) for r in nearcopies.ring_pairs(spark.createDataFrame(list(enumerate(fps)), "uid long, s1 long")).collect()}
    assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2 and b >= 60}
    called = []
    monkeypatch.setattr(nearcopies, "fingerprint_links", lambda *a: called.append(1) or simhash.fingerprint_links(*a))
    docs = spark.createDataFrame([(i, f"{t} w x y z", "en", "s", 9) for i, t in enumerate("aabc")], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.simhash_dedup(spark, docs, "").count() == 3 and called


def test_stage_shuffles_few_texts(spark):
    """All texts went through a shuffle to verify some pairs, and again to be kept, where the ids were no small table."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{k:x}" for k in rng.integers(0, 2**40, 3000)) for _ in range(120)]
    texts += [texts[0] + " more", texts[1] + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["doc_id"] for r in p.simhash_dedup(spark, docs, "").select("doc_id").collect()} == set(range(120))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_rows_with_ids(spark, monkeypatch, words):
    monkeypatch.setattr(common, "ID_WORDS", words)
    ids = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 2**33 + 63, 2**63 - 1]
    rows = [(i, k) for i in [*ids, *(x + 2 for x in ids[:-1]), None] for k in range(2)]
    big = spark.createDataFrame(rows, "id long, _word int")
    got = common.with_ids(big, spark.createDataFrame([(i,) for i in [*ids, 5, 0, None]], "id long"), "id")
    assert got.columns == ["id", "_word"] and sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in ids)
    assert common.with_ids(big, spark.createDataFrame([], "id long"), "id").count() == 0
