"""The similarity join on copies, chunks and long prints, and what it shuffles."""

import numpy as np
import pytest

from sonolith.operators import similarity
from tests.test_core import COLS, brute_cp, brute_fm, brute_score, some_prints, words


def shuffled(spark):
    return sum(e.totalShuffleWrite() for e in (spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0),))


def test_joins_shuffle_less_than_the_words(spark):
    """A row a key of some words took 20 bytes a word and more; a place of a low bit takes a quarter of one."""
    rng = np.random.default_rng(6)
    rows = [(i, 100 + i % 40, 128, 0, words(rng, 87), words(rng, 33, 16), words(rng, 2000)) for i in range(60)]
    rows.append((60, *rows[0][1:]))
    fp = spark.createDataFrame(rows, COLS)
    before = shuffled(spark)
    assert {(r["a"], r["b"]) for r in similarity.all_pairs_results(fp).collect()} == {(0, 60)}
    assert shuffled(spark) - before < 4 * 2000 * len(rows)


@pytest.mark.parametrize("rows", [4, 16_384])
def test_chunks_and_copies_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "CHUNK_ROWS", rows)
    monkeypatch.setattr(similarity, "STEP_PAIRS", 40)
    some = some_prints(48, 7)
    some += [(48 + k, *some[5][1:]) for k in range(3)] + [(51, 0, *some[5][2:]), (52, 0, *some[5][2:]), (53, -5, *some[5][2:])]
    some += [(54, *some[11][1:6], [0] * 70), (55, *some[11][1:6], [0] * 70 + [3, 1 << 40])]
    fp = spark.createDataFrame(some, COLS)
    near = {(a[0], b[0]): (brute_cp(a[6], b[6]), brute_fm(a, b)) for a in some for b in some if a[0] != b[0] and brute_score(a, b) > 0.6}
    got = {(r["a"], r["b"]): (r["cp"], r["fm"]) for r in similarity.scored_pairs(fp).collect()}
    assert got.keys() >= {k for k in near if k[0] < k[1]} and all(got[k] == near[k] for k in near if k[0] < k[1])
    assert {(r["a"], r["b"]) for r in similarity.similarity_join(fp).collect()} == {k for k in near if k[0] < k[1]}
    assert {(r["a"], r["b"]) for r in similarity.similarity_join(fp, left=fp.where("soid % 3 = 2")).collect()} == {k for k in near if k[0] % 3 == 2}
    assert {(51, 52), (5, 48), (54, 55)} <= near.keys() and similarity.scored_pairs(fp.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["overreach_filter", "similarity_matches", "second_hop", "all_pairs_results", "symmetric_lookup", "metadata_lookup", "song_graph"])
def test_queries_join_no_whole_prints(spark, name):
    """Words of prints were joined to every candidate pair, in overreach_filter and second_hop for each use of the pairs."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cprint" not in plan and "FlatMapGroupsInArrow" not in plan


def test_second_hop_writes_prints_once(spark, monkeypatch):
    """Both hops wrote all prints anew, and where the first one's matches were no small table the second dealt out whole prints."""
    some = some_prints(40, 3)
    some += [(40 + k, *some[k][1:]) for k in range(12)] + [(52 + k, *some[k][1:]) for k in range(6)]
    some = [(*p[:6], p[6] + words(np.random.default_rng(p[1]), 10_000)) for p in some]
    fp = spark.createDataFrame(some, COLS)
    written = []
    monkeypatch.setattr(similarity, "materialise", lambda df, what, f=similarity.materialise: written.append((what, (out := f(df, what)).count())) or out)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    try:
        got = sorted((r["origin"], r["soid"], r["match"]) for r in similarity.second_hop(fp, fp.where("soid % 4 = 0")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = {(a[0], b[0]) for a in some for b in some if a[0] != b[0] and brute_score(a, b) > 0.6}
    assert got == sorted((o, s, m) for o, s in near if o % 4 == 0 for t, m in near if t == s and m != o) and got
    assert [n for what, n in written if what == "slim"].count(len(some)) == 1
    assert shuffled(spark) - before < 3 * 10_000 * len(some)
