"""Every stage of the pipeline on what its predecessor kept."""

from collections import Counter

import corpus_pipeline as p
from sonolith.llm import simhash
from tests.llm.test_contracts import DOCS, check_pieces, library, some_docs

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, seen = docs.collect(), {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == list(p.COLUMNS)
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            seen[name] = docs.collect()
    clean, lined, single, mixed = (seen[n] for n, _ in p.STAGES[:4])
    assert 0.8 * len(rows) < len(clean) < len(rows)
    assert {r["doc_id"] for r in lined} == {r["doc_id"] for r in clean} and all(r["n_chars"] == len(r["text"]) for r in lined)
    assert len({r["doc_id"] for r in single}) == len(single) < len(lined)
    kept = {simhash.simhash(r["text"].encode()) for r in single}
    assert all(min((a ^ b).bit_count() for a in kept) <= 20 for b in {simhash.simhash(r["text"].encode()) for r in lined})
    taken = Counter(r["doc_id"] for r in mixed)
    assert taken.keys() <= {r["doc_id"] for r in single} and max(taken.values()) == 2
    check_pieces(out.collect(), [(r["doc_id"], r["text"]) for r in mixed], library())


def test_stages_stand_odd_rows(spark):
    docs = spark.createDataFrame(some_docs(), DOCS).select(*p.COLUMNS)
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
