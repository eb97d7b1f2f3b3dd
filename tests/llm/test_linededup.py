"""Long passages and small sources in the pipeline's line stage."""

import corpus_pipeline as p


def test_line_stage_drops_long_passages(spark):
    passage, few = (" ".join(f"{x}{k}" for k in range(50)) for x in "pq")
    texts = [("big", f"own {k}\n{passage if k % 100 == 0 else 'other'} \n{few if k < 2 else 'x'}{'' if k < 2 else k}") for k in range(400)]
    texts += [("big", f"own {k}\nsaid by five") if k < 405 else ("small", f"own {k}\nfooter") for k in range(400, 424)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"].split("\n") for r in p.line_dedup(spark, docs, "").collect()}
    assert len(out) == len(texts)
    left = [line.strip() for lines in out.values() for line in lines]
    assert left.count(passage) == 0 and left.count(few) == 2  # on 4 of 405 pages; on 2
    assert left.count("said by five") == 5 and left.count("footer") == 0  # short: 1 %; all 19 pages of a small source
