"""Ids of texts with separators that only str.split() cuts at, before and after their chunks are known; what the cache holds."""

from sonolith.llm import packing, tokens
from sonolith.llm.common import ARROW_ROWS


def test_ids_equal_the_library():
    tok = tokens.ChunkTokenizer(tokens.default_tokenizer())
    texts = ["a b", "a\x1cb c", "it's\x1fa b\x1d\x1e c", "é" * 70 + " a b", "b " * 9, "", " \x1c"]
    for text in texts * 2:
        ids = tok.lib.encode(text, add_special_tokens=False).ids
        assert tok.ids(text) == b"".join(i.to_bytes(4, "little") for i in ids) and tok.count(text) == len(ids)


def test_letters_whose_lower_case_lies_beyond_the_rule():
    tok = tokens.ChunkTokenizer(tokens.default_tokenizer())
    for c in map(chr, range(0x300)):
        for text in (c, f"a{c}b, x"):
            assert tok.ids(text) == b"".join(i.to_bytes(4, "little") for i in tok.lib.encode(text, add_special_tokens=False).ids), text


def test_cache_is_bounded_and_keeps_frequent_chunks(monkeypatch):
    tok = tokens.ChunkTokenizer(tokens.default_tokenizer())
    for k in range(0, 400_000, 1_000):
        tok.ids(" ".join(f"w{i}" for i in range(k, k + 1_000)))
    held = sum(len(v) for v in vars(tok).values() if isinstance(v, dict) and v not in (tok.vocab, tok.whole, tok.letters))
    assert held < 310_000
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    tok.forget()
    learnt, chunk = [], tok._chunk
    monkeypatch.setattr(tok, "_chunk", lambda c: learnt.append(c) or chunk(c))
    for k in range(200):
        text = "Frequent, " + " ".join(f"zqx{k}y{i}" for i in range(20))
        assert tok.ids(text) == b"".join(i.to_bytes(4, "little") for i in tok.lib.encode(text, add_special_tokens=False).ids)
    assert learnt.count("Frequent,") == 1


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    before, seen, write = spark.conf.get(ARROW_ROWS), [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, what: seen.append(int(spark.conf.get(ARROW_ROWS))) or write(df, what))
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["n"]) for r in packing.tokenised(docs, tokens.default_tokenizer()).collect()} == {(1, 3), (2, 1)}
    assert seen and max(seen) <= 1_000 and spark.conf.get(ARROW_ROWS) == before
