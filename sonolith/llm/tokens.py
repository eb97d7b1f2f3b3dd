"""Token ids and token counts with a whole-token shortcut (operator 8, and the tokenizer of operator 3).

Offline proof: every vocabulary string that ends a word is encoded alone by the library once; those that come back as
exactly their own id are whole tokens. At run time a text is cut at white space, which no pre-token and no merge of
this tokenizer crosses; distinct chunks are looked up in a bounded cache of two generations, so that frequent ones stay
when rare ones go; a new chunk is cut into pre-tokens, whole tokens give their id at once, and only the rest go through
the library's merges. Chunks for which the cutting rule is
not proved equal to the library's (code points from U+0250 on, or a special string) are encoded by the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, pieces

LIMIT_TOKENS = 2048
#: Chunks and pre-tokens in a generation of the cache, which holds two of them.
CACHE_CHUNKS = 150_000
_SAFE_END = 0x250  # below it no normal form, no combining mark and no one-to-many lower case but U+0130


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of any text as `tokenizers` gives them (add_special_tokens=False), by chunks.

    Serves tokenizers that drop white space and split words by the contraction / letters / digit / other pattern with
    byte-level symbols and a word-end suffix; the constructor checks the file's pattern and refuses any other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if not (split["behavior"] == "Removed" and split["invert"] and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]):
            raise ValueError(f"{path}: not a tokenizer that drops white space between words")
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.lib.model  # merges a pre-token without normalising and splitting it again
        self.letters = {b: c for c, b in _byte_letters().items()}
        kinds: dict[str, str] = {"letter": "", "digit": "", "other": "", "space": ""}
        self.unsafe = os.path.commonprefix(self.special) or "<"
        odd = ""
        for c in map(chr, range(_SAFE_END)):
            kind = self._kind(c)
            if kind == "odd":
                odd += c
            else:
                kinds[kind] += c
        cls = {k: "[" + re.escape(v) + "]" for k, v in kinds.items()}
        self.rule = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{cls['letter']}+|{cls['digit']}|{cls['other']}+")
        self.odd = re.compile(f"[^{re.escape(''.join(map(chr, range(_SAFE_END))))}]|{re.escape(self.unsafe)}" + (f"|[{re.escape(odd)}]" if odd else ""))
        self.blank = re.compile(f"[{re.escape(kinds['space'])}]+")
        self.cache: dict[str, bytes] = {}  # chunks and pre-tokens: a pre-token alone is a chunk of the same ids
        self.older: dict[str, bytes] = {}

    def _kind(self, c: str) -> str:
        """Class of a code point as the library's own normaliser and splitter show it."""
        low = self.lib.normalizer.normalize_str(c)
        cut = lambda s: [len(x[0]) for x in self.lib.pre_tokenizer.pre_tokenize_str(s)]
        if low == " " or not cut(low):
            return "space"
        if len(low) != 1 or low != c.lower() or ord(low) >= _SAFE_END:  # the rule would not meet what it becomes
            return "odd"
        return "letter" if len(cut(f"a{low}a")) == 1 else "other" if len(cut(f"!{low}!")) == 1 else "digit"

    @cached_property
    def whole(self) -> dict[str, bytes]:
        """The proof: string -> its id (4 bytes, little-endian) for what encodes alone as exactly that one token."""
        letters = _byte_letters()
        told: dict[str, int] = {}
        for s, i in self.vocab.items():
            if s.endswith(self.suffix) and all(c in letters for c in s[: -len(self.suffix)]):
                text = bytes(letters[c] for c in s[: -len(self.suffix)]).decode("utf-8", "replace")
                if text and "�" not in text:
                    told[text] = i
        texts = list(told)
        found = self.lib.encode_batch(texts, add_special_tokens=False)
        return {t: told[t].to_bytes(4, "little") for t, e in zip(texts, found) if e.ids == [told[t]]}

    def _chunk(self, chunk: str) -> bytes:
        if self.odd.search(chunk):
            return np.array(self.lib.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        whole, cache, older, letters, out = self.whole, self.cache, self.older, self.letters, []
        for p in self.rule.findall(chunk.lower()):
            ids = whole.get(p) or cache.get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    symbols = p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()])
                    ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])
                if len(p) < 64:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space; str.split() also cuts at \\x1c to \\x1f, the library does not."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # a pattern would look at every character
            return self.blank.split(text)
        return text.split()

    def _learn(self, chunks) -> dict[str, bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older, long = self.cache, self.older, {}
        for c in set(chunks).difference(cache):
            (cache if len(c) < 64 else long)[c] = older.get(c) or self._chunk(c)
        return long

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        chunks = self.chunks(text)
        long = self._learn(chunks)
        cache = self.cache
        if long:
            return b"".join([cache[c] if c in cache else long[c] for c in chunks])
        return b"".join(map(cache.__getitem__, chunks))

    def count(self, text: str) -> int:
        chunks = Counter(self.chunks(text))
        long = self._learn(chunks)
        cache = self.cache
        return sum(n * len(cache[c] if c in cache else long[c]) for c, n in chunks.items()) // 4


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _loaded(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenizer(path: str) -> ChunkTokenizer:
    tok = _loaded(path)
    claim_memory(tok, tok.forget)
    return tok


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; one pass, no shuffle.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; a null doc_id stays null;
    other columns of docs are not read.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in pieces(batches):
            counts = [tok.count(t.as_py()) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
