"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 6), in numpy.

Inputs of a step are a learned word vector and the mean of the word's learned character-bigram vectors; nothing about
words is counted beforehand but which ones have a vector. Windows of WINDOW words start every STRIDE words, so windows
overlap and cover the whole text; the network reads each in both directions, attention pools its states, and a text's
score comes from its most toxic window. Training is on a bounded sample of labelled documents (multiple-instance: the
gradient flows through each document's highest windows and a random one); scoring is one pass without a shuffle over
the broadcast weights, whose size FIT_WORDS and the layer sizes bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, pieces

#: Bounds of the training sample: documents (by least hash of their id), characters of one, and words kept.
FIT_DOCS, FIT_CHARS, FIT_WORDS = 4000, 20_000, 20_000
WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM, BIGRAMS = 12, 12, 8, 1024
THRESHOLD = 0.3
STEPS = 350
CACHE_WORDS, GROUP_WORDS = 100_000, 50_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed bigrams of ^word$ one word after the other, number of them for each word)."""
    code = np.frombuffer("\n".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pair = (code[:-1] * 31 + code[1:] * 7) % BIGRAMS
    pair = pair[(code[:-1] != 10) & (code[1:] != 10)]
    return pair, np.array([len(w) + 1 for w in words])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def windows(n: int) -> int:
    return max(1, math.ceil((n - WINDOW) / STRIDE) + 1)


def cut(rows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of word rows, 0 where a window is short."""
    k = windows(len(rows))
    padded = np.zeros((k - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


@dataclass
class Network:
    """Weights by name. wx, wh, b: both directions, gates z, r, n side by side."""

    words: dict[str, int]  # row of a known word in `word`; row 0 is for all others
    p: dict[str, np.ndarray]
    prior: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    gates: np.ndarray | None = None

    def __getstate__(self):
        return {"words": self.words, "p": self.p, "prior": self.prior, "rows": {}, "gates": None}

    def forget(self) -> None:
        self.rows, self.gates = {}, None

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.vectors(np.array([self.words.get(w, 0) for w in words]), *bigrams(words))

    def vectors(self, ids: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words from their rows in `word` and their bigrams."""
        chars = np.add.reduceat(self.p["char"][pair], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][ids], chars), axis=1), ids, pair, n

    # -- scoring -----------------------------------------------------------------------------------------------------

    def lookup(self, words: list[str]) -> np.ndarray:
        """Rows of the gate table (row 0: no word); new words are added, and the table starts anew when it is full."""
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if self.gates is None or len(self.rows) + len(new) > CACHE_WORDS and self.rows:
            self.rows, self.gates, new = {}, np.zeros((2, 1 << 15, 3 * HIDDEN), np.float32), list(dict.fromkeys(words))
        if new:
            x = self.inputs(new)[0]
            first = len(self.rows) + 1
            if first + len(new) > self.gates.shape[1]:
                grown = np.zeros((2, max(2 * self.gates.shape[1], first + len(new)), 3 * HIDDEN), np.float32)
                grown[:, :first] = self.gates[:, :first]
                self.gates = grown
            self.gates[:, first : first + len(new)] = np.matmul(x[None], self.p["wx"]) + self.p["b"][:, None]
            self.rows.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def window_logits(self, idx: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Logit of each window of idx (n, WINDOW), rows of the gate table."""
        length = WINDOW - (idx[:, ::-1] != 0).argmax(axis=1)
        length[~idx.any(axis=1)] = 1
        out = np.empty(len(idx), np.float32)
        order = np.argsort(length, kind="stable")
        for s in range(0, len(order), 2048):
            part = order[s : s + 2048]
            out[part] = self._forward(idx[part, : length[part].max()], gates, length[part].min())
        return out

    def _forward(self, idx: np.ndarray, gates: np.ndarray, least: int) -> np.ndarray:
        n, steps = idx.shape
        h, wh = np.zeros((2, n, HIDDEN), np.float32), self.p["wh"]
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        a = np.empty((2, n, 3 * HIDDEN), np.float32)
        mask = (idx != 0).T.astype(np.float32)
        for t in range(steps):
            back = steps - 1 - t
            np.take(gates[0], idx[:, t], axis=0, out=a[0], mode="clip")
            np.take(gates[1], idx[:, back], axis=0, out=a[1], mode="clip")
            u = np.matmul(h, wh)
            zr = _sigmoid(a[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            new = np.tanh(a[..., 2 * HIDDEN :] + zr[..., HIDDEN:] * u[..., 2 * HIDDEN :])
            h -= new
            h *= zr[..., :HIDDEN]
            h += new
            if t >= least:
                h[0] *= mask[t][:, None]
            if back >= least:
                h[1] *= mask[back][:, None]
            states[t, :, :HIDDEN] = h[0]
            states[back, :, HIDDEN:] = h[1]
        score = states @ self.p["att"]
        score[mask == 0] = -1e9
        score -= score.max(axis=0)
        share = np.exp(score)
        share /= share.sum(axis=0)
        share *= mask
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of each text: the highest logit of its windows; a text without words is one empty window."""
        out, held, size = np.empty(len(texts), np.float32), [], 0
        table = None

        def flush() -> None:
            nonlocal held, size
            if held:
                found = self.window_logits(np.concatenate([x for _, x in held]), table)
                at = 0
                for k, x in held:
                    out[k] = max(out[k], found[at : at + len(x)].max())
                    at += len(x)
            held, size = [], 0

        out[:] = -np.inf
        group: list[tuple[int, list[str]]] = []
        load = 0
        for k, text in enumerate(texts):
            group.append((k, words_of(text)))
            load += len(group[-1][1])
            if load < GROUP_WORDS and k + 1 < len(texts):
                continue
            if self.gates is not None and len(self.rows) + load > CACHE_WORDS:
                flush()  # the table may start anew
            rows = self.lookup([w for _, own in group for w in own] or ["a"])
            table, at = self.gates, 0
            for j, own in group:
                whole = cut(rows[at : at + len(own)])
                at += len(own)
                for s in range(0, len(whole), 4096):
                    held.append((j, whole[s : s + 4096]))
                    size += len(held[-1][1])
                    if size >= 4096:
                        flush()
            group, load = [], 0
        flush()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if "out" not in self.p:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-self.logits(texts).astype(np.float64)))


# -- training ------------------------------------------------------------------------------------------------------------


def _known(held: Counter, least: int) -> dict[str, int]:
    """Rows of the words that have a vector of their own: those that `least` documents hold, the most common first."""
    kept = sorted((w for w, n in held.items() if n >= least), key=lambda w: (-held[w], w))[:FIT_WORDS]
    return {w: k + 1 for k, w in enumerate(kept)}


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row number."""
    return np.stack([np.bincount(rows, values[:, c], n) for c in range(values.shape[1])], axis=1).astype(np.float32)


def _train_step(net: Network, idx: np.ndarray, inputs: tuple, y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the (weighted) mean cross-entropy over windows idx (rows are 1 + places in inputs)."""
    p, (n, steps) = net.p, idx.shape
    x, ids, pair, count = inputs
    x0 = np.concatenate((np.zeros((1, x.shape[1]), np.float32), x))[idx]  # n, steps, inputs
    mask = (idx != 0).astype(np.float32)
    caches, states = [], np.empty((n, steps, 2 * HIDDEN), np.float32)
    for d in range(2):
        a = x0 @ p["wx"][d] + p["b"][d]
        h, cache = np.zeros((n, HIDDEN), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            u = h @ p["wh"][d]
            zr = _sigmoid(a[:, t, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(a[:, t, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            cache.append((t, h, z, r, new, u[:, 2 * HIDDEN :]))
            h = (new + z * (h - new)) * mask[:, t, None]
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        caches.append(cache)
    score = np.where(mask > 0, states @ p["att"], -1e9)
    share = np.exp(score - score.max(axis=1, keepdims=True))
    share = share / share.sum(axis=1, keepdims=True) * mask
    pooled = np.einsum("nt,nth->nh", share, states)
    logit = pooled @ p["out"] + p["bias"][0]
    g = ((1 / (1 + np.exp(-logit)) - y) * (1 / n if weight is None else weight / weight.sum())).astype(logit.dtype)
    grad = {"bias": np.array([g.sum()]), "out": pooled.T @ g}
    d_pool = g[:, None] * p["out"]
    d_share = np.einsum("nh,nth->nt", d_pool, states)
    d_score = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    grad["att"] = np.einsum("nt,nth->h", d_score, states)
    d_states = share[..., None] * d_pool[:, None] + d_score[..., None] * p["att"]
    d_x = np.zeros_like(x0)
    grad["wx"], grad["wh"], grad["b"] = (np.zeros_like(p[k]) for k in ("wx", "wh", "b"))
    for d in range(2):
        d_h, d_a = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, 3 * HIDDEN), np.float32)
        for t, h, z, r, new, un in reversed(caches[d]):
            g_h = (d_h + d_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]) * mask[:, t, None]
            g_new = g_h * (1 - z) * (1 - new * new)
            g_z, g_r = g_h * (h - new) * z * (1 - z), g_new * un * r * (1 - r)
            g_u = np.concatenate((g_z, g_r, g_new * r), axis=1)
            d_a[:, t] = np.concatenate((g_z, g_r, g_new), axis=1)
            grad["wh"][d] += h.T @ g_u
            d_h = g_h * z + g_u @ p["wh"][d].T
        grad["wx"][d] = np.einsum("nti,ntg->ig", x0, d_a)
        grad["b"][d] = d_a.sum(axis=(0, 1))
        d_x += d_a @ p["wx"][d].T
    per_word = _scatter(idx.ravel(), d_x.reshape(-1, x.shape[1]), len(x) + 1)[1:]
    grad["word"] = _scatter(ids, per_word[:, :WORD_DIM], len(p["word"]))
    grad["char"] = _scatter(pair, np.repeat(per_word[:, WORD_DIM:] / count[:, None], count, axis=0), BIGRAMS)
    return grad


def _initial(rng: np.random.Generator, words: int, prior: float) -> dict[str, np.ndarray]:
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    size = WORD_DIM + CHAR_DIM
    return {
        "word": draw(WORD_SCALE, words, WORD_DIM), "char": draw(0.3, BIGRAMS, CHAR_DIM), "wx": draw(1 / math.sqrt(size), 2, size, 3 * HIDDEN), "wh": draw(0.5 / math.sqrt(HIDDEN), 2, HIDDEN, 3 * HIDDEN),
        "b": np.zeros((2, 3 * HIDDEN), np.float32), "att": draw(0.3, 2 * HIDDEN), "out": draw(0.3, 2 * HIDDEN), "bias": np.array([math.log(prior / (1 - prior))], np.float32),
    }


#: Learning rate of word vectors against that of the layers (a word is seen far less often than a gate), their first
#: scale, and how many documents a word must have for even odds of being taken as known in a batch.
WORD_RATE, WORD_SCALE, DOUBT = 6.0, 0.1, 1.0


def train(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 48, seed: int = 7, rate: float = 0.015) -> Network:
    """Network fitted to texts and their 0/1 labels. With one class only every score is that class's share.

    A third of each batch is toxic, and the bias is put right for the true share afterwards. Of a toxic document the
    highest window learns (at first often a random one), of any other the highest and a random one.
    """
    docs = [words_of(t) for t in texts]
    y = np.array([v for v, d in zip(labels, docs) if d], np.float32)
    docs = [d for d in docs if d]
    if not len(y) or y.min() == y.max():
        return Network({}, {}, float(np.mean(labels)) if labels else 0.0)
    rng = np.random.default_rng(seed)
    held = Counter()
    for d in docs:
        held.update(set(d))
    vocab = _known(held, 2)
    p = _initial(rng, len(vocab) + 1, 1 / 3)
    net, mean, var = Network(vocab, p), {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    every = sorted({w for d in docs for w in d})
    place = {w: i for i, w in enumerate(every)}
    numbers = [np.array([place[w] for w in d]) for d in docs]
    known, (pair, count) = np.array([vocab.get(w, 0) for w in every]), bigrams(every)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    unknown = DOUBT / (DOUBT + np.array([held[w] for w in every], np.float64))  # a word of few documents is often taken for an unknown one
    toxic, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    n_toxic = max(1, batch // 3)
    average, averaged = {k: np.zeros_like(v, np.float64) for k, v in p.items()}, 0
    queue = {0: np.zeros(0, np.int64), 1: np.zeros(0, np.int64)}

    def take(kind: int, n: int) -> np.ndarray:
        while len(queue[kind]) < n:
            queue[kind] = np.concatenate((queue[kind], rng.permutation(toxic if kind else clean)))
        out, queue[kind] = queue[kind][:n], queue[kind][n:]
        return out

    for step in range(1, steps + 1):
        chosen = np.concatenate((take(1, n_toxic), take(0, batch - n_toxic)))
        own = np.unique(np.concatenate([numbers[k] for k in chosen]))
        pairs = np.repeat(first[own] - np.concatenate(([0], np.cumsum(count[own])[:-1])), count[own]) + np.arange(count[own].sum())
        ids = np.where(rng.random(len(own)) < unknown[own], 0, known[own])
        inputs = net.vectors(ids, pair[pairs], count[own])
        gates = np.concatenate((np.zeros((2, 1, 3 * HIDDEN), np.float32), np.matmul(inputs[0][None], p["wx"]) + p["b"][:, None]), axis=1)
        cuts = [cut(np.searchsorted(own, numbers[k]) + 1) for k in chosen]
        logit, seen = net.window_logits(np.concatenate(cuts), gates), 0
        rows, told, weight = [], [], []
        for k, c in zip(chosen, cuts):
            best = int(logit[seen : seen + len(c)].argmax())
            seen += len(c)
            other = int(rng.integers(len(c)))
            if y[k]:
                rows.append(c[other if rng.random() < 0.5 * (1 - 3 * step / steps) else best])
                weight.append(1.0)
            else:
                rows += [c[best], c[other]]
                weight += [0.6, 0.4]
            told += [y[k]] * (len(rows) - len(told))
        grad = _train_step(net, np.array(rows), inputs, np.array(told, np.float32), np.array(weight, np.float32))
        now = rate * min(1, step / 20) * (1 - 0.95 * step / steps)
        for k in p:
            g = grad[k].astype(np.float32) + (1e-4 * p[k] if k in ("wx", "wh", "out", "att") else 0)
            mean[k] += 0.1 * (g - mean[k])
            var[k] += 0.01 * (g * g - var[k])
            p[k] -= (now * (WORD_RATE if k == "word" else 1) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if step > steps * 0.8:
            averaged += 1
            for k in p:
                average[k] += (p[k] - average[k]) / averaged
    net.p = {k: v.astype(np.float32) for k, v in average.items()}
    share, used = y.mean(), n_toxic / batch
    net.p["bias"] = net.p["bias"] + np.float32(math.log(share / (1 - share)) - math.log(used / (1 - used)))
    return net


# -- Spark ---------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Network:
    """Network trained on at most fit_docs labelled documents that are not held out (least hash of doc_id first)."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    slim = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") <= FIT_CHARS)
    rows = slim.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs plus score (double) as the last column; every row and column stays. Null and empty texts are empty windows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        claim_memory(own, own.forget)
        for b in pieces(batches):
            found = own.scores([t.as_py() or "" for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "score"])

    docs = docs.drop("score")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. Without labels of both classes, scores are constant."""
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
