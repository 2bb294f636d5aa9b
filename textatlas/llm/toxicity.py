"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own hashed embedding next to the mean of its hashed character trigrams' embeddings. A GRU in each
direction reads a window of words, attention pools its states, a logistic unit scores the window. Overlapping windows
cover the whole text; the document's score is that of its worst window, calibrated by a logistic curve.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textatlas.llm.common import remainder, small_batches
from textatlas.llm.sampling import sample_ids, texts_of

WINDOW, STRIDE = 32, 16
WORDS, GRAMS = 1 << 13, 1 << 13  # hashed embeddings
EMBED, HIDDEN, ATTEND = 12, 8, 8
_WORD = re.compile(r"[^\W_]+")
_BATCH_WORDS = 400_000  # words that are scored at once


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Vocabulary:
    """Hashed inputs of distinct words: the word's row, and its trigrams' rows, one word's after another's."""

    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> "Vocabulary":
        word = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        g = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ codes[2:]
        g = ((g * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 13)).astype(np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))  # trigrams of <word>: as many as letters
        first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return cls(word, g[inside], np.cumsum(size) - size)

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        sums = np.add.reduceat(p["grams"][self.gram], self.start, axis=0)
        size = np.diff(np.append(self.start, len(self.gram)))[:, None]
        return np.concatenate([p["words"][self.word], sums / size], axis=1).astype(p["words"].dtype)


def windows_of(n: int) -> list[int]:
    """First words of the windows over n words: every STRIDE words, until the end is covered."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [L, B, H] for input gates [L, B, 3H] (update, reset, candidate); where mask is 0 the state stays."""
    n = HIDDEN
    h = np.zeros((gates.shape[1], n), dtype=gates.dtype)
    out = np.empty((*gates.shape[:2], n), dtype=gates.dtype)
    for t in range(len(gates)):
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gates[t, :, 2 * n :] + r * hu[:, 2 * n :])
        a = mask[t][:, None] * (1 - z)
        if keep is not None:
            keep.append((h, z, r, c, hu[:, 2 * n :]))
        h = h + a * (c - h)
        out[t] = h
    return out


def _gru_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of u."""
    n = HIDDEN
    d_gates, d_u, dh = np.zeros((*d_out.shape[:2], 3 * n), dtype=d_out.dtype), np.zeros_like(u), 0
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, c, hc = kept[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        a = m * (1 - z)
        dz = -dh * m * (c - h) * z * (1 - z)
        dc = dh * a * (1 - c * c)
        dr = dc * hc * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dc], axis=1)
        d_hu = np.concatenate([dz, dr, dc * r], axis=1)
        d_u += h.T @ d_hu
        dh = dh * (1 - a) + d_hu @ u.T
    return d_gates, d_u


def new_parameters(seed: int = 0) -> dict[str, np.ndarray]:
    rng, d, h = np.random.default_rng(seed), 2 * EMBED, HIDDEN
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    p = {"words": normal(WORDS, EMBED, s=0.1), "grams": normal(GRAMS, EMBED, s=0.3)}
    for k in "fb":
        p |= {f"w_{k}": normal(d, 3 * h, s=1 / np.sqrt(d)), f"u_{k}": normal(h, 3 * h, s=1 / np.sqrt(h)), f"b_{k}": np.zeros(3 * h, dtype=np.float32)}
    p |= {"attend": normal(2 * h, ATTEND, s=1 / np.sqrt(2 * h)), "query": normal(ATTEND, s=0.5)}
    return p | {"out": normal(2 * h, s=0.3), "bias": np.full(1, -1.0, dtype=np.float32)}


def forward(p: dict[str, np.ndarray], gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: at [L, B] are rows of the words' gates (forward, backward), mask [L, B] is 1 on words."""
    kept: tuple = ([], []) if keep is not None else (None, None)
    f = _gru(gates[0][at], mask, p["u_f"], kept[0])
    b = _gru(gates[1][at[::-1]], mask[::-1], p["u_b"], kept[1])[::-1]
    states = np.concatenate([f, b], axis=2)
    a = np.tanh(states @ p["attend"])
    e = np.where(mask > 0, a @ p["query"], -30)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep.update(kept=kept, states=states, a=a, w=w, pooled=pooled)
    return pooled @ p["out"] + p["bias"][0]


def word_gates(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"]


def gradients(p: dict[str, np.ndarray], vocab: Vocabulary, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, keep_word: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss of windows; at holds rows of vocab. keep_word: 0 drops a word's own embedding."""
    x = vocab.inputs(p)
    x[:, :EMBED] *= keep_word
    keep: dict = {}
    z = forward(p, word_gates(p, x), at, mask, keep)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dz = ((_sigmoid(z) - y) * weight / weight.sum()).astype(np.float32)
    g["out"], g["bias"] = keep["pooled"].T @ dz, dz.sum(keepdims=True)
    d_pooled = np.outer(dz, p["out"])
    states, w, a = keep["states"], keep["w"], keep["a"]
    d_states = w[:, :, None] * d_pooled
    dw = (states * d_pooled).sum(axis=2)
    de = np.where(mask > 0, w * (dw - (w * dw).sum(axis=0)), 0)
    g["query"] = np.tensordot(de, a, axes=([0, 1], [0, 1]))
    da = de[:, :, None] * p["query"] * (1 - a * a)
    g["attend"] = np.tensordot(states, da, axes=([0, 1], [0, 1]))
    d_states = d_states + da @ p["attend"].T
    dx = np.zeros_like(x)
    for k, d_out, m, rows, kept in (
        ("f", d_states[:, :, :HIDDEN], mask, at, keep["kept"][0]),
        ("b", d_states[::-1, :, HIDDEN:], mask[::-1], at[::-1], keep["kept"][1]),
    ):
        d_gates, g[f"u_{k}"] = _gru_back(d_out, m, p[f"u_{k}"], kept)
        per_word = np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
        np.add.at(per_word, rows.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
        g[f"w_{k}"], g[f"b_{k}"] = x.T @ per_word, per_word.sum(axis=0)
        dx += per_word @ p[f"w_{k}"].T
    np.add.at(g["words"], vocab.word, dx[:, :EMBED] * keep_word)
    size = np.diff(np.append(vocab.start, len(vocab.gram)))
    np.add.at(g["grams"], vocab.gram, np.repeat(dx[:, EMBED:] / size[:, None], size, axis=0))
    return g


@dataclass
class Model:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    def document_logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text, -30 for a text without words."""
        out, batch, size = np.full(len(texts), -30.0), [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                batch.append((i, words))
                size += len(words)
            if size >= _BATCH_WORDS:
                self._score(batch, out)
                batch, size = [], 0
        if batch:
            self._score(batch, out)
        return out

    def _score(self, batch: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        known: dict[str, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for _, words in batch for w in words), dtype=np.int64)
        first, of, length, base = [], [], [], 0
        for i, words in batch:
            starts = windows_of(len(words))
            first += [base + s for s in starts]
            length += [min(WINDOW, len(words) - s) for s in starts]
            of += [i] * len(starts)
            base += len(words)
        gates = word_gates(self.p, Vocabulary.of(list(known)).inputs(self.p))
        first, length, of = np.array(first), np.array(length), np.array(of)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(first), 1024):
            s, n = first[at : at + 1024], length[at : at + 1024]
            mask = (steps < n).astype(np.float32)
            rows = flat[np.minimum(s + steps, len(flat) - 1)]
            z = forward(self.p, gates, rows, mask)
            np.maximum.at(out, of[at : at + 1024], z)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * self.document_logits(texts) + self.offset, -40, 40))


def calibration_fold(labels: np.ndarray, rng: np.random.Generator, share: float = 0.2, least: int = 10) -> np.ndarray:
    """A random share of each class; nothing of a class of fewer than `least` documents, which are all needed to learn from."""
    fold = np.zeros(len(labels), dtype=bool)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        if len(own) >= least:
            fold[rng.choice(own, int(share * len(own)), replace=False)] = True
    return fold


def fit(texts: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 256, per_epoch: int = 6000, seed: int = 0) -> Model:
    """Learns from documents, though it scores windows: at first every window of a document marked toxic counts as toxic,
    later the worst half of the document's, then its worst one; of the others, random windows and the worst one.

    Every text has a word, and there is one of either label."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    known: dict[str, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), dtype=np.int64)
    names = list(known)
    everything = Vocabulary.of(names)
    size = np.diff(np.append(everything.start, len(everything.gram)))
    first, length, of, base = [], [], [], 0
    for i, d in enumerate(docs):
        starts = windows_of(len(d))
        first += [base + s for s in starts]
        length += [min(WINDOW, len(d) - s) for s in starts]
        of += [i] * len(starts)
        base += len(d)
    first, length, of = np.array(first), np.array(length), np.array(of)
    fold = calibration_fold(labels, rng)
    y = labels[of].astype(np.float32)
    p, steps = new_parameters(seed), np.arange(WINDOW)[:, None]
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    usable = np.flatnonzero(~fold[of])

    def logits(which: np.ndarray) -> np.ndarray:
        gates = word_gates(p, everything.inputs(p))
        z = np.empty(len(which))
        for at in range(0, len(which), 1024):
            w = which[at : at + 1024]
            mask = (steps < length[w]).astype(np.float32)
            z[at : at + 1024] = forward(p, gates, flat[np.minimum(first[w] + steps, len(flat) - 1)], mask)
        return z

    for epoch in range(epochs):
        toxic, clean = usable[y[usable] == 1], usable[y[usable] == 0]
        if epoch >= 3:
            z = logits(usable)
            rank = np.empty(len(usable), dtype=np.int64)
            order = np.lexsort((-z, of[usable]))
            doc = of[usable][order]
            begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            rank[order] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            n_of = np.bincount(of[usable], minlength=len(docs))[of[usable]]
            worst = rank < np.where(epoch < 6, np.maximum(1, n_of // 2), 1)
            toxic = usable[(y[usable] == 1) & worst]
            hard = usable[(y[usable] == 0) & (rank == 0)]
            clean = np.concatenate([hard, clean])
        half = per_epoch // 2
        pick = np.concatenate([rng.choice(toxic, half), rng.choice(clean, half)])
        if epoch >= 3:
            pick[half + half // 2 :] = rng.choice(hard, half - half // 2)
        rng.shuffle(pick)
        for at in range(0, len(pick), batch):
            w = pick[at : at + batch]
            rows = flat[np.minimum(first[w] + steps, len(flat) - 1)]
            used, local = np.unique(rows, return_inverse=True)
            gram_rows = np.concatenate([np.arange(everything.start[i], everything.start[i] + size[i]) for i in used])
            own = Vocabulary(everything.word[used], everything.gram[gram_rows], np.cumsum(size[used]) - size[used])
            mask = (steps < length[w]).astype(np.float32)
            g = gradients(p, own, local.reshape(rows.shape), mask, y[w], np.ones(len(w), dtype=np.float32), (rng.random((len(used), 1)) < 0.5).astype(np.float32) * 2)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            t += 1
            rate = 0.01 * (0.3 if epoch > epochs - 4 else 1) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k in p:
                x = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] = (p[k] * (1 - 0.02 * rate) - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    model = Model(p)
    z = logits(np.arange(len(first)))
    worst = np.full(len(docs), -30.0)
    np.maximum.at(worst, of, z)
    check = fold & (worst > -30)
    model.slope, model.offset = calibrate(worst[check], labels[check])
    return model


def calibrate(z: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on z, drawn towards 1 and 0; damped Newton steps."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    x, w, start = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + ridge * ((w - start) ** 2).sum() / 2
    for _ in range(50):
        q = _sigmoid(np.clip(x @ w, -30, 30))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (q - y) + ridge * (w - start)), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
    return float(max(w[0], 1e-2)), float(w[1])


def extract(text: str | None, most_words: int, spans: int = 8) -> str | None:
    """The text's words; of one of over most_words, `spans` runs of words at even distances, of most_words in all. None without
    a word."""
    words = words_of(text)
    if len(words) > most_words:
        size = most_words // spans
        starts = [k * (len(words) - size) // (spans - 1) for k in range(spans)]
        words = [w for at in starts for w in words[at : at + size]]
    return " ".join(words) or None


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most_toxic: int = 1000, most_clean: int = 2000, most_words: int = 2048) -> Model | None:
    """Fits on a bounded sample of labelled documents, by hash of the id, where `allowed` (of doc_id) holds; documents of over
    most_words words take part by extract(). None if one of the classes is empty."""
    toxic = sample_ids(labels.where((F.col("toxic") == 1) & allowed), most_toxic, "toxic").withColumn("y", F.lit(1))
    clean = sample_ids(labels.where((F.col("toxic") == 0) & allowed), most_clean, "clean").withColumn("y", F.lit(0))
    cut = F.udf(lambda text: extract(text, most_words), "string", useArrow=True)
    rows = texts_of(small_batches(docs), toxic.unionByName(clean)).select("doc_id", "y", cut("text").alias("text")).collect()
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["doc_id"], r["y"]))
    y = np.array([r["y"] for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    return fit([r["text"] for r in rows], y)


def score_toxicity(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with a column score (0 to 1) for every row of docs(text, ...); an existing column of that name is replaced.

    Null texts and texts without words get the score 0, as do all texts without a model."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        has = np.array([bool(t) and _WORD.search(t) is not None for t in texts], dtype=bool)
        return pd.Series(np.where(has, model.scores(list(texts)), 0.0))

    return small_batches(docs).withColumn(column, score("text"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document; learns from rows that aren't held out.

    A null id counts as the empty text for held_out and gets its row; repeated rows each get theirs; an empty table gives
    no rows; other columns are ignored. For null and empty texts, and without labels, see score_toxicity."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs, labels, ~held_out, **parameters)
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
