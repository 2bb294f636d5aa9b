"""Quality classifier by positive-unlabelled learning: the least non-negative unbiased risk.

Trusted positives and unlabelled web text are all it learns from; the class prior is estimated. Features don't depend on
the language: shares of kinds of characters and words, repetition, and hashed trigrams of character shapes.

The loss is the squared one, (1 - y f)^2 / 4, and f is linear in the features, so the risks depend on the unlabelled rows
through their second moments alone. These are sums, taken over every unlabelled document where it lies; no sample of them
is drawn, and what comes to the driver has the size of a matrix of the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textatlas.llm.common import drop, remainder, small_batches, staged
from textatlas.llm.sampling import sample_ids, texts_of

SHAPES = 256
DENSE = 14
_CHUNK = 1 << 20
_shape: list[np.ndarray] = []


def _shape_of() -> np.ndarray:
    """Shape of each character of the basic plane: lower-case letter, upper-case letter, digit, blank, newline, or itself."""
    if not _shape:
        t = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            k = chr(c)
            t[c] = 10 if k == "\n" else 32 if k.isspace() else 48 if k.isdigit() else 65 if k.isupper() else 97 if k.isalpha() else c
        _shape.append(t)
    return _shape[0]


def features(text: str | None) -> np.ndarray:
    out = np.zeros(DENSE + SHAPES, dtype=np.float32)
    if not text:
        return out
    table, grams, kinds = _shape_of(), np.zeros(SHAPES), np.zeros(6)
    for at in range(0, len(text), _CHUNK):
        s = table[np.minimum(np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0xFFFF)].astype(np.uint64)
        kinds += [(s == 97).sum(), (s == 65).sum(), (s == 48).sum(), (s == 32).sum(), (s == 10).sum(), len(s)]
        if len(s) > 2:
            g = (s[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ s[1:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ s[2:]
            grams += np.bincount(((g * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.int64), minlength=SHAPES)
    words = text.split()
    n = len(words)
    if n:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        _, times = np.unique(h, return_counts=True)
        r = h
        for k in (1, 2, 3):
            r = r[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[k:] if len(r) > 1 else r[:0]
        again = 1 - len(np.unique(r)) / len(r) if len(r) else 0.0
        out[5:12] = [
            np.log1p(n) / 8, (h[1:] == h[:-1]).mean() if n > 1 else 0.0, again, len(times) / n, times.max() / n,
            kinds[:3].sum() / n / 10, len(times) / n * np.log1p(n) / 8,
        ]
        lines = [x for x in text.split("\n") if x.strip()]
        out[12:14] = [1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 8]
    total = max(1.0, kinds[5])
    out[:4] = kinds[:4] / total
    out[4] = 1 - kinds[:5].sum() / total
    out[DENSE:] = np.sqrt(grams / max(1.0, grams.sum()))
    return out


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, words: float = 8.0) -> np.ndarray:
    """Features less their mean over their scale, drawn towards 0 for short texts, as if `words` average words were added:
    shares in a text of a few words say little."""
    n = np.expm1(8 * x[:, 5:6])
    return (x - mean) / scale * (n / (n + words))


def inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, most: float = 4.0) -> np.ndarray:
    """1 and the standard features, cut at `most`: what f is linear in."""
    return np.concatenate([np.ones((len(x), 1)), np.clip(standard(x, mean, scale), -most, most)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return inputs(x, self.mean, self.scale) @ self.w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(4 * self.logits(x), -40, 40)))


def risk(w: np.ndarray, moments: np.ndarray, y: int) -> float:
    """Mean of (1 - y f)^2 / 4 over rows of the given second moments (of inputs(), whose first is 1)."""
    return float(1 - 2 * y * moments[0] @ w + w @ moments @ w) / 4


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-2) -> np.ndarray:
    """The w of least non-negative PU risk (Kiryo et al., 2017): prior * R_p+ + max(0, R_u- - prior * R_p-), and ridge |w|^2 / 4.

    pos and unl: second moments. max(0, r) is the largest t * r of 0 <= t <= 1, and for a given t the least risk has a
    closed form. With t = 1 it is the unbiased estimator; if that has r < 0, t is lowered until r is 0."""
    eye = ridge * np.eye(len(pos))

    def least(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * pos + t * unl + eye, prior * (1 + t) * pos[0] - t * unl[0])

    negative = lambda w: risk(w, unl, -1) - prior * risk(w, pos, -1)
    w = least(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        t = (low + high) / 2
        low, high = (t, high) if negative(least(t)) >= 0 else (low, t)
    return least(low)


def prior_of(positive: np.ndarray, above: np.ndarray, n: int, at: np.ndarray) -> float:
    """Class prior: the least ratio of the unlabelled to the positive share above any of the thresholds `at` of a score
    bounds it (best bin estimation: the threshold is the one of the least upper confidence bound, else the least of many
    noisy ratios would be too low). positive: scores; above, n: the unlabelled rows at or over each threshold, and all."""
    noise = np.sqrt(np.log(40) / (2 * n)) + np.sqrt(np.log(40) / (2 * len(positive)))
    shares = [(a / n, max((positive >= t).mean(), 1e-9)) for a, t in zip(above, at)]
    best = min((u + noise) / q for u, q in shares)
    return float(np.clip(next(u / q for u, q in shares if (u + noise) / q == best), 0.05, 0.98))


def second_moments(z: np.ndarray) -> np.ndarray:
    return z.T @ z / max(1, len(z))


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).tobytes() for t in texts], dtype=object)


def _rows(found: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(found), dtype=np.float32).reshape(-1, DENSE + SHAPES).astype(np.float64)


def unlabelled_moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums of the inputs' products over rows(half, x), for each half: an array [2, d, d], whose [h, 0, 0] is the number of rows.

    A task gives one such array, and they are added up in a tree."""
    d = DENSE + SHAPES + 1

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d, d))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                z, half = inputs(_rows(part["x"]), mean, scale), part["half"].to_numpy()
                for h in (0, 1):
                    total[h] += z[half == h].T @ z[half == h]
        yield pd.DataFrame({"total": [total.tobytes()]})

    sums = rows.mapInPandas(summed, "total binary").rdd
    return sums.treeAggregate(np.zeros((2, d, d)), lambda a, r: a + np.frombuffer(r[0]).reshape(2, d, d), lambda a, b: a + b, 3)


def counts_above(rows: DataFrame, model: Model, at: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of rows(x) score at least each threshold, and how many there are."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(at) + 1, dtype=np.int64)
        for batch in batches:
            f = model.logits(_rows(batch["x"]))
            total += np.append((f[:, None] >= at).sum(axis=0), len(f))
        yield pd.DataFrame({"i": np.arange(len(total)), "n": total})

    got = rows.mapInPandas(counted, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = dict(got)
    return np.array([total.get(i, 0) for i in range(len(at))]), total.get(len(at), 0)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most_positive: int = 3000) -> Model | None:
    """Fits on at most most_positive documents labelled 1 in `quality`, by hash of the id, and on every document, whose label
    isn't looked at; both among rows where `allowed` (of doc_id) holds and the text isn't null.

    Of labelled rows alike in doc_id the least text counts. None without a row of either kind in both halves."""
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int").alias("half")
    ids = sample_ids(labels.where((F.col("quality") == 1) & allowed), most_positive, "positive")
    known = texts_of(small_batches(docs), ids).select("doc_id", half, _features("text").alias("x")).collect()
    known.sort(key=lambda r: r["doc_id"])
    if {r["half"] for r in known} != {0, 1}:
        return None
    pos, side = _rows(pd.Series([bytes(r["x"]) for r in known])), np.array([r["half"] for r in known])
    mean, scale = pos.mean(axis=0), pos.std(axis=0) + 0.05
    rows = staged(docs.where(allowed & F.col("text").isNotNull()).select(half, _features("text").alias("x")), "features")
    sums = unlabelled_moments(rows, mean, scale)
    n = sums[:, 0, 0]
    if not n.all():
        return None
    z = inputs(pos, mean, scale)
    ridge = 0.01 + 16 / len(pos)  # as that many rows, so that few positives don't decide alone
    first = Model(mean, scale, fit_nnpu(second_moments(z[side == 0]), sums[0] / n[0], 0.5, ridge), 0.5)
    scores = first.logits(pos[side == 1])
    at = np.quantile(scores, np.linspace(0.02, 0.7, 35))
    prior = prior_of(scores, *counts_above(rows.where("half = 1"), first, at), at)
    drop(rows)
    return Model(mean, scale, fit_nnpu(second_moments(z), sums.sum(axis=0) / n.sum(), prior, ridge), prior)


def score_quality(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with a column score (0 to 1) for every row of docs(text, ...); an existing column of that name is replaced.

    Null and empty texts count as texts without words and get the score 0. Without a model every score is 0.5."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            part = texts.iloc[at : at + 512]
            got = np.full(len(part), 0.5) if model is None else model.scores(np.stack([features(t) for t in part]))
            out[at : at + 512] = np.where([bool(t and t.strip()) for t in part], got, 0.0 if model is not None else 0.5)
        return pd.Series(out)

    return small_batches(docs).withColumn(column, score("text"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document; learns from rows that aren't held out.

    A null id counts as the empty text for held_out and gets its row; repeated rows each get theirs; an empty table gives
    no rows; other columns are ignored. For null and empty texts, and without labels, see score_quality."""
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs, labels, ~held_out, **parameters)
    found = score_quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
