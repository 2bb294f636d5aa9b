"""Language identification by hierarchical discrimination.

Linear support vector machines, one for each family against the rest, choose the family; inside it, one-versus-one linear
support vector machines vote on the language. Features are hashed character 1- to 3-grams of the whole text.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textatlas.llm.common import remainder, small_batches

#: Language families by ISO 639-1 code; a language that isn't listed is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fo", "fy", "lb", "yi"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tk", "ky"],
    "semitic": ["ar", "he", "mt", "am"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "celtic": ["ga", "gd", "cy", "br"],
    "iranian": ["fa", "ku", "ps"],
    "austronesian": ["id", "ms", "tl", "jv"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

DIM = 1 << 13
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of the hashed 1-, 2- and 3-grams of letters, blanks between words; None without a letter."""
    if not text:
        return None
    counts = np.zeros((3, DIM), dtype=np.float64)
    letter, tail = _is_letter(), np.zeros(0, dtype=np.uint64)
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(letter[codes], codes, 32)
        codes = codes[(codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)].astype(np.uint64)
        codes = np.concatenate([tail, codes])
        gram = np.zeros(len(codes), dtype=np.uint64)
        for n in range(3):
            gram = (gram[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[n:]
            mixed = (gram * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 13)
            seen = mixed if not len(tail) else mixed[max(0, len(tail) - n) :]
            counts[n] += np.bincount(seen.astype(np.int64), minlength=DIM)
        tail = codes[-2:]
    if not np.any(counts[0] > 0) or not any(map(str.isalpha, text)):
        return None
    totals = counts.sum(axis=1, keepdims=True)
    return (np.sqrt(counts / np.maximum(totals, 1)).sum(axis=0) / np.sqrt(3)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights (dim + 1, the last the bias) of a linear SVM, y in -1, +1; class-balanced squared hinge loss, Adam."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], dtype=np.float64), 0.0
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            i = order[at : at + 64]
            slack = np.maximum(0, 1 - y[i] * (x[i] @ w + b)) * balance[i]
            g = -2 * (slack * y[i]) @ x[i] / len(i) + reg * w
            gb = -2 * float((slack * y[i]).mean())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= a * m / (np.sqrt(v) + 1e-8)
            b -= a * mb / (np.sqrt(vb) + 1e-8)
    return np.append(w, b).astype(np.float32)


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # a row for each family
    pair_w: dict[str, np.ndarray]  # a row for each pair of the family's languages, in the order of combinations()

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        share = odds / odds.sum(axis=1, keepdims=True)
        best = margins.argmax(axis=1)
        langs, scores = np.empty(len(x), dtype=object), share[np.arange(len(x)), best]
        for f, family in enumerate(self.families):
            rows, own = np.flatnonzero(best == f), self.members[family]
            if len(own) == 1:
                langs[rows] = own[0]
            elif len(rows):
                w = self.pair_w[family]
                p = 1 / (1 + np.exp(-4 * (x[rows] @ w[:, :-1].T + w[:, -1])))
                votes, belief = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
                for k, (i, j) in enumerate(combinations(range(len(own)), 2)):
                    for at, q in ((i, p[:, k]), (j, 1 - p[:, k])):
                        votes[:, at] += q > 0.5
                        belief[:, at] += q / (len(own) - 1)
                won = (votes + belief / 2).argmax(axis=1)
                langs[rows] = [own[i] for i in won]
                scores[rows] *= belief[np.arange(len(rows)), won]
        return list(langs), scores


def fit(x: np.ndarray, langs: list[str]) -> Model:
    y = np.array(langs, dtype=object)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(members)
    of = np.array([families.index(_FAMILY_OF.get(lang, lang)) for lang in langs])
    one = lambda: np.append(np.zeros(x.shape[1]), 1.0).astype(np.float32)
    family_w = [fit_svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else one() for f in range(len(families))]
    pair_w = {}
    for family, own in members.items():
        rows = []
        for a, b in combinations(own, 2):
            pick = (y == a) | (y == b)
            rows.append(fit_svm(x[pick], np.where(y[pick] == a, 1.0, -1.0)))
        if rows:
            pair_w[family] = np.stack(rows)
    return Model(families, members, np.stack(family_w) if families else np.zeros((0, DIM + 1)), pair_w)


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    """float32 bytes: an eighth of what a list of numbers takes in the driver's Python."""
    found = (features(t) for t in texts)
    return pd.Series([None if v is None else v.tobytes() for v in found], dtype=object)


def train(docs: DataFrame, allowed, most_per_lang: int = 400, most_chars: int = 20_000) -> Model:
    """Fits on a bounded sample: most_per_lang documents of a language, by hash of the id, of at most most_chars characters,
    among the rows where `allowed` holds and lang isn't null."""
    rows = small_batches(docs).where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= most_chars))
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[x for k, v in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, 2.0 * most_per_lang / v)))]) if n else None
    if not n:
        return fit(np.zeros((0, DIM), dtype=np.float32), [])
    key = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.withColumn("__key", key).where(F.col("__key") < share[F.col("lang")])
    first = W.partitionBy("lang").orderBy("__key", "doc_id")
    taken = thin.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most_per_lang)
    found = [(r[0], r[1]) for r in taken.select("lang", _features("text").alias("x")).collect() if r[1] is not None]
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in found), dtype=np.float32).reshape(-1, DIM)
    return fit(x, [r[0] for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `predicted`, a struct of lang_pred and score (0 to 1), for every row of docs(text, ...).

    A text that is null or has no letter is `und` with score 0; so is every text if the model was fitted on no rows. Ties
    go to the language first by name. A column named predicted would be replaced."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for at in range(0, len(texts), 512):
            x = [features(t) for t in texts.iloc[at : at + 512]]
            known = [v for v in x if v is not None]
            got = iter(zip(*model.predict(np.stack(known)))) if known else iter(())
            for v in x:
                lang, score = next(got) if v is not None else ("und", 0.0)
                langs.append(lang)
                scores.append(float(score))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return small_batches(docs).withColumn("predicted", predict("text"))


def language_id(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per document; learns from the rows that aren't held out."""
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out, **parameters)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "predicted.lang_pred", "predicted.score")
