import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from textatlas.llm import quality_rules as q

BLANK = "[\x20\x09-\x0d]+"


def base_by_hand(text):
    text = text or ""
    words = [w for w in re.split(BLANK, text) if w]
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams_by_hand(text, buckets):
    """Bucket of each token unigram and bigram, as xxhash64 chains them."""
    low = re.sub(r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r" \1 ", (text or "").lower())
    hashes = [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in re.split(BLANK, low) if t]
    longs = lambda x, seed: xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()
    pairs = [longs(b, longs(a, 42)) for a, b in zip(hashes, hashes[1:])] + [longs(h, 42) for h in hashes[-1:]]
    return [signed(h) % buckets for h in hashes + pairs]


def texts(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["x*", "|", "Ab.", "größe"]
    return [(i, rnd.choice([" ", "\n", " \n"]).join(rnd.choice(words[: rnd.choice([2, 8, 16])]) for _ in range(rnd.choice([0, 5, 9, 30, 90])))) for i in range(n)]


def test_base_counts(make_docs, odd_rows):
    rows = texts(60) + [(i if i is None else 1000 + i, t) for i, t, *_ in odd_rows] + [(2000, " ".join("abcdefgh" * 2)), (2001, " ".join("abcdefgh")), (2002, "a " * 40)]
    out = make_docs(rows).select("text", q.base_counts(F.col("text")).alias("c")).collect()
    for r in out:
        assert tuple(r.c) == base_by_hand(r.text), r.text[:80] if r.text else r.text


def test_scores_match_brute_force(spark, make_docs):
    rows, buckets = texts(50, 1), 64
    good = {i for i, _ in rows if i % 3 == 0}
    raw, target = [0] * buckets, [0] * buckets
    for i, t in rows:
        for b in grams_by_hand(t, buckets):
            raw[b] += 1
            target[b] += i in good
    ratio = [math.log((t + 1) / (sum(target) + buckets)) - math.log((r + 1) / (sum(raw) + buckets)) for t, r in zip(target, raw)]
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    out = q.quality_rules(make_docs(rows, clashing=True), trusted, buckets=buckets, threshold=0.01).collect()
    assert len(out) == len(rows)
    for r in out:
        g = grams_by_hand(dict(rows)[r.doc_id], buckets)
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert r.score == pytest.approx(want, abs=1e-9)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= 0.01)


def test_no_trusted_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert q.quality_rules(make_docs([]), none).count() == 0
    out = q.quality_rules(make_docs([(1, " ".join(f"w{i}" for i in range(30))), (2, None)]), none).orderBy("doc_id").collect()
    assert [(r.score, r.kept) for r in out] == [(0.0, True), (0.0, False)]


def test_trusted_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, 1, 0), (None, 1, 0), (60, None, 0)], "doc_id long, quality int, toxic int")
    ids = [r[0] for r in q.trusted_sample(labels, F.col("doc_id") == 3, 10).collect()]
    assert len(ids) == len(set(ids)) == 10 and all(i % 2 for i in ids) and 3 not in ids


def test_plan_is_native(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    plan = q.quality_rules(docs, q.trusted_sample(labels, F.lit(False)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
