"""Coherence of topics and agreement of methods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textatlas.plans.sizing import local_if_small

EPS = 1e-12


def window_counts(docs: DataFrame, doc: str, tokens: str, topics: DataFrame, window: int = 110, block: int = 1024) -> DataFrame:
    """topic, a, b, n: in how many sliding windows of docs(doc, tokens) the terms a and b of topics(topic, term) both stand,
    a = b included; pairs without one have no row. A text of up to `window` tokens is one window.

    Only topic terms' places leave a text. A place lies in the windows that start from `window` - 1 before it up to it; places
    of a term that are at most `window` apart make one stretch of starts. The starts are cut into blocks, in a block the
    ends of the stretches part it into runs of windows with the same terms, and a run counts as often as it is long. So a
    group has at most block / window + 2 stretches of a term, however long the text and however frequent the term."""
    topics = local_if_small(topics.select("topic", "term").distinct())
    places = docs.select(doc, F.size(tokens).alias("n"), F.posexplode(tokens).alias("at", "term"))
    hits = places.join(local_if_small(topics.select("term").distinct()), "term")
    far = lambda a, b: F.coalesce(b - a > window, F.lit(True))
    own = hits.groupBy(doc, "n", "term").agg(F.array_sort(F.collect_list("at")).alias("at"))
    firsts = F.filter("at", lambda x, i: far(F.get("at", i - 1), x))
    ends = F.filter("at", lambda x, i: far(x, F.get("at", i + 1)))
    stretches = own.select(doc, "n", "term", F.explode(F.arrays_zip(firsts.alias("first"), ends.alias("end"))).alias("s"))
    low, high = F.greatest(F.col("s.first") - (window - 1), F.lit(0)), F.least(F.col("s.end"), F.greatest(F.col("n") - window, F.lit(0)))
    parted = stretches.select(doc, "term", low.alias("low"), high.alias("high")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block)))
    )
    within = parted.join(topics, "term")
    cut = F.struct(F.greatest("low", F.col("block") * block).alias("low"), F.least("high", F.col("block") * block + block - 1).alias("high"), F.col("term").alias("term"))
    own = within.groupBy(doc, "topic", "block").agg(F.collect_list(cut).alias("x"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("x", lambda x: x["low"]), F.transform("x", lambda x: x["high"] + 1))))
    own = own.select("topic", "x", ends.alias("e"))
    runs = own.select("topic", "x", "e", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("i"))
    start = F.get("e", F.col("i"))
    terms = F.array_distinct(F.transform(F.filter("x", lambda x: (x["low"] <= start) & (x["high"] >= start)), lambda x: x["term"]))
    sets = runs.select("topic", F.array_sort(terms).alias("t"), (F.get("e", F.col("i") + 1) - start).alias("long")).where(F.size("t") > 0)
    sets = sets.groupBy("topic", "t").agg(F.sum("long").alias("long"))  # before the pairs: the same few terms meet again and again
    pairs = sets.select("topic", "t", "long", F.explode("t").alias("a")).select("topic", "long", "a", F.explode("t").alias("b"))
    return pairs.groupBy("topic", "a", "b").agg(F.sum("long").alias("n"))


def coherence_cv(docs: DataFrame, doc: str, tokens: str, topics: DataFrame, window: int = 110) -> DataFrame:
    """topic, coherence for topics(topic, term), a bounded number of terms each: c_v over boolean sliding windows.

    A word's vector holds its normalised pointwise mutual information with each word of its topic; the coherence is the
    mean cosine of the words' vectors with their sum. Words that never occur are left out of a topic."""
    joint = local_if_small(window_counts(docs, doc, tokens, topics, window))
    total = docs.select(F.greatest(F.size(tokens) - window + 1, F.lit(1)).alias("k")).agg(F.sum("k")).scalar()
    single = joint.where("a = b")
    left = single.select("topic", "a", F.col("n").alias("n_a"))
    right = single.select("topic", "b", F.col("n").alias("n_b"))
    grid = left.join(right, "topic").join(joint.withColumnRenamed("n", "n_ab"), ["topic", "a", "b"], "left")
    p = F.coalesce("n_ab", F.lit(0)) / total
    npmi = F.log((p + EPS) / (F.col("n_a") / total * F.col("n_b") / total)) / -F.log(p + EPS)
    vectors = grid.select("topic", "a", "b", npmi.alias("x"))
    sums = vectors.groupBy("topic", "b").agg(F.sum("x").alias("y"))
    both = vectors.join(sums, ["topic", "b"])
    cosine = F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))))
    return both.groupBy("topic", "a").agg(cosine.alias("c")).groupBy("topic").agg(F.avg("c").alias("coherence"))


def topic_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """topic_a, topic_b, jaccard of the term sets of a(topic, term) and b(topic, term): every pair that shares a term."""
    a, b = a.select("topic", "term").distinct(), b.select("topic", "term").distinct()
    size_a = a.groupBy("topic").agg(F.count("*").alias("n_a")).withColumnRenamed("topic", "topic_a")
    size_b = b.groupBy("topic").agg(F.count("*").alias("n_b")).withColumnRenamed("topic", "topic_b")
    both = a.withColumnRenamed("topic", "topic_a").join(b.withColumnRenamed("topic", "topic_b"), "term").groupBy("topic_a", "topic_b").agg(F.count("*").alias("n"))
    out = both.join(size_a, "topic_a").join(size_b, "topic_b")
    return out.select("topic_a", "topic_b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, one for each row or column of the shorter side (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, gap, last = row, 0.0, -1
        while True:
            reach = gap + cost[at] - u[at] - v
            better = ~done & (reach < dist)
            dist[better], back[better] = reach[better], last
            j = int(np.where(done, np.inf, dist).argmin())
            gap, done[j], last = dist[j], True, j
            if match[j] < 0:
                break
            at = match[j]
        used = np.flatnonzero(done & (np.arange(m) != j))
        u[row] += gap
        for c in used:
            u[match[c]] += gap - dist[c]
            v[c] -= gap - dist[c]
        while True:
            before = back[j]
            match[j] = row if before < 0 else match[before]
            if before < 0:
                break
            j = before
    return sorted((int(r), c) for c, r in enumerate(match) if r >= 0)


def agreement(a: DataFrame, b: DataFrame) -> float | None:
    """Mean Jaccard of the best one-to-one match of the topics of a and b; None if either has none. A few dozen topics."""
    left = sorted(r[0] for r in a.select("topic").distinct().collect())
    right = sorted(r[0] for r in b.select("topic").distinct().collect())
    if not left or not right:
        return None
    score = np.zeros((len(left), len(right)))
    for r in topic_jaccard(a, b).collect():
        score[left.index(r["topic_a"]), right.index(r["topic_b"])] = r["jaccard"]
    return float(np.mean([score[i, j] for i, j in assignment(1 - score)]))
