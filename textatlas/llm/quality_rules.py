"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

The verdict compares two multinomials over hashed token unigrams and bigrams: one of trusted target documents, one of
the whole raw corpus. A document's score is the mean over its n-grams of ln(p_target / p_raw); it is kept if the score
is at least `threshold` (the mean makes it independent of length) and no base rule failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textatlas.llm.common import NOT_BLANK, let, words_of

#: Stands alone as a token of the n-gram model; other tokens are runs of non-blank characters between.
PUNCTUATION = r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"
SYMBOL = r"[#*$%&|<>]"


def _doubled(width: int):
    """From hashes of windows of `width` words to those of twice as many."""
    return lambda h: F.zip_with(
        F.slice(h, 1, F.size(h) - width), F.slice(h, width + 1, F.size(h) - width), lambda a, b: F.xxhash64(a, b)
    )


def _n_repeat_words(words: Column, window: int) -> Column:
    """Words inside `window`-word windows (a power of two) that occur at least twice in the same array."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    # window hashes by doubling: of 1, 2, 4 and 8 words
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:
        hashes, width = let(hashes, _doubled(width)), 2 * width
    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(found)


def base_counts(text: Column, window: int = 8) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long). Null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _n_repeat_words(w, window).alias("n_repeat_words"),
        ),
    )


def ngram_hashes(text: Column) -> Column:
    """Hashes of the token unigrams and bigrams of the lower-cased text; the last bigram ends in nothing."""
    tokens = words_of(F.regexp_replace(F.lower(text), PUNCTUATION, " $1 "))
    return let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: F.concat(h, F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))),
    )


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def likelihood_ratio(docs: DataFrame, trusted_ids: DataFrame, buckets: int = 16384, smoothing: float = 1.0) -> DataFrame:
    """One row: `ratio`, the array of ln(p_target / p_raw) by bucket.

    docs(doc_id, text) is the raw corpus, all of it. trusted_ids(doc_id) holds distinct ids, of a bounded number: it is
    broadcast. Without a trusted row every ratio is 0."""
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(trusted_ids.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left")
        .select(F.explode(ngram_hashes(F.col("text"))).alias("gram"), F.coalesce("trusted", F.lit(0)).alias("t"))
        .select(bucket_of(F.col("gram"), buckets).alias("bucket"), "t")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    # one row of `buckets` entries, however large the corpus
    listed = both.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"),
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
    )
    a = F.lit(smoothing)
    return listed.select(
        F.transform(
            "c",
            lambda x: F.when(F.col("n_target") == 0, F.lit(0.0)).otherwise(
                F.log((x["target"] + a) / (F.col("n_target") + a * buckets))
                - F.log((x["raw"] + a) / (F.col("n_raw") + a * buckets))
            ),
        ).alias("ratio")
    )


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    buckets: int = 16384,
    smoothing: float = 1.0,
    threshold: float = -0.15,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: a row per document.

    base_failed: fewer than `min_words` words, or over `max_repeat_percent` % of them in repeated 8-word windows.
    kept: not base_failed and score >= threshold. Null, empty and blank texts have no words and so fail. Repeated rows
    each get their row; a null doc_id is never trusted; other columns are ignored; an empty table gives no rows."""
    ratio = likelihood_ratio(docs, trusted_ids, buckets, smoothing).scalar()
    score = let(
        ngram_hashes(F.col("text")),
        lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
            F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(F.col("ratio"), bucket_of(b, buckets))) / F.size(g)
        ),
    )
    counted = docs.select("doc_id", "text", ratio.alias("ratio")).select(
        "doc_id", base_counts(F.col("text")).alias("c"), score.alias("score")
    )
    flat = counted.select(
        "doc_id", *[F.col(f"c.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "score"
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_sample(labels: DataFrame, held_out: Column, most: int = 50_000) -> DataFrame:
    """At most `most` distinct ids of documents labelled good that aren't held out, by hash of the id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
