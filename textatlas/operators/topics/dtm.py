"""Document-term tables in long form: (doc, term, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def document_terms(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """doc, term, n for docs(doc, tokens array). Null tokens and documents without tokens have no rows."""
    return docs.select(doc, F.explode(tokens).alias("term")).where(F.col("term").isNotNull()).groupBy(doc, "term").agg(F.count("*").alias("n"))


def prune(dtm: DataFrame, doc: str, n_docs: int, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None) -> DataFrame:
    """dtm without terms of too few or too many documents; a float is a share of n_docs, an int a number.

    max_features keeps the terms of the highest total, ties by term."""
    low = min_df * n_docs if isinstance(min_df, float) else min_df
    high = max_df * n_docs if isinstance(max_df, float) else max_df
    terms = dtm.groupBy("term").agg(F.count_distinct(doc).alias("df"), F.sum("n").alias("total"))
    terms = terms.where((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return dtm.join(terms.select("term"), "term").select(dtm.columns)


def adaptive_min_df(n_docs: int) -> int:
    """min_df of a topic sweep: at most 5, a twentieth of the documents for small corpora, at least 1."""
    return min(5, max(1, n_docs // 20))


def term_totals(dtm: DataFrame) -> DataFrame:
    return dtm.groupBy("term").agg(F.sum("n").alias("total"))


def corpus_stats(dtm: DataFrame, doc: str) -> DataFrame:
    """One row: n_documents (with a term), n_terms, n_tokens, avg_doc_length (1 place)."""
    out = dtm.agg(F.count_distinct(doc).alias("n_documents"), F.count_distinct("term").alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return out.withColumn("avg_doc_length", F.round(F.try_divide("n_tokens", "n_documents"), 1))


def class_tfidf(counts: DataFrame, group: str) -> DataFrame:
    """group, term, n, weight for counts(group, term, n): n / (sum of the class) * ln(1 + A / f), with A the mean number of
    tokens of a class, rounded down, and f the term's number over all classes."""
    classes = counts.groupBy(group).agg(F.sum("n").alias("class_total"))
    mean = classes.agg(F.floor(F.avg("class_total"))).scalar()
    freq = term_totals(counts)
    return (
        counts.join(freq, "term")
        .join(classes, group)
        .select(group, "term", "n", (F.col("n") / F.col("class_total") * F.log(1 + mean / F.col("total"))).alias("weight"))
    )


def top_terms(weights: DataFrame, group: str, k: int = 20, weight: str = "weight") -> DataFrame:
    """The k heaviest terms of each group with `rank` from 1; ties by term."""
    w = W.partitionBy(group).orderBy(F.desc(weight), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def side_by_side(top: DataFrame, group: str, groups: list, prefix: str = "Topic_") -> DataFrame:
    """rank and one column of terms per group."""
    wide = top.groupBy("rank").pivot(group, groups).agg(F.first("term"))
    return wide.select("rank", *[F.col(str(g)).alias(f"{prefix}{g}") for g in groups])
