"""Bounded, repeatable samples of labelled rows, for fitting classifiers. Everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """At most `most` distinct non-null doc_id of rows, by salted hash."""
    ids = rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ids, a bounded table that is broadcast, and text: of each id in docs, whole. Of rows alike in doc_id
    the least text counts, so the result is no longer than ids; null texts don't count."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return rows.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))
