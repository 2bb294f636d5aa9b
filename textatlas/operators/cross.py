"""Analytics across concepts and methods: co-occurrence, bridge topics, related concepts, layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textatlas.plans.sizing import with_every


def concept_cooccurrence(topic_terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """row_concept, col_concept, n: how many topics of the row concept hold the column concept's name as a term.

    topic_terms(concept, topic, term), concepts(concept). Names match as whole terms in lower case; the diagonal counts; pairs
    without a topic are 0."""
    names = concepts.select(F.col("concept").alias("col_concept"), F.lower("concept").alias("term")).distinct()
    terms = topic_terms.select(F.col("concept").alias("row_concept"), "topic", F.lower("term").alias("term")).distinct()
    found = terms.join(names, "term").groupBy("row_concept", "col_concept").agg(F.count_distinct("topic").alias("n"))
    every = concepts.select(F.col("concept").alias("row_concept")).distinct()
    grid = with_every(every, names, "col_concept")
    return grid.join(found, ["row_concept", "col_concept"], "left").select("row_concept", "col_concept", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def related_concepts(cooccurrence: DataFrame, k: int = 5) -> DataFrame:
    """concept, other, score, rank: up to k other concepts of the highest score above 0, ties by name."""
    rows = cooccurrence.where("row_concept <> col_concept and n > 0")
    w = W.partitionBy("row_concept").orderBy(F.desc("n"), "col_concept")
    ranked = rows.select(F.col("row_concept").alias("concept"), F.col("col_concept").alias("other"), F.col("n").alias("score"), F.row_number().over(w).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def _real_topics(topics: DataFrame) -> DataFrame:
    name = F.trim("topic_name")
    return topics.where(~F.lower(name).isin("gesamt", "total") & ~name.startswith("Kein Thema"))


def coherence_topics(topics: DataFrame, k: int = 6) -> DataFrame:
    """concept, kind (bridge or siloed), rank, topic_name, entropy, topic_total from topics(concept, topic_name, entropy,
    topic_total, n_subjects): bridge topics stand in two subjects or more, by falling entropy and total; siloed ones in
    one, by falling total; ties by name. Totals and the outlier bucket are left out."""
    real = _real_topics(topics).where(F.col("n_subjects") >= 1)
    kind = F.when(F.col("n_subjects") >= 2, "bridge").otherwise("siloed")
    kinds = real.withColumn("kind", kind).withColumn("e", F.when(F.col("kind") == "bridge", F.col("entropy")).otherwise(F.lit(0.0)))
    w = W.partitionBy("concept", "kind").orderBy(F.desc("e"), F.desc("topic_total"), "topic_name")
    return kinds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("concept", "kind", "rank", "topic_name", "entropy", "topic_total")


#: How many subjects and states there are.
SUBJECTS, STATES = 5, 16


def concept_coverage(records: DataFrame, topics: DataFrame, subjects: int = SUBJECTS, states: int = STATES) -> DataFrame:
    """concept, n_docs, n_outliers, n_subjects, n_subjects_total, n_states, n_states_total, n_topics: a row for each concept of
    records(concept, subject, state, is_outlier), with its topics of topics(concept, topic_name).

    Outliers count as documents and a missing subject or state as one of its own; totals and the outlier bucket are no
    topics. Records are counted by subject and state first, so what is counted distinct are a few combinations."""
    some = records.groupBy("concept", "subject", "state").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("o"))
    kinds = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("long"))
    counts = some.groupBy("concept").agg(
        F.sum("n").alias("n_docs"), F.sum("o").alias("n_outliers"),
        kinds("subject").alias("n_subjects"), F.lit(subjects).alias("n_subjects_total"),
        kinds("state").alias("n_states"), F.lit(states).alias("n_states_total"),
    )
    n_topics = _real_topics(topics).groupBy("concept").agg(F.count_distinct("topic_name").alias("n_topics"))
    return counts.join(n_topics, "concept", "left").withColumn("n_topics", F.coalesce("n_topics", F.lit(0)).cast("long"))


#: Steps and strengths of the layout.
STEPS, REPULSION, ATTRACTION = 300, 0.02, 0.02


def force_layout(weights: np.ndarray, steps: int = STEPS, repulsion: float = REPULSION, attraction: float = ATTRACTION) -> np.ndarray:
    """Positions (n, 2) of n concepts: from the unit circle, all repel each other by the square of their distance, edges
    attract by the share of their summed weights. A few dozen nodes."""
    n = len(weights)
    angle = 2 * np.pi * np.arange(n) / max(1, n)
    at = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    pull = attraction * (weights + weights.T) / (2 * max(1.0, weights.max(initial=0)))
    np.fill_diagonal(pull, 0)
    for _ in range(steps):
        gap = at[:, None, :] - at[None, :, :]
        square = np.maximum((gap**2).sum(axis=2), 0.001)
        at = at + (gap * (repulsion / square - pull)[:, :, None]).sum(axis=1)
    return at
