"""Whole analyses: keyword search, topic models by concept, sweeps. A failing concept is logged and the others go on."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.functions.stopwords import base_stopwords
from textatlas.functions.text import content_focused, lda_words, topic_tokens, with_bigrams, word_count
from textatlas.operators import export, kwic, matrix
from textatlas.operators.quality import drop_blank, require_columns
from textatlas.operators.topics import clusters, dtm, lda, scores
from textatlas.sources.files import not_done, write_partition

log = logging.getLogger("textatlas")


@dataclass
class KeywordSearch:
    matches: DataFrame
    word_counts: DataFrame
    term_counts: DataFrame
    state_subject: DataFrame


def term_counts(matches: DataFrame, dictionary: DataFrame) -> DataFrame:
    """concept, n: matches of every concept of the dictionary, 0 for those without, most first."""
    counts = matches.groupBy(F.col("search_term").alias("concept")).agg(F.count("*").alias("n"))
    every = dictionary.select(F.col("lemma").alias("concept")).distinct()
    return every.join(counts, "concept", "left").select("concept", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "concept")


def keyword_search(docs: DataFrame, dictionary: DataFrame, context: int = kwic.CONTEXT_WORDS) -> KeywordSearch:
    """From docs(file, state, subject, text): matches, words of each document, counts, and documents by state and subject."""
    require_columns(docs, ["file", "state", "subject", "text"])
    matches = kwic.find_terms(docs, dictionary, context)
    counts = docs.select("file", "state", "subject", word_count(F.col("text")).alias("word_count"))
    crossed = matrix.crosstab(matches, "state", "subject", ["file", "state", "subject"])
    return KeywordSearch(matches, counts, term_counts(matches, dictionary), crossed)


@dataclass
class RunConfig:
    """Parameters of an embedding-topic run; nr_topics of 0 or less leaves the number of topics open. n_clusters: of k-means, in
    place of clusters by density."""

    concepts: list[str] | None = None
    nr_topics: int = clusters.CEILING
    n_clusters: int | None = None
    top_n: int = 20
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    dry_run: bool = False
    seed: int = 42


def topic_run(excerpts: DataFrame, config: RunConfig) -> dict[str, dict[str, DataFrame]]:
    """Per concept of excerpts(concept, doc_id, text, embedding, state, subject, grade_band): topics, top terms, labels,
    distributions, records and the manifest fragment. Unknown concepts are logged and give empty results; one that fails
    is logged and left out."""
    excerpts = drop_blank(require_columns(excerpts, ["concept", "doc_id", "text", "embedding", "state", "subject", "grade_band"]), "text")
    known = {r[0]: r[1] for r in excerpts.groupBy("concept").count().collect()}
    wanted = config.concepts or sorted(known)
    for c in wanted:
        if c not in known:
            log.warning("unknown concept: %s", c)
    if config.dry_run:
        return {c: {"n_docs": excerpts.where(F.col("concept") == c).groupBy("concept").count()} for c in wanted}
    out = {}
    for c in wanted:
        try:
            if known.get(c):
                out[c] = _one_concept(excerpts.where(F.col("concept") == c), c, config)
        except Exception:
            log.exception("concept failed: %s", c)
    return out


def merged(points: DataFrame, counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """points(topic) and counts(topic, term, n) with at most `most` topics, the outliers counted, by merge_topics()."""
    sizes = {r[0]: r[1] for r in points.groupBy("topic").count().collect()}
    top = dtm.top_terms(dtm.class_tfidf(counts, "topic"), "topic", 200)
    weights: dict[int, dict[str, float]] = {t: {} for t in sizes}
    for r in top.select("topic", "term", "weight").collect():  # 200 terms of a few dozen topics
        weights[r[0]][r[1]] = r[2]
    to = clusters.merge_topics(weights, sizes, most)
    new = F.create_map(*[F.lit(x) for p in to.items() for x in p])[F.col("topic")]
    return points.withColumn("topic", new), counts.withColumn("topic", new).groupBy("topic", "term").agg(F.sum("n").alias("n"))


def embedding_terms_at_k(points: DataFrame, counts: DataFrame, k: int, top_n: int = 10) -> DataFrame:
    """topic, term, rank: the top_n terms of each topic, the outliers' left out, after merging down to k topics, the outliers
    counted. Of points(topic) and counts(topic, term, n), which stay as they are if they have no more; so one clustering
    serves every k."""
    _, fewer = merged(points, counts, k)
    top = dtm.top_terms(dtm.class_tfidf(fewer, "topic"), "topic", top_n)
    return top.where((F.col("topic") != -1) & (F.trim("term") != "")).select("topic", "term", "rank")


def lda_terms_at_k(docs: DataFrame, k: int, top_n: int = 10, epochs: int = 20, vocabulary: int | None = 5000) -> DataFrame:
    """topic, term, rank: the top_n terms of each of k topics, fitted anew on docs(doc_id, tokens), with the sweep's min_df."""
    fitted = lda.fit_lda(docs, "doc_id", "tokens", k, dtm.adaptive_min_df(docs.count()), epochs=epochs, vocabulary=vocabulary)
    try:
        top = dtm.top_terms(fitted.topic_terms().withColumnRenamed("topic_id", "topic"), "topic", top_n)
        return top.where(F.trim("term") != "").select("topic", "term", "rank")
    finally:
        fitted.release()


def terms_at(docs: DataFrame, k: int, top_n: int = 10, epochs: int = 20, n_clusters: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Topics(topic, term) of docs(doc_id, text, embedding) by both methods: what sweep() compares."""
    tokens = docs.select("doc_id", lda_words(F.col("text"), base_stopwords()).alias("tokens"))
    points, counts = clustered(docs, n_clusters, seed)
    return {"embedding": embedding_terms_at_k(points, counts, k, top_n), "lda": lda_terms_at_k(tokens, k, top_n, epochs)}


def clustered(docs: DataFrame, n_clusters: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """docs with topic, and counts(topic, term, n) of their tokens and pairs of tokens. By density if n_clusters is None."""
    least = clusters.min_cluster_size(n := docs.count())
    if n_clusters is None:
        points = clusters.density_topics(docs, "embedding", least, seed=seed)
    else:
        points = clusters.cluster(docs, "embedding", max(2, min(n_clusters, n // least)), min_size=least, seed=seed)
    tokens = points.select("topic", F.explode(with_bigrams(topic_tokens(F.col("text"), base_stopwords()))).alias("term"))
    return points, tokens.groupBy("topic", "term").agg(F.count("*").alias("n"))


def content_context(docs: DataFrame, strip_terms: list[str], top: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of texts without boilerplate terms, and the topics found in it, for docs(concept, text, topic).

    1. concept, n_docs, raw_words, kept_words, percent (of the words that go), n_topics, outlier_percent, without the outliers
    among the topics. 2. concept, rank, topic, n, terms: the eight largest topics, ties by topic, with their first five
    terms of top(concept, topic, term, rank), if given."""
    kept = docs.select("concept", "topic", word_count(F.col("text")).alias("a"), word_count(content_focused(F.col("text"), strip_terms)).alias("b"))
    out = kept.groupBy("concept").agg(
        F.count("*").alias("n_docs"), F.sum("a").alias("raw_words"), F.sum("b").alias("kept_words"),
        F.count_distinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("n_topics"), F.count_if(F.col("topic") == -1).alias("out"),
    )
    percent = F.coalesce(F.round(100 * F.try_divide(F.col("raw_words") - F.col("kept_words"), F.col("raw_words")), 1), F.lit(0.0))
    summary = out.select("concept", "n_docs", "raw_words", "kept_words", percent.alias("percent"), "n_topics", F.round(100 * F.col("out") / F.col("n_docs"), 1).alias("outlier_percent"))
    sizes = docs.where("topic <> -1").groupBy("concept", "topic").agg(F.count("*").alias("n"))
    largest = matrix.top_per_group(sizes, ["concept"], [F.desc("n"), F.col("topic")], 8)
    if top is not None:
        five = top.where("rank <= 5").groupBy("concept", "topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
        largest = largest.join(five.select("concept", "topic", F.transform("t", lambda x: x["term"]).alias("terms")), ["concept", "topic"], "left")
    return summary, largest


def _one_concept(docs: DataFrame, concept: str, config: RunConfig) -> dict[str, DataFrame]:
    spark = docs.sparkSession
    points, counts = clustered(docs, config.n_clusters, config.seed)
    if config.nr_topics > 0:
        points, counts = merged(points, counts, config.nr_topics)
    top = dtm.top_terms(dtm.class_tfidf(counts, "topic"), "topic", config.top_n)
    own = [(int(t), label) for t, label in config.overrides.get(concept, {}).items()]
    labels = clusters.topic_labels(points, top, spark.createDataFrame(own, "topic int, label string") if own else None)
    placed = clusters.project(clusters.project(points, "embedding", 2, "xy"), "embedding", 3, "xyz")
    named = placed.join(labels, "topic", "left").withColumnsRenamed({"label": "topic_label", "topic": "topic_id"})
    records = export.concept_records(named)
    return {
        "topics": points.select("doc_id", "topic"),
        "top_terms": top,
        "labels": labels,
        "info": clusters.topic_info(points, top, "doc_id"),
        "topics_over_subjects": matrix.distribution(records, "topic", "subject"),
        "subjects_over_topics": matrix.distribution(records, "subject", "topic"),
        "records": records,
        "manifest": export.manifest_fragment(records, concept),
    }


def lda_run(excerpts: DataFrame, concept: str, k_values: tuple[int, ...] = lda.K_VALUES, min_df: float = 5, stopwords: list[str] | None = None, epochs: int = 20) -> dict[int, dict[str, DataFrame]]:
    """Per number of topics: terms, documents' topics and summaries of excerpts(doc_id, text, subject). Words are prepared once."""
    stop = base_stopwords() if stopwords is None else stopwords
    docs = excerpts.select("doc_id", "subject", lda_words(F.col("text"), stop).alias("tokens")).persist()
    totals = dtm.term_totals(dtm.document_terms(docs, "doc_id", "tokens"))
    out = {}
    for k in k_values:
        fitted = lda.fit_lda(docs, "doc_id", "tokens", k, min_df, epochs=epochs)
        terms, topics = fitted.topic_terms(), fitted.doc_topics()
        dominant = lda.dominant_topics(topics, "doc_id")
        out[k] = {
            "terms": lda.topic_term_table(terms, totals),
            "matrix": lda.term_matrix(terms, totals),
            "relevance": lda.relevance_table(terms, totals),
            "dominant": dominant,
            "by_subject": lda.topics_by_subject(dominant.join(docs.select("doc_id", "subject"), "doc_id"), "subject", k),
            "coordinates": lda.topic_coordinates(terms),
            "global": fitted.global_summary(),
            "summary": lda.topic_summary(terms, topics, "doc_id"),
        }
    return out


def sweep(excerpts: DataFrame, concepts: list[str], k_values: tuple[int, ...], path: str, terms_at: Callable[[DataFrame, int], dict[str, DataFrame]] = terms_at, resume: bool = True) -> DataFrame:
    """concept, k, method, n_topics, coherence, agreement, kept in one partition a concept; concepts in the report are skipped.

    terms_at(docs, k) gives topics(topic, term) by method. A concept that fails is logged, and tried again on the next run."""
    spark: SparkSession = excerpts.sparkSession
    work = spark.createDataFrame([(c,) for c in concepts], "concept string")
    if resume:
        try:
            work = not_done(work, spark.read.parquet(path), ["concept"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    for (concept,) in work.orderBy("concept").collect():
        try:
            docs = excerpts.where(F.col("concept") == concept)
            tokens = docs.select("doc_id", topic_tokens(F.col("text"), base_stopwords()).alias("tokens"))
            rows = []
            for k in k_values:
                found = terms_at(docs, k)
                agreed = scores.agreement(*list(found.values())[:2]) if len(found) > 1 else None
                for method, terms in found.items():
                    c = scores.coherence_cv(tokens, "doc_id", "tokens", terms).agg(F.avg("coherence")).first()[0]
                    rows.append((concept, k, method, terms.select("topic").distinct().count(), c, agreed))
            write_partition(spark.createDataFrame(rows, "concept string, k int, method string, n_topics long, coherence double, agreement double"), path, ["concept"])
        except Exception:
            log.exception("concept failed: %s", concept)
    return spark.read.parquet(path)
