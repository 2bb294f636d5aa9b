"""Embedding clusters: projection, clustering with an outlier bucket, merging down to a ceiling, labels.

Topic -1 holds the outliers. Clustering is by density (topics.density), or k-means with a distance rule where the number of
clusters is given. The projection is linear, so results agree in form, not number by number.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textatlas.functions.text import title_case
from textatlas.operators.matrix import top_per_group
from textatlas.operators.topics.density import cluster_density

#: Most topics of a production run, with the outliers; label of the outliers.
CEILING = 31
OUTLIER_LABEL = "Kein Thema (Ausreißer)"


def embed_texts(docs: DataFrame, tokens: str, dim: int = 1 << 12, out: str = "embedding") -> DataFrame:
    """docs and `out`, unit-length hashed TF-IDF vectors as arrays: a stand-in for a sentence encoder, deterministic."""
    tf = HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=dim).transform(docs)
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(tf).transform(tf)
    unit = Normalizer(inputCol="__idf", outputCol="__unit").transform(idf)
    return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__tf", "__idf", "__unit")


def project(points: DataFrame, vector: str, k: int, out: str, places: int = 4, seed: int = 42) -> DataFrame:
    """points and `out`, the first k principal components (array of doubles); of k + 1 points or fewer, small jitter."""
    few = points.limit(k + 2).count()
    if few <= k + 1:
        return points.withColumn(out, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda _: F.round(F.randn(seed) * 0.1, places)))
    vectors = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    done = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors).transform(vectors)
    return done.withColumn(out, F.transform(vector_to_array("__p"), lambda x: F.round(x, places))).drop("__v", "__p")


def min_cluster_size(n_docs: int) -> int:
    return max(3, n_docs // 15) if n_docs < 200 else 15


def cluster(points: DataFrame, vector: str, k: int, outlier_share: float = 0.05, min_size: int = 2, seed: int = 42) -> DataFrame:
    """points and topic (int from 0 by falling size, -1 for outliers): k-means, where the outlier_share of points farthest
    from their centres (approximate quantile) and clusters below min_size are outliers."""
    vectors = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    done = model.transform(vectors).drop("__v")
    gap = F.aggregate(
        F.zip_with(F.col(vector).cast("array<double>"), F.get(centres, F.col("__c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    done = done.withColumn("__gap", gap)
    far = done.agg(F.percentile_approx("__gap", 1 - outlier_share, 10_000)).scalar()
    marked = done.withColumn("__c", F.when(F.col("__gap") > far, -1).otherwise(F.col("__c"))).drop("__gap")
    sizes = marked.where("__c >= 0").groupBy("__c").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    ranked = sizes.orderBy(F.desc("n"), "__c").select("__c").collect()  # at most k rows
    topic = F.lit(-1)
    for i, r in enumerate(ranked):
        topic = F.when(F.col("__c") == r[0], i).otherwise(topic)
    return marked.withColumn("topic", topic.cast("int")).drop("__c")


def density_topics(points: DataFrame, vector: str, min_size: int, dims: int = 5, seed: int = 42) -> DataFrame:
    """points and topic: clusters by density, which sets the number of topics and of outliers, in the first `dims` principal
    components (fewer for vectors or tables that have less)."""
    length = points.select(F.max(F.size(vector))).first()[0] or 0
    if length <= dims:
        return cluster_density(points, vector, min_size)
    placed = project(points, vector, dims, "__xyz", places=9, seed=seed)
    return cluster_density(placed, "__xyz", min_size).drop("__xyz")


def merge_topics(weights: dict[int, dict[str, float]], sizes: dict[int, int], ceiling: int = CEILING) -> dict[int, int]:
    """old -> new topic ids so that at most `ceiling` topics are left, the outliers counted if there are any: the smallest
    topic goes to the one of most similar (cosine) term weights, again and again. Never splits. A few dozen topics."""
    real = {t: dict(w) for t, w in weights.items() if t != -1}
    size, to = dict(sizes), {t: t for t in sizes}
    most = ceiling - (1 if -1 in sizes else 0)
    norm = lambda w: float(np.sqrt(sum(x * x for x in w.values()))) or 1.0
    while len(real) > max(1, most):
        small = min(real, key=lambda t: (size[t], -t))
        near = max((t for t in real if t != small), key=lambda t: (sum(real[small].get(k, 0) * x for k, x in real[t].items()) / norm(real[t]) / norm(real[small]), -t))
        n = size[near] + size[small]
        for term, x in real.pop(small).items():
            real[near][term] = real[near].get(term, 0.0) * size[near] / n + x * size[small] / n
        size[near] = n
        to = {t: near if v == small else v for t, v in to.items()}
    order = {t: i for i, t in enumerate(sorted(real, key=lambda t: (-size[t], t)))}
    return {t: order.get(v, -1) for t, v in to.items()}


def topic_labels(topics: DataFrame, top: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """topic, label: of topics(topic), by override(topic, label), else the three heaviest terms of top(topic, term, rank) in
    title case, else "Thema n"; the outliers' own label."""
    named = top.where((F.col("rank") <= 3) & (F.trim("term") != "")).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: title_case(x["term"])), " · ").alias("auto")
    )
    out = topics.select("topic").distinct().join(named, "topic", "left")
    out = out.join(overrides.select("topic", F.col("label").alias("own")), "topic", "left") if overrides is not None else out.withColumn("own", F.lit(None).cast("string"))
    fallback = F.when(F.col("topic") == -1, OUTLIER_LABEL).otherwise(F.coalesce("auto", F.concat(F.lit("Thema "), F.col("topic").cast("string"))))
    return out.select("topic", F.coalesce(F.nullif("own", F.lit("")), fallback).alias("label"))


def topic_info(assigned: DataFrame, top: DataFrame, doc: str, n_docs: int = 3) -> DataFrame:
    """topic, count, proportion, name (id and four terms), representation (terms), representative (the n_docs least ids)."""
    n = assigned.agg(F.count("*")).scalar()
    counts = assigned.groupBy("topic").agg(F.count("*").alias("count"))
    least = top_per_group(assigned.select("topic", doc), ["topic"], [F.col(doc)], n_docs).groupBy("topic").agg(F.array_sort(F.collect_list(doc)).alias("representative"))
    terms = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("representation"))
    out = counts.join(terms, "topic", "left").join(least, "topic", "left")
    name = F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.slice("representation", 1, 4), "_"))
    return out.select("topic", "count", (F.col("count") / n).alias("proportion"), name.alias("name"), "representation", "representative")
