"""Records, manifests and reports for a front end, as DataFrames; writers are in textatlas.sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concept_records(docs: DataFrame) -> DataFrame:
    """id, state, subject, grade_band, topic, is_outlier, umap_2d, umap_3d, excerpt from docs(doc_id, state, subject, grade_band,
    topic_id, topic_label, xy, xyz, text); coordinates to 4 places, a missing label is "Thema n"."""
    places = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: F.round(x, 4))
    return docs.select(
        F.col("doc_id").alias("id"), "state", "subject", "grade_band",
        F.coalesce("topic_label", F.concat(F.lit("Thema "), F.col("topic_id").cast("string"))).alias("topic"),
        (F.col("topic_id") == -1).alias("is_outlier"), places("xy").alias("umap_2d"), places("xyz").alias("umap_3d"), F.trim("text").alias("excerpt"),
    )


def counters(records: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, label, n, rank: how often each label of each column occurs, most common first, ties by label."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("label")) for c in columns])).alias("x"))
    counts = long.groupBy("x.dimension", "x.label").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), "label")))


def bounding_box(records: DataFrame, column: str, dims: int) -> DataFrame:
    """dim (from 0), low, high of an array column."""
    at = F.array(*[F.struct(F.lit(i).alias("dim"), F.get(column, i).cast("double").alias("x")) for i in range(dims)])
    return records.select(F.explode(at).alias("p")).groupBy("p.dim").agg(F.round(F.min("p.x"), 4).alias("low"), F.round(F.max("p.x"), 4).alias("high"))


def padded_range(records: DataFrame, column: str, dims: int, pad: float = 0.05) -> DataFrame:
    """dim, low, high with `pad` of the span added on both sides (of 1 if the span is 0)."""
    at = F.array(*[F.struct(F.lit(i).alias("dim"), F.get(column, i).cast("double").alias("x")) for i in range(dims)])
    box = records.select(F.explode(at).alias("p")).groupBy("p.dim").agg(F.min("p.x").alias("lo"), F.max("p.x").alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) * pad
    return box.select("dim", (F.col("lo") - span).alias("low"), (F.col("hi") + span).alias("high"))


def manifest_fragment(records: DataFrame, concept: str) -> DataFrame:
    """One row: concept, n_docs, n_outliers, subjects, states, topics (arrays of (label, n), most common first), bbox_2d, bbox_3d.

    The arrays are as long as there are labels."""
    head = records.agg(F.count("*").alias("n_docs"), F.count_if("is_outlier").alias("n_outliers"))
    listed = counters(records, ["subject", "state", "topic"])

    def labels(dimension: str):
        found = listed.where(F.col("dimension") == dimension).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "n"))).alias("x"))
        return found.select(F.transform("x", lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n")))).scalar()

    def box(column: str, dims: int):
        found = bounding_box(records, column, dims).agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("x"))
        return found.select(F.transform("x", lambda x: F.array(x["low"], x["high"]))).scalar()

    return head.select(
        F.lit(concept).alias("concept"), "*", labels("subject").alias("subjects"), labels("state").alias("states"), labels("topic").alias("topics"),
        box("umap_2d", 2).alias("bbox_2d"), box("umap_3d", 3).alias("bbox_3d"),
    )


def grade_band_counts(records: DataFrame, order: list[str]) -> DataFrame:
    """grade_band, n without outliers, and `place`: the given order first, other bands after it by name."""
    counts = records.where(~F.col("is_outlier")).groupBy(F.coalesce("grade_band", F.lit("?")).alias("grade_band")).agg(F.count("*").alias("n"))
    known = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("grade_band"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.when(known == 0, 1 << 20).otherwise(known), "grade_band")))


def report_lines(counts: DataFrame, label: str = "state", n: str = "count") -> DataFrame:
    """line, rank: "count  label" with the count to six places, most common first."""
    rank = F.row_number().over(W.orderBy(F.desc(n), label))
    return counts.select(F.concat(F.lpad(F.col(n).cast("string"), 6, " "), F.lit("  "), F.col(label)).alias("line"), rank.alias("rank"))


def subject_topic_summary(docs: DataFrame, subject: str, topic: str) -> DataFrame:
    """subject, place, line: for each subject a head, a rule and its topics by falling count."""
    some = docs.where(F.col(subject).isNotNull() & F.col(topic).isNotNull())
    counts = some.groupBy(subject, topic).agg(F.count("*").alias("n"))
    w = W.partitionBy(subject)
    ranked = counts.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), topic)) + 2).withColumn("all", F.sum("n").over(w))
    rows = ranked.select(subject, "place", F.concat(F.rpad(F.col("n").cast("string"), 8, " "), F.lit(" | "), F.col(topic)).alias("line"))
    head = ranked.groupBy(subject).agg(F.max("all").alias("n")).select(
        subject, F.explode(F.array(
            F.struct(F.lit(0).alias("place"), F.concat(F.col(subject), F.lit(" (n="), F.col("n").cast("string"), F.lit(")")).alias("line")),
            F.struct(F.lit(1).alias("place"), F.lit("count    | topic name").alias("line")),
            F.struct(F.lit(2).alias("place"), F.lit("-" * 50).alias("line")),
        )).alias("x"))
    return rows.unionByName(head.select(subject, "x.place", "x.line"))


def numbered(df: DataFrame, order: list[str], path: str, name: str = "id") -> DataFrame:
    """df with `name`, each row's place from 1 in the order of the columns, nulls first; rows alike in them in any order.

    Range-partitioned and sorted rows are written under `path`, a new folder that all executors share, and read again, so that
    every count is of the same parts; a part's first place is the sum of the parts before, a row a part."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("__part", F.shiftright("__m", 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(parts.select("__part", before.alias("__before"))), "__part")
    inside = F.col("__m") - F.shiftleft("__part", 33)
    return placed.select(*df.columns, (F.col("__before") + inside + 1).alias(name))
