"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.llm import decontaminate, line_dedup, mixing, near_dedup, pu_quality
from textatlas.llm.common import n_staged, remainder, staged_alone, table

QUALITY_THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    scored = pu_quality.score_quality(docs, model, "__score")
    return scored.where(F.col("__score") >= QUALITY_THRESHOLD).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first place; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five-word shingles stays."""
    return near_dedup.dedup(docs).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; adds mix_epoch and mix_words."""
    return mixing.materialise(docs, mixing.mix(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
]

#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; what a stage staged goes once its rows are written.

    A null id is an id like any other, but never one that a label or a smaller id stands for; repeated rows are documents
    of their own up to near-dedup; null and empty texts are rejected by the quality classifier, if there are labels to learn
    from. An empty table gives no rows. Other columns pass through all stages."""
    docs, before = table(spark, sf_dir, "documents"), n_staged()
    for name, stage in STAGES:
        docs = staged_alone(stage(spark, docs, sf_dir), name.replace(" ", "-"), before)
    return docs
