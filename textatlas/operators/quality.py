"""Checks and repairs of data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.functions.text import stripped_letters

#: Terms that were read in a wrong encoding.
MOJIBAKE = {"RationalitÃ¤t": "Rationalität", "EudÃ¤monia": "Eudämonia"}
#: Words whose letters must survive somewhere in a German corpus.
EXPECTED_WORDS = [
    "Ausreißer", "Schülerinnen", "Zusammenhänge", "Bedürfnis", "Bedürfnisse", "Gefühl", "Gefühle", "Rationalität", "Glück",
    "Länder", "Änderung", "für", "über", "können", "müssen", "größer", "natürlich", "Fähigkeit", "Übung", "Verhältnis",
    "während", "Auswärtige", "Prüfung",
]


def repair_terms(df: DataFrame, column: str = "search_term", mapping: dict[str, str] | None = None) -> DataFrame:
    """Replaces whole values; others stay."""
    return df.replace(MOJIBAKE if mapping is None else mapping, subset=[column])


def stripped_letter_audit(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, letter: letters that cleaning deletes, for documents that have any."""
    return docs.select(doc, F.explode(stripped_letters(F.col(text))).alias("letter"))


def missing_words(docs: DataFrame, spark: SparkSession, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """word: those of the expected words that no text holds anywhere, also inside words. One pass, a flag for each word."""
    words = EXPECTED_WORDS if words is None else words
    seen = docs.agg(*[F.coalesce(F.bool_or(F.col(text).contains(w)), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)])
    flags = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("seen")) for i, w in enumerate(words)])
    return seen.select(F.explode(flags).alias("x")).where(~F.col("x.seen")).select("x.word")


def undecodable(files: DataFrame) -> DataFrame:
    """path of files(path, content) that aren't valid UTF-8."""
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text isn't null or blank."""
    return df.where(F.trim(text) != "")
