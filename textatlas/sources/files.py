"""File sources and sinks. Paths are whatever Spark can open; only archives are unpacked by the driver."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textatlas.functions.metadata import infer_state, infer_year
from textatlas.operators.kwic import parse_dictionary
from textatlas.operators.quality import require_columns

#: The match table; every column but the length is text, so "2024" stays "2024".
MATCHES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("search_term", "match_term", "text_excerpt")]
    + [T.StructField("excerpt_length", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("file", "state", "school type", "grade", "year", "subject")]
)
DOC_WORD_COUNTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file", "state", "school type", "grade", "year", "subject")]
    + [T.StructField("word_count", T.IntegerType())]
)
OVERVIEW = T.StructType([T.StructField(c, T.StringType()) for c in ("Bundesland", "Fach", "Schulart", "Jahr", "Gesamtwortanzahl", "Referenz", "Dateiname")])
RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("state", "subject", "grade_band", "topic")],
        T.StructField("is_outlier", T.BooleanType()),
        T.StructField("umap_2d", T.ArrayType(T.DoubleType())),
        T.StructField("umap_3d", T.ArrayType(T.DoubleType())),
        T.StructField("excerpt", T.StringType()),
    ]
)


def extract_zip(path: str, to: str | None = None) -> str:
    """Unpacks an archive of the driver's file system; by default next to it. Members outside the target are an error."""
    target = Path(to) if to else Path(path).parent
    target.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            if not (target / name).resolve().is_relative_to(target.resolve()):
                raise ValueError(f"member outside of the target: {name}")
        archive.extractall(target)
    return str(target)


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.txt", skip_dirs: tuple[str, ...] = ("test",)) -> DataFrame:
    """path, file, subject (the parent folder), text of the files below root whose names match; hidden files and those in a
    folder named in skip_dirs are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.replace(F.col("_metadata.file_path"), F.lit("%20"), F.lit(" "))
    out = raw.select(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    out = out.select("path", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("subject"), "text")
    return out.where(~F.col("file").startswith(".") & ~F.col("subject").isin(*skip_dirs))


def pages_to_documents(pages: DataFrame, doc: str, page: str, text: str, separator: str = "") -> DataFrame:
    """doc, text, n_pages: each document's pages in order, joined. A document's pages are as many as it has; ties by text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    grouped = pages.groupBy(doc).agg(listed.alias("x"))
    return grouped.select(doc, F.array_join(F.transform("x", lambda x: x["t"]), separator).alias("text"), F.size("x").alias("n_pages"))


def clip_box(width: float, height: float, margin: float = 72.0) -> tuple[float, float, float, float]:
    """The part of a page that is read: without a margin left and right if it is wider than high, else top and bottom."""
    return (margin, 0.0, width - margin, height) if width > height else (0.0, margin, width, height - margin)


def write_text_tree(docs: DataFrame, path: str, subject: str = "subject", text: str = "text") -> None:
    """Texts below one folder for each subject."""
    docs.select(F.col(text).alias("value"), F.col(subject).alias("subject")).write.partitionBy("subject").mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None, nullable: tuple[str, ...] = (), line_sep: str | None = None) -> DataFrame:
    """Quoted CSV with a header and a fixed schema: empty cells stay empty texts, cells may hold newlines.

    nullable: columns of texts where an empty cell is null, unless it is quoted, as write_csv() writes them. line_sep: found by the
    reader if None."""
    absent = f"absent-{uuid.uuid4().hex}"  # a mark that no cell holds
    ends = {"lineSep": line_sep} if line_sep else {}
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', nullValue=absent, emptyValue="", enforceSchema=False, **ends)
    df = df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name not in nullable else F.col(f"`{f.name}`") for f in schema])
    return require_columns(df, required or [])


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, nulls empty, empty texts quoted; blanks around a text stay. one_file is for results of a few rows."""
    (df.coalesce(1) if one_file else df).write.csv(path, header=True, quote='"', escape='"', mode="overwrite", nullValue="", emptyValue='""', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """lemma, lemma_ord, variant, variant_ord from a file of lines "lemma, variant, ..."; lines in their order."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return parse_dictionary(lines, "value", "at")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file that holds an array, with x, y (, z) columns from the coordinates; no rows for a missing file."""
    try:
        df = spark.read.schema(RECORD).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], RECORD)
        raise
    return df.select("*", F.get("umap_2d", 0).alias("x"), F.get("umap_2d", 1).alias("y"))


def write_records(records: DataFrame, path: str, by: str = "id") -> None:
    """JSON lines in order of `by`, a range of it in each file."""
    records.orderBy(by).write.mode("overwrite").json(path)


def read_json_map(spark: SparkSession, path: str) -> dict:
    """A small JSON object such as label overrides; {} where it is missing or invalid."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        return json.loads(rows[0][0]) if rows else {}
    except ValueError:
        return {}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def document_catalog(files: DataFrame, file: str = "file", subject: str = "subject", path: str = "path") -> DataFrame:
    """title, subject, state, year, path by path; the title is the name without its ending."""
    name = F.col(file)
    return files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.col(subject).alias("subject"),
        infer_state(name).alias("state"), infer_year(name).alias("year"), F.col(path).alias("path"),
    ).orderBy("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def mirror(spark: SparkSession, root: str, to: str, patterns: list[str]) -> list[str]:
    """Replaces the folder `to` by copies of the files below root that match glob patterns such as "out/*.csv", at their places
    below it. Returns the patterns that match nothing. One of the folders inside the other is an error. The driver copies a
    file at a time, as streams: this is for the results that a front end shows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs

    def opened(path: str):
        system = fs.Path(path).getFileSystem(conf)
        return system, system.makeQualified(fs.Path(path))

    (source, base), (target, out) = opened(root), opened(to)
    a, b = (f"{x.toString().rstrip('/')}/" for x in (base, out))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{root} and {to} overlap")
    found = {p: [s.getPath() for s in source.globStatus(fs.Path(base, p)) or [] if s.isFile()] for p in patterns}
    target.delete(out, True)
    for path in {p.toString(): p for paths in found.values() for p in paths}.values():
        at = fs.Path(out, path.toString()[len(a) :])
        target.mkdirs(at.getParent())
        fs.FileUtil.copy(source, path, target, at, False, True, conf)
    return [p for p, paths in found.items() if not paths]


def cached(spark: SparkSession, folder: str, parameters: dict, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of compute(), kept as Parquet under a name that depends on all parameters."""
    key = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    at = f"{folder.rstrip('/')}/{key}"
    if not force:
        try:
            return spark.read.parquet(at)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    compute().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces just the partitions that df has rows of; readers see a partition's old or new files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def not_done(work: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys aren't in the report yet."""
    return work.join(report.select(*keys).distinct(), keys, "left_anti")
