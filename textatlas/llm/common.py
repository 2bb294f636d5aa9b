"""Shared helpers of the training-data operators: table access, staging in the shared folder, let-binding."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of the blanks between words, and of everything else.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

_STAGED: list[tuple[SparkSession, str]] = []
_PATH: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textatlas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors.

    The files go by drop(), or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.register(drop_staged)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATH[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in tables:
        path = _PATH.pop(df)
        _STAGED.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def drop_staged(kept: int = 0) -> None:
    """Deletes staged tables, but for the first `kept`."""
    while len(_STAGED) > kept:
        spark, path = _STAGED.pop()
        try:
            _delete(spark, path)
        except Exception:  # the application may have ended already
            pass


def staged_alone(df: DataFrame, name: str, kept: int) -> DataFrame:
    """staged(), after which the tables that were staged since the first `kept` go: df has read them."""
    out = staged(df, name)
    own = _STAGED.pop()
    drop_staged(kept)
    _STAGED.append(own)
    return out


def n_staged() -> int:
    return len(_STAGED)


def dealt(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame]:
    """rows with `part`, and (by, parts) for the values of `by` on over `most` rows: such a value's rows are dealt over that
    many parts, by hash; all others are part 0. The second has fewer rows than the first by the factor `most`, and is broadcast."""
    large = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = F.broadcast(large.select(by, F.ceil(F.col("n") / most).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(large, by, "left").withColumn("part", part).drop("parts"), large


def copied(rows: DataFrame, by: str, large: DataFrame) -> DataFrame:
    """rows with `part`, a copy of a row for each part of its value of `by`: what dealt() rows are joined with."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return rows.join(large, by, "left").withColumn("part", F.explode(parts)).drop("parts")


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches take at most BATCH_BYTES: whole texts go to Python, where a batch takes several times
    its size. A lower setting stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, evaluated once even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of non-blank characters; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
