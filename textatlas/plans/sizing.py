"""Broadcasts only behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_every(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """A row of df for each distinct non-null value of `column` in values, which has to be a list of categories: it is
    one array, so that no join without a key is needed."""
    return df.withColumn(column, F.explode(values.agg(F.array_sort(F.collect_set(column))).scalar()))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a small table that is one split would else keep one
    core busy. A large table has more splits than cores and stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows (counted up to that); else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def local_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df's rows as a local table with a broadcast hint, computed once, if there are at most most_rows of them (the driver takes
    one more to tell); else df, which each reader computes again. For tables of topics and terms that are read several times."""
    rows = df.limit(most_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= most_rows else df
