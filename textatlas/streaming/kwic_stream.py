"""Keyword search over a folder of Parquet documents, each new file once. Stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textatlas.operators.kwic import find_terms


def stream_matches(spark: SparkSession, folder: str, schema, dictionary: DataFrame, to: str, checkpoint: str, **parameters) -> StreamingQuery:
    """Starts a query that appends the matches of all files not yet seen to the Parquet folder `to`, then ends.

    A batch writes to a folder of its own, so one that is run again replaces its rows instead of doubling them."""

    def search(batch: DataFrame, batch_id: int) -> None:
        find_terms(batch, dictionary, **parameters).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
