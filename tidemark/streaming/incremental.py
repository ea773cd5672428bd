"""Deduplication of a stream of items against all that came before.

Each micro-batch runs the batch plan against the state of earlier batches. What a batch adds is written as a partition
of its own, named by the batch, and a batch reads only partitions of smaller numbers: a batch that is repeated after a
failure sees the same state and writes the same partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.exact import first_wins
from tidemark.functions.hashing import md5_of

_SEEN = "size bigint, md5 string, batch bigint"


def _seen(spark, folder: str, batch: int) -> DataFrame:
    try:
        known = spark.read.schema(_SEEN).parquet(folder)
        known.head()
    except Exception as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], _SEEN)
    return known.where(F.col("batch") < batch)


def dedup_batch(rows: DataFrame, batch: int, folder: str, content: Column, ord_col: str) -> DataFrame:
    """rows with size, md5 and is_duplicate against the batch and all earlier ones; the batch's new hashes are written."""
    hashed = rows.withColumns({"size": F.octet_length(content.cast("binary")).cast("bigint"), "md5": md5_of(content)})
    out = first_wins(hashed, _seen(rows.sparkSession, folder, batch).select("size", "md5"), ord_col=ord_col)
    fresh = out.where("not is_duplicate and md5 is not null").select("size", "md5", F.lit(batch).cast("bigint").alias("batch"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
    return out


def dedup_stream(stream: DataFrame, folder: str, content: Column, ord_col: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives every micro-batch's rows, with is_duplicate, to ``sink``; start it with a checkpoint location."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            sink(dedup_batch(rows, batch, folder, content, ord_col), batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each)
