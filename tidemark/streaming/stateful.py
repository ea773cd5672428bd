"""Size-first deduplication of a stream, with what is known of each size as state.

The state of a size is the md5 values that were met with the place of each one's first row, and the ledger: a row that was let
through without a hash, because its size was new. Once the size recurs, that row is hashed after all (filled in), from its
digest or by the hasher if its content is still there, and leaves the ledger. Spark keeps both in its checkpoint, so a
query that is started again goes on where it was, and a batch that is repeated starts from the state before it.

Rows of one size meet in one task, as light rows: content is never part of them. What a task sorts is one size's rows of one
micro-batch, which the source's options bound; the md5 values of a size stay in the state store and are asked one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidemark.functions.hashing import md5_of
from tidemark.tables import fresh

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY, _FIRST = "md5 string", "ord string"
_PENDING = "ord string, path string, digest string"


class _BySize(StatefulProcessor):
    """One size's rows, in order: hashed only if the size recurs, duplicates if their md5 was met before."""

    def __init__(self, ord_col: str, path_col: str | None, digest_col: str | None, names: list[str], hasher: Callable[[str], str | None] | None):
        self.ord, self.path, self.digest, self.names, self.hasher = ord_col, path_col, digest_col, names, hasher

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", _PENDING)
        self.hashes = handle.getMapState("hashes", _KEY, _FIRST)

    def _md5(self, path: str | None, digest: str | None) -> str | None:
        return self.hasher(path) if self.hasher is not None else digest

    def _values(self, row: Any) -> tuple[str, str | None, str | None]:
        return str(row[self.ord]), row[self.path] if self.path else None, row[self.digest] if self.digest else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: r[self.ord])
        told, width = Row(*self.names, "md5", "hash_status", "is_duplicate"), len(self.names)
        if len(batch) == 1 and not self.pending.exists() and not self.hashes.exists():
            self.pending.update(self._values(batch[0]))
            yield told(*batch[0][:width], None, "not_needed", False)
            return
        if self.pending.exists():
            where, path, digest = self.pending.get()
            if (md5 := self._md5(path, digest)) is not None:
                self.hashes.updateValue((md5,), (where,))
            self.pending.clear()
        for row in batch:
            where, path, digest = self._values(row)
            md5 = self._md5(path, digest)
            seen = md5 is not None and self.hashes.containsKey((md5,))
            if md5 is not None and not seen:
                self.hashes.updateValue((md5,), (where,))
            yield told(*row[:width], md5, "failed" if md5 is None else "ok", seen)

    def close(self) -> None:
        pass


def dedup_by_size(stream: DataFrame, ord_col: str, size_col: str = "size", content: Column | None = None, path_col: str | None = None, hasher: Callable[[str], str | None] | None = None) -> DataFrame:
    """The stream's rows with md5, hash_status (not_needed, ok, failed) and is_duplicate, append mode.

    Give ``content``, whose digest is taken in the scan, or ``path_col`` and ``hasher``, which is called for rows that must be
    hashed alone. Order is that of the batches, and within a batch that of ``ord_col``. A row whose size is null is hashed, and
    is no duplicate, as no size tells what to compare it with. The session's state store becomes RocksDB, which this needs.
    """
    if (content is None) == (hasher is None) or (hasher is not None and path_col is None):
        raise ValueError("give content, or a path column and a hasher")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names, kinds = stream.columns, list(stream.schema.fields)
    digest = fresh("digest", stream)
    light = stream.withColumn(digest, md5_of(content)) if content is not None else stream
    told = StructType([*kinds, StructField("md5", StringType()), StructField("hash_status", StringType()), StructField("is_duplicate", BooleanType())])
    sized = light.where(F.col(size_col).isNotNull()).groupBy(size_col)
    judged = sized.transformWithState(_BySize(ord_col, path_col, digest if content is not None else None, names, hasher), told, "Append", "None")
    value = F.col(digest) if content is not None else F.udf(hasher, "string")(F.col(path_col))
    rest = light.where(F.col(size_col).isNull()).select(*names, value.alias("md5"))
    rest = rest.select(*names, "md5", F.when(F.col("md5").isNull(), "failed").otherwise("ok").alias("hash_status"), F.lit(False).alias("is_duplicate"))
    return judged.union(rest)


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """size, ord, path of the rows that a query let through unhashed, from the checkpoint that it committed last."""
    held = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    return held.select("key.*", "value.ord", "value.path")


def known_hashes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """size, md5 and first (the place of its first row), from the checkpoint that a query committed last."""
    held = spark.read.format("statestore").option("stateVarName", "hashes").load(checkpoint)
    return held.select("key.*", F.col("user_map_key.md5").alias("md5"), F.col("user_map_value.ord").alias("first"))
