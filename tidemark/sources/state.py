"""State between runs: hashes seen per size, archived rows never hashed, and source paths done.

As tables: seen (size, md5), pending (size, archived_path), processed (path); ``state_log`` keeps them. As a document: JSON
of versions 1 to 3; version 1 has hashes without sizes, which are dropped, and version 2 no pending entries.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config

_DOCUMENT = "version int, size_hashes map<string,array<string>>, size_pending map<string,array<string>>, processed_paths array<string>, saved_at string"
SEEN, PENDING, PROCESSED = "size bigint, md5 string", "size bigint, archived_path string", "path string"


@dataclass
class State:
    seen: DataFrame
    pending: DataFrame
    processed: DataFrame
    known_sizes: DataFrame  # sizes met before, with or without a hash

    def history(self) -> DataFrame:
        """Sizes whose rows must be hashed."""
        return self.known_sizes.select("size").union(self.pending.select("size")).distinct()


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], s) for s in (SEEN, PENDING, PROCESSED, "size bigint")))


def parse(documents: DataFrame, column: str = "value") -> State:
    """The state in a table of one JSON document; a missing or corrupt one gives an empty state."""
    doc = documents.select(F.from_json(F.col(column), _DOCUMENT).alias("d")).where("d is not null").select("d.*")
    sized = F.col("version").isin(2, config.STATE_VERSION)
    hashes = doc.where(sized).select(F.explode("size_hashes").alias("size", "m"))
    number = F.col("size").try_cast("bigint").alias("size")
    return State(
        hashes.select(number, F.explode("m").alias("md5")).where("size is not null").distinct(),
        doc.where(sized).select(F.explode("size_pending").alias("size", "p")).select(number, F.explode("p").alias("archived_path")).where("size is not null"),
        doc.select(F.explode("processed_paths").alias("path")).distinct(),
        hashes.select(number).where("size is not null").distinct(),
    )


def load(spark: SparkSession, target: str) -> State:
    """The state in the document of an archive's folder, as versions before the log kept it; read by the driver.

    Its name is one that Spark's readers take for a hidden file's, so a document in a store that only Spark reaches goes
    to ``parse`` under another name.
    """
    try:
        with open(os.path.join(target, config.STATE_FILENAME), encoding="utf-8") as f:
            return parse(spark.createDataFrame([(f.read(),)], "value string"))
    except FileNotFoundError:
        return empty(spark)


def pieces(state: State, now: datetime | None = None) -> Iterator[str]:
    """The document's text, piece by piece: sizes, hashes and paths sorted, sizes without pending entries left out.

    Rows are sorted by Spark and pass through the driver one partition at a time; nothing holds all of them.
    """

    def grouped(rows: Iterator) -> Iterator[str]:
        opened = None
        for size, value in rows:
            if size != opened:
                yield ("" if opened is None else "], ") + json.dumps(str(size)) + ": ["
                first, opened = True, size
            if value is not None:
                yield ("" if first else ", ") + json.dumps(value)
                first = False
        if opened is not None:
            yield "]"

    sizes = state.known_sizes.union(state.seen.select("size")).distinct().join(state.seen.distinct(), "size", "left")
    in_order = lambda df, *by: df.orderBy(*(F.col(c).cast("string") for c in by)).toLocalIterator()
    yield f'{{"version": {config.STATE_VERSION}, "size_hashes": {{'
    yield from grouped(in_order(sizes.select("size", "md5"), "size", "md5"))
    yield '}, "size_pending": {'
    yield from grouped(in_order(state.pending.select("size", "archived_path"), "size", "archived_path"))
    yield '}, "processed_paths": ['
    for k, row in enumerate(in_order(state.processed.distinct(), "path")):
        yield (", " if k else "") + json.dumps(row[0])
    yield f'], "saved_at": {json.dumps((now or datetime.now()).isoformat())}}}'


def save(state: State, target: str) -> None:
    """Write the document beside the archive's folders, for readers of that form: a temporary file first, then a rename over the old one."""
    os.makedirs(target, exist_ok=True)
    temporary = os.path.join(target, f".{uuid.uuid4().hex}.tmp")
    with open(temporary, "w", encoding="utf-8") as f:
        f.writelines(pieces(state))
    os.replace(temporary, os.path.join(target, config.STATE_FILENAME))
