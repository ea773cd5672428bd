"""Product quantisation of vectors with integer codebooks.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of entries. A round
broadcasts the codebooks (parts * entries * width numbers, whatever the input); each task assigns its Arrow batches'
parts to their nearest entries by norm expansion over exact integer matrix products, the first of equal distances, and
adds up members and components per entry. These sums are merged by one grouped shuffle, and the driver gets one row per
number of the codebooks. All sums are integers, so results depend neither on partitions nor on tasks that are repeated.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .knn import finite, matrix, products
from .shared import Scratch

#: Integers beyond this bound are refused: up to it, a squared distance over 32 components stays within 63 bits.
LIMIT = 1 << 28
#: Parts that meet the entries at a time.
ROWS = 4096


@dataclass
class Codebooks:
    """Entries as an array (part, entry, position); ``scale`` is what components were multiplied with."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        """sha256 of all numbers, by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _parts(column: pa.Array, books: np.ndarray) -> np.ndarray:
    """Vectors as (row, part, position), shorter ones filled with zeros."""
    x = matrix(column)
    parts, _, width = books.shape
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest entry and the squared distance to it."""
    near, far, own = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), (book * book).sum(1)
    for k in range(0, len(x), ROWS):
        part = x[k : k + ROWS]
        d = (part * part).sum(1)[:, None] - 2 * products(part, book) + own[None, :]
        near[k : k + ROWS] = d.argmin(1)
        far[k : k + ROWS] = d.min(1)
    return near, far


def _summer(shared):
    """mapInArrow function: vectors -> cell, total; a cell is a position of an entry, and one more for its members."""

    def add_up(batches):
        books = shared.value
        parts, entries, width = books.shape
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _parts(batch.column(0), books)
            for p in range(parts):
                near, _ = nearest(x[:, p], books[p])
                totals[p, :, width] += np.bincount(near, minlength=entries)
                for c in range(width):  # exact: a batch's sums stay below 2^53
                    totals[p, :, c] += np.bincount(near, x[:, p, c], entries).astype(np.int64)
        used = np.repeat(totals[:, :, width].ravel() > 0, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(totals.ravel()[used])], ["cell", "total"])

    return add_up


def learn(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks from all vectors without null or non-finite components, after ``rounds`` rounds.

    They start as the parts of the ``entries`` vectors of the smallest ids (null ids last, equal ids by vector; fewer
    vectors give fewer entries). Vectors count as filled with zeros up to the longest one's length, and that to a
    multiple of ``parts``. A component of 2^28 or more after scaling is refused with an error. No vector gives no entry.
    """
    spark, held, seen = vectors.sparkSession, Scratch(vectors.sparkSession, "codebooks"), Observation()
    kept = vectors.where(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), _integers(F.col(vec_col), scale).alias("v"))
    rows = held.keep(kept.observe(seen, F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")), "integers")
    if max(seen.get["most"] or 0, -(seen.get["least"] or 0)) >= LIMIT:
        raise ValueError(f"a component beyond {LIMIT / scale} cannot be coded in exact 64-bit distances")
    width = -(-max(1, seen.get["width"] or 0) // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()  # at most ``entries`` rows
    books = np.ascontiguousarray(_parts(first, np.zeros((parts, 0, width))).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("v").mapInArrow(_summer(spark.sparkContext.broadcast(books)), "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
        totals = np.zeros((parts, len(first), width + 1), np.int64)
        totals.reshape(-1)[sums["cell"].to_numpy()] = sums["total"].to_numpy()
        members = totals[:, :, width:]
        books = np.where(members > 0, totals[:, :, :width] // np.maximum(members, 1), books)
    held.drop("integers")
    return Codebooks(books, scale)


def _coder(shared):
    def code(column: pa.Array) -> pa.Array:
        books = shared.value
        x = _parts(column, books)
        parts, entries, _ = books.shape
        digits = max(2, len(f"{entries - 1:x}"))
        table = np.array([list(f"{k:0{digits}x}".encode()) for k in range(entries)], np.uint8)
        text, error = np.zeros((len(x), parts, digits), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            near, far = nearest(x[:, p], books[p])
            text[:, p] = table[near]
            error += far
        ends = np.arange(len(x) + 1, dtype=np.int32) * (parts * digits)
        codes = pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(text.tobytes())])
        return pa.StructArray.from_arrays([codes, pa.array(error)], ["code", "error"])

    return code


def encode(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """The rows that can be coded as struct ``row``, with code (an entry per part, two hex digits each or as many as it
    takes) and error (squared distances to the entries, summed over the parts).

    Vectors that are null or hold a null or non-finite component are left out, as learning left them out; null ids and
    repeated rows are coded like others, an empty table gives an empty result, other columns stay in ``row``.
    """
    kept = vectors.where(finite(F.col(vec_col))).select(F.struct("*").alias("row"), _integers(F.col(vec_col), books.scale).alias("v"))
    if not books.entries.shape[1]:
        return kept.select("row", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0)
    # called nondeterministic only so that Spark does not run it once per use of its result
    code = F.arrow_udf(_coder(vectors.sparkSession.sparkContext.broadcast(books.entries)), "code string, error bigint").asNondeterministic()
    return kept.select("row", code("v").alias("x")).select("row", "x.*")


def decode(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for, in the original scale: the entries of its parts one after the other."""
    entries, scale = books.entries, float(books.scale)

    def rebuild(column: pa.Array) -> pa.Array:
        parts, count, width = entries.shape
        digits = max(2, len(f"{count - 1:x}"))
        out = []
        for c in column:
            t = c.as_py()
            out.append(None if t is None else np.concatenate([entries[p, int(t[digits * p : digits * (p + 1)], 16)] for p in range(parts)]) / scale)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(rebuild, "array<double>")(code)
