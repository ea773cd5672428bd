"""Exact duplicates with a size-first plan: only rows whose size recurs are hashed.

Rows need an order (``ord``); every decision is 'first one wins' in that order. Sizes alone choose the candidates. Where
content has to be fetched (files), only theirs is, by ``with_hash`` after ``hash_candidates``. Where content is a column,
take its digest in the scan and go on with ``with_digest``: then order, size and digest travel, never content, whatever
the joins are. Partial counts per size are all that the choice of candidates shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_of
from tidemark.tables import fresh, materialise


def size_histogram(items: DataFrame, size: str = "size") -> DataFrame:
    return items.groupBy(size).agg(F.count("*").alias("n"))


def hash_candidates(items: DataFrame, history: DataFrame | None = None, size: str = "size") -> DataFrame:
    """items with is_candidate: the size is unknown, recurs in the batch, or is among the history's sizes.

    The recurring sizes are an aggregate that is joined back, so a size that a third of the rows share is split by the
    adaptive join and never meets in one task.
    """
    again = size_histogram(items.where(F.col(size).isNotNull()), size).where("n > 1").select(size)
    if history is not None:
        again = again.union(history.select(F.col(size))).distinct()
    flag, key = fresh("again", items), fresh("key", items)
    # rows without a size meet nothing, and are dealt to as many tasks as the others
    spread = F.coalesce(F.col(size).cast("bigint"), -1 - F.monotonically_increasing_id() % 4096)
    marked = items.withColumn(key, spread).join(again.select(F.col(size).cast("bigint").alias(key), F.lit(True).alias(flag)), key, "left")
    return marked.select(*(F.col(c) for c in items.columns), (F.col(size).isNull() | F.coalesce(flag, F.lit(False))).alias("is_candidate"))


def with_hash(items: DataFrame, content: Column, candidate: str = "is_candidate") -> DataFrame:
    """items with md5 (of candidates only) and hash_status: not_needed, ok or failed."""
    return with_digest(items, md5_of(content), candidate)


def with_digest(items: DataFrame, digest: Column, candidate: str = "is_candidate") -> DataFrame:
    """``with_hash`` for a digest that is there already, null where the content could not be read."""
    status = F.when(~F.col(candidate), "not_needed").when(digest.isNull(), "failed").otherwise("ok")
    return items.withColumns({"md5": F.when(F.col(candidate), digest), "hash_status": status})


def digest_table(items: DataFrame, content: Column, size: str = "size", ord_col: str = "ord") -> DataFrame:
    """ord, size and digest of rows whose content is a column, written once: what follows reads no content again."""
    return materialise(items.select(F.col(ord_col).alias("ord"), F.col(size).alias("size"), md5_of(content).alias("digest")), "digests")


def first_wins(items: DataFrame, seen: DataFrame | None = None, size: str = "size", ord_col: str = "ord") -> DataFrame:
    """items with is_duplicate: an earlier row of the batch, or the history, has the same size and md5.

    Rows without md5 are never duplicates. The least order per (size, md5) is a partial aggregate, so the copies of one
    content may be any share of the rows.
    """
    least, known = fresh("first", items), fresh("known", items)
    first = items.where(F.col("md5").isNotNull()).groupBy(size, "md5").agg(F.min(ord_col).alias(least))
    if seen is not None:
        first = first.join(seen.select(F.col("size").alias(size), "md5").distinct().withColumn(known, F.lit(True)), [size, "md5"], "left")
    else:
        first = first.withColumn(known, F.lit(None).cast("boolean"))
    marked = items.join(first, [size, "md5"], "left")
    later = F.coalesce(known, F.lit(False)) | F.coalesce(F.col(least) < F.col(ord_col), F.lit(False))
    return marked.select(*(F.col(c) for c in items.columns), later.alias("is_duplicate"))


def backfill(pending: DataFrame, batch: DataFrame, hasher: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(size, md5) of archived rows that were never hashed and whose size the batch hashed, and the entries that stay.

    ``pending`` has size and archived_path; ``hasher`` maps such rows to rows with md5, null or absent where the content
    is gone. Such an entry yields no hash, and is used up all the same.
    """
    due = batch.where(F.col("md5").isNotNull()).select("size").distinct()
    hashed = hasher(pending.join(due, "size", "left_semi")).select("size", "md5")
    return hashed.where(F.col("md5").isNotNull()).distinct(), pending.join(due, "size", "left_anti")


def dedup_all_hashes(items: DataFrame, content: Column, ord_col: str = "ord") -> DataFrame:
    """items with md5 and is_duplicate when every row is hashed: what the size-first plan must agree with."""
    return first_wins(items.withColumn("md5", md5_of(content)), ord_col=ord_col)
