"""Bounded samples of labelled rows, taken by hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Most bytes of text of each class that a training sample takes: with the number of rows it bounds what the driver holds.
BYTES = 4 << 20


def sample(rows: DataFrame, id_col: str, class_col: str, per_class: int, held_out: Column) -> DataFrame:
    """At most about ``per_class`` ids of each class among the rows that are not held out: id, label and n, the class's size.

    Those with the smallest hashes stay, by a threshold from the class's size, so no row moves but the sampled ones.
    """
    rows = rows.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull() & ~held_out).select(F.col(id_col).cast("bigint").alias("id"), F.col(class_col).alias("label"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < F.lit(float(per_class))
    return rows.join(sizes, "label").where(part)


def texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, per_class: int, most: int = BYTES) -> list:
    """Rows (text, label, n) of the sampled ids on the driver, in an order that does not depend on partitions.

    Texts of any length are taken, in order of hash, until a class has 2 * ``per_class`` rows or its texts come to ``most``
    bytes; its first one is always taken.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    # the ids are written, so that Spark knows their size and broadcasts them only if they are few
    ids = Scratch(docs.sparkSession, "sample").keep(ids, "ids")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(11)), "id", "text")
    rows = docs.join(ids, "id").withColumns({"place": F.row_number().over(order), "bytes": F.sum(F.octet_length("text").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.where((F.col("place") == 1) | ((F.col("place") <= 2 * per_class) & (F.col("bytes") <= most)))
    return rows.orderBy(F.xxhash64("id", F.lit(11)), "id", "text", "label").select("text", "label", "n").collect()
