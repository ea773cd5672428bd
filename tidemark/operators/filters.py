"""Row filters of an archive run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names


def visible(items: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose name is neither hidden nor a system file's."""
    return items.where(~names.is_system_name(names.file_name(F.col(path))))


def outside(items: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """Rows that lie in none of the subtrees."""
    for root in roots:
        items = items.where(~names.under(names.slashed(F.col(path)), root))
    return items


def not_ignored(items: DataFrame, folders: list[str], hidden: bool = False, path: str = "path") -> DataFrame:
    """Rows in no folder of these names, at any depth, nor, if ``hidden`` is asked for, below one that begins with a dot."""
    above = F.slice(F.split(names.slashed(F.col(path)), "/"), F.lit(1), F.size(F.split(names.slashed(F.col(path)), "/")) - 1)
    bad = F.arrays_overlap(above, F.array(*(F.lit(f) for f in folders)).cast("array<string>"))
    if hidden:
        bad = bad | F.exists(above, lambda x: F.startswith(x, F.lit(".")))
    return items.where(~bad)


def supported(items: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a known extension."""
    return items.where(names.is_supported(names.suffix(names.file_name(F.col(path)))))


def by_extension(items: DataFrame, accept: list[str] | None = None, reject: list[str] | None = None, path: str = "path") -> DataFrame:
    """Rows by extension, whatever its case. A named extension decides; else '*' does; else rows stay unless some are accepted by name."""
    ext = F.lower(F.regexp_extract(names.file_name(F.col(path)), r"^.*\.(.+)$", 1))
    accept, reject = ([x.lower().lstrip(".") for x in v or []] for v in (accept, reject))
    keep: Column = F.lit(True if "*" in accept else "*" not in reject and not accept)
    if reject:
        keep = F.when(ext.isin(*reject), F.lit(False)).otherwise(keep)
    if accept:
        keep = F.when(ext.isin(*accept), F.lit(True)).otherwise(keep)
    return items.where(keep)


def not_processed(items: DataFrame, processed: DataFrame, keys: list[str] | str = "path") -> DataFrame:
    """Rows whose key is not among those of earlier runs."""
    keys = [keys] if isinstance(keys, str) else keys
    return items.join(processed.select(*keys).distinct(), keys, "left_anti")


def holds(items: DataFrame, *conditions: str) -> DataFrame:
    """Rows for which all conditions hold; a null condition does not."""
    for c in conditions:
        items = items.where(F.coalesce(F.expr(c), F.lit(False)))
    return items
