"""Bundles of items that belong together, and their primaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.tables import fresh


def elect(items: DataFrame, keys: list[str], rank: Column, ord_col: str = "ord") -> DataFrame:
    """One row per bundle: keys, primary (struct of the row), companions (array in order), group_ord, members.

    The primary is the row of least rank, the earliest of equal ones. ``group_ord`` is the earliest order in the bundle.
    Bundles are files that share a folder and a stem, so a bundle is one small array.
    """
    cols = [c for c in items.columns if c not in keys]
    entry = F.struct(rank.cast("int").alias("_rank"), F.col(ord_col).alias("_ord"), F.struct(*cols).alias("_row"))
    df = items.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"), F.min(ord_col).alias("group_ord"))
    rows = F.transform("_m", lambda x: x["_row"])
    return df.select(*keys, F.element_at(rows, 1).alias("primary"), F.slice(rows, 2, F.greatest(F.size("_m") - 1, F.lit(0))).alias("companions"), "group_ord", F.size("_m").alias("members"))


def elected(items: DataFrame, keys: list[str], rank: Column, ord_col: str = "ord") -> DataFrame:
    """items, flat, with primary_ord, group_ord, members and role, for bundles of any size: no row and no task holds one.

    The election is a partial aggregate that is joined back; a bundle that holds a third of all rows is split by the join.
    """
    own = {k: fresh(f"own_{k}", items) for k in keys}
    first = items.groupBy(*(F.col(k).alias(own[k]) for k in keys)).agg(F.min(F.struct(rank.alias("r"), F.col(ord_col).alias("o"))).alias("x"), F.min(ord_col).alias("group_ord"), F.count("*").alias("members"))
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    role = F.when(F.col("x.o") == F.col(ord_col), "primary").otherwise("companion")
    return items.join(first, same).select(*items.columns, F.col("x.o").alias("primary_ord"), "group_ord", "members", role.alias("role"))


def with_roles(items: DataFrame, path: str = "path", ord_col: str = "ord") -> DataFrame:
    """items with group_id, group_ord and role ('primary' or 'companion'), kept flat: one shuffle on the bundle's key."""
    df = items.withColumn("group_id", F.md5(F.concat_ws("\u0000", *bundle_key(F.col(path)))))
    w = Window.partitionBy("group_id")
    rank = names.class_rank(names.suffix(names.file_name(F.col(path))))
    first = F.row_number().over(w.orderBy(rank, ord_col)) == 1
    return df.withColumns({"role": F.when(first, "primary").otherwise("companion"), "group_ord": F.min(ord_col).over(w)})


def bundle_key(path: Column) -> list[Column]:
    """Folder and normalised, case-folded stem: equal for the files of one bundle."""
    name = names.file_name(path)
    return [names.parent(path).alias("dir"), F.lower(names.normalize_stem(names.stem(name))).alias("stem_key")]


def group_files(items: DataFrame, path: str = "path", ord_col: str = "ord") -> DataFrame:
    """Bundles of items by folder and stem: images lead, then videos, then the rest."""
    ext = names.suffix(names.file_name(F.col(path)))
    return elect(items.select("*", *bundle_key(F.col(path))), ["dir", "stem_key"], names.class_rank(ext), ord_col)
