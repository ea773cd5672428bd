"""Counters, failures and the exit code of a decided plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("scanned", "moved", "duplicates", "visual_duplicates", "sidecars_paired", "livephotos_paired", "skipped", "resumed", "date_from_mtime", "failed", "errored")


def summary(plan: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """One row of the counters. Groups count for moved, duplicates and visual_duplicates, files for the others.

    ``plan`` has role, action, ext, time_source, error_kind; ``scanned`` one row with scanned, skipped and resumed.
    """
    lead, side = F.col("role") == "primary", F.col("role") == "companion"
    archived = F.col("action") == "archive"
    sidecar = F.lower("ext") == ".aae"
    error = F.coalesce("error_kind", F.lit(""))
    row = plan.agg(
        F.count_if(lead & archived & (error == "")).alias("moved"),
        F.count_if(lead & (F.col("action") == "duplicate")).alias("duplicates"),
        F.count_if(lead & (F.col("action") == "visual_duplicate")).alias("visual_duplicates"),
        F.count_if(side & archived & sidecar & (error == "")).alias("sidecars_paired"),
        F.count_if(side & archived & ~sidecar & (error == "")).alias("livephotos_paired"),
        F.count_if(lead & archived & (F.col("time_source") == "mtime")).alias("date_from_mtime"),
        F.count_if(error == "FAIL").alias("failed"),
        F.count_if(error == "ERROR").alias("errored"),
    )
    if scanned is None:
        scanned = plan.agg(F.count("*").alias("scanned")).withColumns({"skipped": F.lit(0).cast("bigint"), "resumed": F.lit(0).cast("bigint")})
    return row.join(scanned).select(*COUNTERS)  # one row by one row


def failures(plan: DataFrame) -> DataFrame:
    """path, kind and message of every row that failed."""
    return plan.where("error_kind is not null").select("path", F.col("error_kind").alias("kind"), F.col("error").alias("message"))


def exit_code(counters: DataFrame) -> DataFrame:
    """2 if anything was in error, 1 if anything failed, else 0."""
    return counters.select(F.when(F.col("errored") > 0, 2).when(F.col("failed") > 0, 1).otherwise(0).alias("exit_code"))


def history_totals(seen: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: sizes, hashes and paths that the state holds."""
    return seen.agg(F.count_distinct("size").alias("sizes"), F.count("*").alias("hashes")).join(processed.agg(F.count("*").alias("paths")))


def estimate(items: DataFrame) -> DataFrame:
    """Number and bytes of the rows that a run would look at."""
    return items.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def report(counters: DataFrame, source: str, target: str, duplicates: str, dry_run: bool = False, by_type: bool = False) -> DataFrame:
    """One JSON document of a run."""
    stats = F.struct((F.col("moved") + F.col("duplicates") + F.col("visual_duplicates")).alias("total"), "scanned", "moved", "duplicates", "skipped", (F.col("failed") + F.col("errored")).alias("errors"))
    doc = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(duplicates).alias("duplicates"), F.lit(dry_run).alias("dry_run"), F.lit(by_type).alias("by_type"), stats.alias("stats"))
    return counters.select(F.to_json(doc).alias("report"))
