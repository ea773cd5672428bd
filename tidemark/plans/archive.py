"""The plan of an archive run: what happens to every file, as a table. Nothing is touched here.

items need path, ord, size, mtime; optional are meta (tag map), content or md5 with hash_status, code (64-bit
fingerprint), embedded (header time) and stat_error. Columns of other names are ignored. A row of the plan is a file with its bundle's fate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ArchiveConfig
from tidemark.functions import dates, names
from tidemark.functions.hashing import md5_of
from tidemark.operators import exact, filters, grouping, neardup, stats
from tidemark.operators.collisions import unique_names
from tidemark.sources.band_index import BandIndex
from tidemark.sources.state import State, empty
from tidemark.sources.state_log import rows_of
from tidemark.tables import fresh, materialise


@dataclass
class Plan:
    rows: DataFrame
    counters: DataFrame
    base: State  # what earlier runs left, with hashes that this one filled in
    refilled: DataFrame  # the same as rows of a log: hashes filled in, and the entries that they were for

    def failures(self) -> DataFrame:
        return stats.failures(self.rows)

    def next_state(self) -> State:
        return next_state(self.rows, self.base)

    def exit_code(self) -> DataFrame:
        return stats.exit_code(self.counters)


def _optional(items: DataFrame, **kinds: str) -> DataFrame:
    return items.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in items.columns})


def plan_archive(items: DataFrame, config: ArchiveConfig, state: State | None = None, hasher: Callable[[DataFrame], DataFrame] | None = None, existing: DataFrame | None = None, pending_hasher: Callable[[DataFrame], DataFrame] | None = None, index: BandIndex | None = None, batch: int = 0) -> Plan:
    """Decide every file's fate.

    ``hasher`` adds md5 and hash_status to rows with is_candidate; by default it hashes their ``content``. ``existing``
    are (folder, name) pairs that the target already holds. ``pending_hasher`` adds md5 to (size, archived_path) of archived
    rows that were never hashed; without it they stay so. ``index`` holds the fingerprints of batches before ``batch``, whose
    visual duplicates are found too.
    """
    spark = items.sparkSession
    state = state or empty(spark)
    items = _optional(items, meta="map<string,string>", content="binary", code="bigint", embedded="string", stat_error="string")
    own = ("path", "ord", "size", "mtime", "meta", "content", "md5", "hash_status", "code", "embedded", "stat_error")
    items = items.select(*(c for c in items.columns if hasher is not None or c in own))
    version = F.concat_ws("\u0000", "path", F.col("size").cast("string"), F.col("mtime").cast("double").cast("string"))
    items = items.withColumn("done_key", version if config.resume_key == "version" else F.col("path"))
    if hasher is None:  # the digest is taken in the scan, so that content meets no shuffle
        digest = fresh("digest", items)
        items = items.withColumn(digest, md5_of(F.col("content"))).drop("content")
        hasher = lambda df: exact.with_digest(df, F.col(digest)).drop(digest)
    media = filters.supported(items)
    todo = filters.not_processed(media, state.processed.select(F.col("path").alias("done_key")), "done_key").select(media.columns) if config.resume else media
    scanned = items.agg(F.count("*").alias("scanned"), F.count_if(~names.is_supported(names.suffix(names.file_name(F.col("path"))))).alias("skipped"))
    left = todo.agg(F.count("*").alias("_todo"))
    scanned = scanned.join(left).select("scanned", "skipped", (F.col("scanned") - F.col("skipped") - F.col("_todo")).alias("resumed"))

    files = grouping.with_roles(todo).withColumn("ext", names.suffix(names.file_name(F.col("path"))))
    lead = files.where("role = 'primary'")
    marked = lead.withColumn("is_candidate", F.lit(True)) if config.hash_all else exact.hash_candidates(lead, state.history())
    hashed = hasher(marked)
    hashed = materialise(hashed.drop("content"), "hashed")
    sound = hashed.where("size is not null and hash_status <> 'failed'")

    extra, rest = state.seen.limit(0), state.pending
    if pending_hasher is not None:
        extra, rest = (materialise(x, "backfill") for x in exact.backfill(state.pending, sound, pending_hasher))
    judged = exact.first_wins(sound, state.seen.union(extra))
    unique = judged.where("not is_duplicate")
    if config.use_fingerprints:
        earlier = index.near(unique.select("code"), batch) if index is not None else None
        unique = neardup.leaders(unique, config.threshold, known=earlier)
        near = F.when(~F.col("is_leader"), "visual_duplicate")
    else:
        near = F.lit(None).cast("string")
    fate = unique.withColumn("action", F.coalesce(near, F.lit("archive"))).select("group_id", "action")
    fate = fate.union(judged.where("is_duplicate").select("group_id", F.lit("duplicate")))
    lead = hashed.join(fate, "group_id", "left")

    time = dates.resolve_time(F.col("meta"), F.col("mtime"), F.col("embedded"))
    lead = lead.withColumn("_t", F.when(F.col("action") == "archive", time))
    kind = F.when(F.col("size").isNull() | (F.col("hash_status") == "failed"), "ERROR").when((F.col("action") == "archive") & F.col("_t").isNull(), "FAIL")
    text = F.when(F.col("size").isNull(), F.concat(F.lit("size unknown: "), F.coalesce("stat_error", F.lit("")))).when(F.col("hash_status") == "failed", "content cannot be read").when(kind == "FAIL", "no time can be told")
    folder = F.concat(F.lit(config.target.rstrip("/") + "/"), dates.year_folder(F.col("_t.time")), F.lit("/"), dates.month_folder(F.col("_t.time")))
    lead = lead.withColumns({"error_kind": kind, "error": text, "_folder": F.when(F.col("action") == "archive", folder).otherwise(F.lit(config.duplicates.rstrip("/")))})
    lead = lead.withColumn("action", F.when(F.col("error_kind").isNull(), F.col("action")).otherwise("none"))
    group = lead.select("group_id", "action", F.col("_t.time").alias("time"), F.col("_t.source").alias("time_source"), "_folder", "md5", "hash_status", "error_kind", "error")

    every = files.drop("content", "meta").join(group, "group_id")
    first = F.col("role") == "primary"
    own = {c: F.when(first, F.col(c)) for c in ("md5", "hash_status", "error_kind", "error")}
    every = every.withColumns(own)
    if config.by_type:
        every = every.withColumn("_folder", F.when(F.col("action") == "archive", F.concat("_folder", F.lit("/"), names.type_folder(F.col("ext")))).otherwise(F.col("_folder")))
    turn = F.concat_ws("\u0000", F.col("group_ord").cast("string"), F.when(first, "0").otherwise("1"), names.class_rank(F.col("ext")).cast("string"), F.col("ord").cast("string"))
    every = materialise(every.withColumns({"name": names.file_name(F.col("path")), "_turn": turn}).withColumnRenamed("_folder", "folder"), "fates")
    moved = unique_names(every.where("action <> 'none'"), "folder", "name", "_turn", existing)
    still = every.where("action = 'none'").withColumns({"final_name": F.lit(None).cast("string"), "folder": F.lit(None).cast("string")}).select(moved.columns)
    plan = moved.union(still).withColumn("destination", F.concat("folder", F.lit("/"), "final_name"))
    plan = materialise(plan.select("path", "ord", "group_id", "role", "ext", "action", "size", "md5", "hash_status", "time", "time_source", "folder", "name", "final_name", "destination", "error_kind", "error", "code", "done_key"), "plan")
    base = State(state.seen.union(extra).distinct(), rest, state.processed, state.known_sizes)
    used = state.pending.join(rest.distinct(), ["size", "archived_path"], "left_anti")
    return Plan(plan, stats.summary(plan, scanned), base, rows_of("hash", extra, "size", "md5").union(rows_of("filled", used, "size", "archived_path")))


def next_state(plan: DataFrame, base: State) -> State:
    """The state after the rows of ``plan`` that were carried out: hashes of rows that failed are not kept."""
    done = plan.where("action <> 'none' and error_kind is null")
    lead = done.where("role = 'primary'")
    seen = base.seen.union(lead.where("md5 is not null").select("size", "md5")).distinct()
    later = lead.where("action = 'archive' and hash_status = 'not_needed'").select("size", F.col("destination").alias("archived_path"))
    return State(seen, base.pending.union(later), base.processed.union(done.select("done_key")).distinct(), base.known_sizes.union(lead.select("size")).distinct())
