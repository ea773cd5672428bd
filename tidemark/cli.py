"""Command line: plan an archive run over a folder tree, and carry it out unless it is a dry run."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.fingerprints import fingerprint_of
from tidemark.functions.hashing import from_hex
from tidemark.functions.names import class_rank, file_name, suffix
from tidemark.operators import filters, stats
from tidemark.plans.archive import plan_archive
from tidemark.plans.steps import STEP, recover, run_in_steps
from tidemark.sources import files, metadata, state
from tidemark.sources.band_index import MOST, BandIndex
from tidemark.sources.move_sink import carry_out
from tidemark.sources.state_log import StateLog, state_rows
from tidemark.tables import materialise

log = logging.getLogger("tidemark")


#: The name of the tag program where none is given: it is looked for on the search path.
READER = "exiftool"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Archive files by capture time, without duplicates, keeping bundles together.")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--duplicates", required=True)
    p.add_argument("--exiftool", default=shutil.which(READER), help="program that reads tags (default: the one on the search path)")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--phash", action="store_true", help="also find visual duplicates; images other than portable grey maps need an image library")
    p.add_argument("--phash-threshold", type=int, default=4)
    p.add_argument("--workers", type=int, default=4, help="local executor threads")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--by-type", action="store_true", help="a folder per type below the month")
    p.add_argument("--no-progress", action="store_true")
    p.add_argument("--report", help="file for a JSON report")
    p.add_argument("--step", type=int, default=STEP, help="files that are moved between two commits of the state")
    p.add_argument("--resume-key", default="path", choices=["path", "version"], help="what tells a file that was done before: its path, or path, size and time")
    return p


def _open(kept: StateLog, index: BandIndex | None, target: str, dry_run: bool) -> state.State:
    """The state of earlier runs. A run that broke off is made up for, and a document that there is without a log is taken over."""
    if dry_run:
        return kept.state() if kept.commits() else state.load(kept.spark, target)
    if late := recover(kept, index):
        log.warning("a run was broken off; %d files that it had moved are taken over", late)
    if not kept.commits() and os.path.exists(os.path.join(target, config.STATE_FILENAME)):
        kept.commit(state_rows(state.load(kept.spark, target)))
    return kept.state()


def _check_fingerprints(items: DataFrame) -> None:
    """Refuse a search for visual duplicates whose images cannot be decoded here, before anything is moved."""
    blind = filters.visible(items).where((class_rank(suffix(file_name(F.col("path")))) == 0) & F.col("code").isNull()).count()
    if blind and importlib.util.find_spec("PIL") is None:
        raise config.ConfigError(f"visual duplicates were asked for, but {blind} images need an image library, which is missing")
    if blind:
        log.warning("%d images cannot be decoded; they are no one's visual duplicates", blind)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    """Exit code: 0 all went well, 1 files without a time, 2 errors."""
    if not os.path.isdir(args.source):
        log.error("source folder does not exist: %s", args.source)
        return 2
    config.check_paths(args.source, args.target, args.duplicates)
    cfg = config.ArchiveConfig(args.target, args.duplicates, args.phash, args.phash_threshold, args.dry_run, not args.no_resume, args.by_type, args.resume_key)
    work = f"{args.target.rstrip('/')}/{config.WORK_FOLDER}"
    kept = StateLog(spark, f"{work}/state") if cfg.resume else None
    index = BandIndex(spark, f"{work}/fingerprints", cfg.threshold) if kept and args.phash and cfg.threshold <= MOST else None
    known = _open(kept, index, args.target, args.dry_run) if kept else state.empty(spark)
    items = files.ordered(files.scan(spark, args.source, [args.target, args.duplicates]))
    if args.exiftool:
        items = items.join(metadata.read_tags(items, args.exiftool), "path", "left")
    header = F.lower(F.col("path")).rlike(r"\.(jpe?g|jfif|tiff?|dng|heic)$")
    items = items.withColumn("embedded", F.when(header, metadata.embedded_time_at("path")))
    if args.phash:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.source).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
        items = items.join(content.select("path", from_hex(fingerprint_of("content")).alias("code")), "path", "left")
    taken = files.scan(spark, args.target, [work]) if os.path.isdir(args.target) else None
    if os.path.isdir(args.duplicates):
        more = files.scan(spark, args.duplicates)
        taken = more if taken is None else taken.union(more)
    existing = None if taken is None else materialise(taken.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name")), "existing")
    refill = lambda df: files.with_content(df.withColumn("is_candidate", F.lit(True)), path="archived_path")
    items = materialise(items, "items")
    if args.phash:
        _check_fingerprints(items)
    plan = plan_archive(items, cfg, known, files.with_content, existing, refill, index, kept.next_number() if kept else 0)
    if cfg.dry_run:
        rows = plan.rows
    elif kept is None:
        rows = materialise(carry_out(plan.rows, tempfile.mkdtemp(prefix="tidemark-moves-")), "done")
    else:
        try:
            rows = run_in_steps(plan, kept, args.step, carry_out, index)
        except KeyboardInterrupt:  # what was moved until now is not to be met again as new
            recover(kept, index)
            state.save(kept.state(), args.target)
            raise
    counters = stats.summary(rows, plan.counters.select("scanned", "skipped", "resumed"))
    row = counters.head()
    for name in stats.COUNTERS:
        log.info("%s: %d", name, row[name])
    for f in stats.failures(rows).toLocalIterator():
        log.warning("[%s] %s -> %s", f.kind, f.path, f.message)
    if kept is not None and not cfg.dry_run:
        state.save(kept.state(), args.target)
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(stats.report(counters, args.source, args.target, args.duplicates, cfg.dry_run, cfg.by_type).head()[0])
    return stats.exit_code(counters).head()[0]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=getattr(logging, args.log_level), format="%(asctime)s %(levelname)s %(message)s")
    work = tempfile.mkdtemp(prefix="tidemark-")  # one machine: its own folder serves driver and executors alike
    spark = SparkSession.builder.master(f"local[{args.workers}]").config("spark.checkpoint.dir", work).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return run(args, spark)
    except config.ConfigError as e:
        log.error("%s", e)
        return 2
    except KeyboardInterrupt:
        return 130
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    raise SystemExit(main())
