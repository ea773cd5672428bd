"""Listing of folder trees, and contents of files, where the rows are.

``walk`` lists by frontier: every round, tasks take the folders that are known and not yet listed, list them and what lies
below, and hand back the folders that are left once a task has met ``SHARE`` entries. So neither a level of millions of
folders nor one subtree that holds nearly all comes to the driver or to one task; only the number of folders that are left
does. Unlike the built-in binary reader it returns empty files and looks into hidden folders. Paths must be reachable from
every executor.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.exact import with_digest
from tidemark.tables import Scratch

#: Entries after which a task hands back the folders that it has not listed.
SHARE = 20_000
_FOUND = "path string, size bigint, mtime timestamp, stat_error string, folder boolean, level int, above array<string>"
FILE = "path string, size bigint, mtime timestamp, stat_error string"


class _Lister:
    """mapInPandas function: folders with their level and the real folders above them -> files, and folders that are left."""

    def __init__(self, prune: list[str], ignore: list[str], accept: list[str] | None, hidden: bool, depth: int | None, follow: bool, share: int):
        self.prune, self.ignore, self.accept = [os.path.realpath(p) for p in prune], set(ignore), accept and tuple("." + a.lower().lstrip(".") for a in accept)
        self.hidden, self.depth, self.follow, self.share = hidden, depth, follow, share

    def _enters(self, entry: os.DirEntry) -> bool:
        if not entry.is_dir(follow_symlinks=self.follow) or entry.name in self.ignore or (not self.hidden and entry.name.startswith(".")):
            return False
        real = os.path.realpath(entry.path) if self.prune else ""
        return not any(real == p or real.startswith(p + os.sep) for p in self.prune)

    def _lists(self, name: str) -> bool:
        return not name.startswith(".") and name.lower() not in config.SYSTEM_NAMES and (self.accept is None or name.lower().endswith(self.accept))

    def _file(self, path: str) -> tuple:
        try:
            st = os.stat(path)
        except OSError as e:
            return path, None, None, f"{type(e).__name__}: {e}", False, 0, None
        return path, st.st_size, datetime.fromtimestamp(st.st_mtime, timezone.utc), None, False, 0, None

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            waiting = [(p, int(n), list(a)) for p, n, a in zip(frame["path"], frame["level"], frame["above"], strict=True)]
            met = 0
            while waiting:
                folder, level, above = waiting.pop()
                if met >= self.share:
                    yield folder, None, None, None, True, level, above
                    continue
                # a link that leads to a folder above it would never end
                chain = [*above, os.path.realpath(folder)] if self.follow else above
                try:
                    found = os.scandir(folder)
                except OSError:
                    continue  # nothing can be found there
                with found:
                    for entry in found:
                        met += 1
                        if entry.is_dir(follow_symlinks=True):
                            deeper = (self.depth is None or level < self.depth) and self._enters(entry)
                            if deeper and not (self.follow and os.path.realpath(entry.path) in chain):
                                waiting.append((entry.path, level + 1, chain))
                        elif self._lists(entry.name):
                            yield self._file(entry.path)

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = [c.split(" ")[0] for c in _FOUND.split(", ")], []
        for row in self._rows(frames):
            rows.append(row)
            if len(rows) == 4096:
                yield pd.DataFrame(rows, columns=names).astype({"size": "Int64", "level": "Int32"})
                rows = []
        yield pd.DataFrame(rows, columns=names).astype({"size": "Int64", "level": "Int32"})


def walk(spark: SparkSession, root: str, prune: list[str] | None = None, ignore: list[str] | None = None, accept: list[str] | None = None, hidden: bool = True, depth: int | None = None, follow: bool = False, share: int = SHARE) -> DataFrame:
    """path, size, mtime, stat_error of the files below root, hidden and system files left out.

    Subtrees under ``prune`` are never entered, nor are folders named in ``ignore``, those whose names begin with a dot unless
    ``hidden``, and those more than ``depth`` levels down. ``accept`` are extensions, in any case: other files are neither
    asked for their size nor returned. Links to folders are passed over, or with ``follow`` entered, but not where they lead
    to a folder above; a folder that several links lead to is listed under each.
    """
    held, lister = Scratch(spark, "walk"), _Lister(prune or [], ignore or [], accept, hidden, depth, follow, share)
    tasks = spark.sparkContext.defaultParallelism
    ask = spark.createDataFrame([(root.rstrip("/") or "/", 0, [])], "path string, level int, above array<string>")
    left, turn = 1, 0
    while left:
        found = held.keep(ask.repartition(min(left, 4 * tasks), "path").mapInPandas(lister, _FOUND), f"found/turn={turn}")
        ask = found.where("folder").select("path", "level", "above")
        left, turn = ask.count(), turn + 1
    return spark.read.schema(_FOUND + ", turn int").parquet(f"{held.root}/found").where("not folder").select("path", "size", "mtime", "stat_error")


def scan(spark: SparkSession, root: str, prune: list[str] | None = None) -> DataFrame:
    """``walk`` over a folder that must be there."""
    if not os.path.isdir(root):
        raise config.ConfigError(f"source folder does not exist: {root}")
    return walk(spark, root, prune)


def ordered(items: DataFrame, path: str = "path") -> DataFrame:
    """items with ``ord``: a key that sorts as the path does, so that 'first' means the same in every run and order of rows."""
    return items.withColumn("ord", F.col(path))


def md5_of_file(path: str) -> str | None:
    """Digest of a file's content, which is read in blocks; None if it cannot be read."""
    h = hashlib.md5()
    try:
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
    except OSError:
        return None
    return h.hexdigest()


def with_content(items: DataFrame, candidate: str = "is_candidate", path: str = "path") -> DataFrame:
    """items with md5 and hash_status: contents of candidates alone are read, where the rows are."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([md5_of_file(p) if w else None for p, w in zip(paths, wanted, strict=True)], dtype=object)

    return with_digest(items.withColumn("md5", digest(F.col(path), F.col(candidate))), F.col("md5"), candidate)
