"""Carrying out a plan's moves, each atomic and safe to repeat."""

from __future__ import annotations

import errno
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What systems report for a move between volumes.
_OTHER_VOLUME = 17


def move(source: str, target: str) -> None:
    """Rename, or, between volumes, copy beside the target, flush, rename, remove; nothing half-made stays behind.

    A move that was carried out before counts as done, so a task that is run again does no harm.
    """
    if not os.path.exists(source) and os.path.exists(target):
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.replace(source, target)
        return
    except OSError as e:
        if e.errno != errno.EXDEV and getattr(e, "winerror", None) != _OTHER_VOLUME:
            raise
    part = target + ".partial"
    try:
        shutil.copy2(source, part)
        with open(part, "r+b") as f:
            os.fsync(f.fileno())
        os.replace(part, target)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    try:
        os.remove(source)
    except OSError:
        pass  # the copy is in place; the next run meets the source as a duplicate


def carried_out(plan: DataFrame) -> DataFrame:
    """The plan's rows after a run that was broken off: those whose move is done as they are, the others with action 'none'."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            there = [not os.path.exists(s) and os.path.exists(t) for s, t in zip(frame["path"], frame["destination"], strict=True)]
            yield frame.loc[there, ["path"]].assign(is_there=True)

    done = plan.where("action <> 'none'").select("path", "destination").mapInPandas(look, "path string, is_there boolean")
    found = plan.join(done, "path", "left")
    action = F.when(F.col("is_there"), F.col("action")).otherwise("none").alias("action")
    return found.select(*(action if c == "action" else F.col(c) for c in plan.columns))
