"""Capture times from prioritised candidates, with their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config


def parse_time(value: Column) -> Column:
    """Wall-clock time of 'YYYY:MM:DD HH:MM:SS' in the first 19 characters, padded or not; null if it is none."""
    return F.try_to_timestamp(F.substr(value, F.lit(1), F.lit(19)), F.lit("yyyy:M:d H:m:s")).cast("timestamp_ntz")


def capture_time(meta: Column, keys: Sequence[str] = config.DATE_KEYS) -> Column:
    """The first candidate in order of priority that can be parsed, from a map of tags to texts."""
    return F.coalesce(*(parse_time(F.nullif(F.element_at(meta, F.lit(k)), F.lit(""))) for k in keys))


def capture_key(meta: Column, keys: Sequence[str] = config.DATE_KEYS) -> Column:
    """The tag that ``capture_time`` takes."""
    return F.coalesce(*(F.when(parse_time(F.nullif(F.element_at(meta, F.lit(k)), F.lit(""))).isNotNull(), F.lit(k)) for k in keys))


def resolve_time(meta: Column, mtime: Column, embedded: Column | None = None) -> Column:
    """struct<time, source>: from the tags, else from the embedded header, else the modification time."""
    options = [(capture_time(meta), "exiftool")]
    if embedded is not None:
        options.append((parse_time(embedded), "pillow"))
    options.append((mtime.cast("timestamp_ntz"), "mtime"))
    return F.coalesce(*(F.when(t.isNotNull(), F.struct(t.alias("time"), F.lit(s).alias("source"))) for t, s in options))


def year_folder(time: Column) -> Column:
    return F.lpad(F.year(time).cast("string"), 4, "0")


def month_folder(time: Column) -> Column:
    return F.lpad(F.month(time).cast("string"), 2, "0")
