"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config


def slashed(path: Column) -> Column:
    """The path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_key(path: Column) -> Column:
    """A key under which two spellings of one path meet: forward slashes, lower case."""
    return F.lower(slashed(path))


def file_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def parent(path: Column) -> Column:
    """What lies before the last slash; '/' for a file in the root, '.' without any slash."""
    p = slashed(path)
    head = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(p, F.lit("/")), F.lit(".")).when(head == "", F.lit("/")).otherwise(head)


def suffix(name: Column) -> Column:
    """From the last dot on; empty for names without one, with only a leading one, or ending in one."""
    return F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """The name without its suffix."""
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def normalize_stem(value: Column) -> Column:
    """Stem of an edited copy (IMG_E1234) as that of its original (IMG_1234)."""
    return F.regexp_replace(value, config.STEM_PATTERN, "$1$2")


def is_system_name(name: Column) -> Column:
    """Hidden names and those that operating systems leave behind."""
    return F.startswith(name, F.lit(".")) | F.lower(name).isin(*config.SYSTEM_NAMES)


def under(path: Column, root: str) -> Column:
    """Whether path is root or lies in its subtree."""
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def class_rank(ext: Column) -> Column:
    """0 image, 1 video, 2 anything else."""
    e = F.lower(ext)
    return F.when(e.isin(*config.IMAGE_EXTENSIONS), 0).when(e.isin(*config.VIDEO_EXTENSIONS), 1).otherwise(2)


def type_folder(ext: Column) -> Column:
    """Folder of the layout by type."""
    e = F.lower(ext)
    return F.when(e.isin(*config.IMAGE_EXTENSIONS), "images").when(e.isin(*config.VIDEO_EXTENSIONS), "videos").when(e.isin(*config.SIDECAR_EXTENSIONS), "aae").otherwise("others")


def is_supported(ext: Column) -> Column:
    return F.lower(ext).isin(*config.SUPPORTED_EXTENSIONS)
