"""Settings of an archive run, and the fixed vocabularies that decide its results."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on these lists, their order and spelling.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".heic", ".dng", ".tiff", ".tif", ".jfif", ".ico", ".bmp", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".webm", ".m4v", ".3gp")
SIDECAR_EXTENSIONS = (".aae",)
SUPPORTED_EXTENSIONS = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS + SIDECAR_EXTENSIONS
DATE_KEYS = (
    "EXIF:DateTimeOriginal",
    "EXIF:CreateDate",
    "QuickTime:CreateDate",
    "QuickTime:MediaCreateDate",
    "QuickTime:TrackCreateDate",
    "QuickTime:CreationDate",
    "XMP:CreateDate",
    "XMP:ModifyDate",
    "DateTimeOriginal",
    "CreateDate",
    "CreationDate",
    "ModifyDate",
)
SYSTEM_NAMES = ("thumbs.db", "desktop.ini")
STATE_FILENAME = ".organizer_state.json"
STATE_VERSION = 3
#: Folder in the target that holds the state's log, the plans of runs and the index of fingerprints.
WORK_FOLDER = ".tidemark"
STEM_PATTERN = r"(?i)^(IMG_)E(\d)"


@dataclass(frozen=True)
class ArchiveConfig:
    """What an archive plan needs to know besides its tables."""

    target: str
    duplicates: str
    use_fingerprints: bool = False
    threshold: int = 4
    dry_run: bool = False
    resume: bool = True
    by_type: bool = False
    resume_key: str = "path"  # or "version": path, size and mtime together
    hash_all: bool = False  # hash every row instead of those whose size recurs


class ConfigError(ValueError):
    """A setting that makes a run impossible; the command line turns it into exit code 2."""


def _inside(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def check_paths(source: str, target: str, duplicates: str) -> None:
    """Refuse folders that would make a run read what it writes."""
    source, target, duplicates = (p.rstrip("/") or "/" for p in (source, target, duplicates))
    if source == target:
        raise ConfigError("source and target are the same folder")
    if target == duplicates:
        raise ConfigError("target and duplicates are the same folder")
    if _inside(source, target):
        raise ConfigError("source lies inside target")
