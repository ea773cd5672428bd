"""Tag maps of files: from an external reader kept open per task, from JSON records, or from an image's own header."""

from __future__ import annotations

import itertools
import json
import struct
import subprocess
from collections.abc import Callable, Generator, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.names import path_key

BATCH, RESTARTS = 100, 3
#: Seconds that a process has to finish by itself.
PATIENCE = 10
#: The reader's protocol: arguments to start it, the date tags that are asked for, and the line that ends an answer.
START = ("-stay_open", "True", "-@", "-", "-common_args", "-charset", "filename=utf8")
ASKED = ("-j", "-G", "-DateTimeOriginal", "-CreateDate", "-CreationDate", "-MediaCreateDate", "-TrackCreateDate", "-ContentCreateDate", "-ModifyDate")
READY = "{ready}"


def _by_key(answer: str) -> dict[str, dict]:
    """Records of an answer by path key; an answer that is no JSON holds none."""
    try:
        records = json.loads(answer) if answer.strip() else []
    except json.JSONDecodeError:
        records = []
    return {_key(r["SourceFile"]): r for r in records if r.get("SourceFile")}


def _key(path: str) -> str:
    return path.replace("\\", "/").lower()


def conversation(program: str, spawn: Callable = subprocess.Popen) -> Generator[dict[str, dict], list[str], None]:
    """Send lists of paths, get their records: one process, from the first ``next`` until the generator is closed.

    EOFError or OSError tell that the process is gone; files without a record are absent from an answer.
    """
    process = spawn([program, *START], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8")
    try:
        records: dict[str, dict] = {}
        while True:
            paths = yield records
            print(*ASKED, *paths, "-execute", sep="\n", file=process.stdin, flush=True)
            answer = []
            for line in process.stdout:
                if line.strip() == READY:
                    break
                answer.append(line)
            else:
                raise EOFError(f"{program} ended within an answer")
            records = _by_key("".join(answer))
    finally:
        try:
            process.communicate("-stay_open\nFalse\n", timeout=PATIENCE)
        except (OSError, ValueError, subprocess.TimeoutExpired):
            process.kill()
            process.wait()


def answers(program: str, batches: Iterable[list[str]], restarts: int = RESTARTS, spawn: Callable = subprocess.Popen) -> Iterator[dict[str, dict]]:
    """The records of each batch. A batch on which the process ends is asked again file by file, in a new process; when that
    has been started ``restarts`` times, or cannot be started at all, no more is asked and what is left has no records."""
    talk = None
    try:
        for batch in batches:
            found, waiting = {}, [batch] if batch else []
            while waiting and restarts >= 0:
                part = waiting.pop(0)
                try:
                    if talk is None:
                        talk = conversation(program, spawn)
                        next(talk)
                    found |= talk.send(part)
                except (FileNotFoundError, PermissionError):
                    restarts = -1
                except (EOFError, OSError):
                    talk, restarts = None, restarts - 1
                    waiting = [[p] for p in part if len(part) > 1] + waiting
            yield found
    finally:
        if talk is not None:
            talk.close()


def read_tags(items: DataFrame, program: str, path: str = "path", batch: int = BATCH, ask: Callable[[str, Iterable[list[str]]], Iterator[dict[str, dict]]] = answers) -> DataFrame:
    """path and meta (map of texts) from one process per task. Files that end it have null maps, as have all that are left when
    it cannot be started (again)."""

    def text(value) -> str:
        return str(value).lower() if isinstance(value, bool) else str(value)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = (list(frame[path].iloc[k : k + batch]) for frame in frames for k in range(0, len(frame), batch))
        asked, cuts = itertools.tee(cuts)  # no more than the batch that is being answered is held twice
        for paths, records in zip(cuts, ask(program, asked), strict=True):
            maps = [records.get(_key(p)) for p in paths]
            yield pd.DataFrame({"path": paths, "meta": [None if m is None else {t: text(v) for t, v in m.items()} for m in maps]})

    return items.select(path).mapInPandas(run, "path string, meta map<string,string>")


def from_records(records: DataFrame, column: str = "value") -> DataFrame:
    """path_key and meta from a table of JSON objects, one per file; all values as texts."""
    meta = F.from_json(F.col(column), "map<string,string>")
    return records.select(meta.alias("meta")).where(F.col("meta")["SourceFile"].isNotNull()).select(path_key(F.col("meta")["SourceFile"]).alias("path_key"), "meta")


def header_time(content: bytes | None) -> str | None:
    """DateTimeOriginal, else DateTime, from the EXIF block of a JPEG or a TIFF file; None if there is none."""
    if not content:
        return None
    at = content.find(b"Exif\x00\x00", 0, 1 << 17)
    tiff = content[at + 6 :] if at >= 0 else content
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return None

    def entries(offset: int) -> dict[int, tuple[int, int]]:
        (n,) = struct.unpack_from(order + "H", tiff, offset)
        out = {}
        for k in range(n):
            tag, _, count, value = struct.unpack_from(order + "HHII", tiff, offset + 2 + 12 * k)
            out[tag] = count, value
        return out

    def text(entry: tuple[int, int]) -> str:
        count, offset = entry
        return tiff[offset : offset + count].split(b"\x00")[0].decode("ascii", "replace")

    try:
        (first,) = struct.unpack_from(order + "I", tiff, 4)
        main = entries(first)
        sub = entries(main[0x8769][1]) if 0x8769 in main else {}
        for entry in (sub.get(0x9003) or main.get(0x9003), main.get(0x0132)):
            if entry:
                return text(entry)
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(StringType())
def embedded_time(content: pd.Series) -> pd.Series:
    return content.map(lambda b: header_time(bytes(b)) if b is not None else None)


@F.pandas_udf(StringType())
def embedded_time_at(path: pd.Series) -> pd.Series:
    """The header time of files, of which only the first blocks are read, where the rows are."""

    def one(p: str) -> str | None:
        try:
            with open(p, "rb") as f:
                return header_time(f.read(1 << 18))
        except OSError:
            return None

    return path.map(one)


def sidecar_time(xml: Column) -> Column:
    """The text of the first ``date`` element of a sidecar, as a time; null if it has none."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_extract(xml, r"<date>\s*([^<]+?)\s*</date>", 1), "[TZ]", " "))
