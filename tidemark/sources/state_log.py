"""State between runs as an append-only log of deltas, committed while a run goes on.

A commit is a set of rows (kind, size, value) under ``deltas/commit=N`` and, once those are complete, one row in the table
``commits``, which makes it count. Kinds are ``hash`` (size, md5), ``size``, ``path`` (a source path done), ``pending`` and
``filled`` (size, archived path of a row that was never hashed, and that this was made up for). Rows that no commit names,
as a run that broke off leaves them, are never read and are overwritten by the next commit of that number. After
``COMPACT`` deltas the whole state is written as a base, and earlier commits are read no more. One run writes at a time.

Everything is written and read by Spark, in parts sorted by kind, size and value: no document and no row holds the state.
The driver gets one row per commit since the last base.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.state import State, empty

ROWS = "kind string, size bigint, value string"
_COMMITS = "number int, base boolean, label string"
#: Deltas after which the state is written anew.
COMPACT = 32


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def rows_of(kind: str, df: DataFrame, size: str | None = None, value: str | None = None) -> DataFrame:
    of = lambda c, t: F.col(c).cast(t) if c else F.lit(None).cast(t)
    return df.select(F.lit(kind).alias("kind"), of(size, "bigint").alias("size"), of(value, "string").alias("value"))


def state_rows(state: State) -> DataFrame:
    """A whole state as rows of a log."""
    parts = [rows_of("hash", state.seen, "size", "md5"), rows_of("size", state.known_sizes, "size"), rows_of("path", state.processed, None, "path"), rows_of("pending", state.pending, "size", "archived_path")]
    return reduce(DataFrame.union, parts)


def step_rows(done: DataFrame) -> DataFrame:
    """What rows of a plan that were carried out add: hashes of rows that failed are not kept."""
    done = done.where("action <> 'none' and error_kind is null")
    lead = done.where("role = 'primary'")
    later = lead.where("action = 'archive' and hash_status = 'not_needed'")
    parts = [rows_of("hash", lead.where("md5 is not null"), "size", "md5"), rows_of("size", lead, "size"), rows_of("path", done, None, "done_key"), rows_of("pending", later, "size", "destination")]
    return reduce(DataFrame.union, parts)


class StateLog:
    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), compact

    def commits(self) -> list[Row]:
        """Number, base and label of the commits that count, in order, from the last base on."""
        found = _read(self.spark, _COMMITS, f"{self.folder}/commits")
        if found is None:
            return []
        last = found.where("base").agg(F.max("number")).head()[0]
        return found.where(F.col("number") >= (last or 0)).orderBy("number").collect()  # at most ``compact`` rows, and one

    def next_number(self) -> int:
        return max((c.number for c in self.commits()), default=-1) + 1

    def commit(self, rows: DataFrame, label: str = "", base: bool = False) -> int:
        """Make rows part of the state; returns the commit's number."""
        number = self.next_number()
        rows.select("kind", "size", "value").distinct().sort("kind", "size", "value").write.mode("overwrite").parquet(f"{self.folder}/deltas/commit={number}")
        self.spark.createDataFrame([(number, base, label)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        if not base and not label.startswith(("plan:", "step:", "late:")) and len(self.commits()) > self.every:  # not within a run
            self.commit(state_rows(self.state()), label, base=True)
        return number

    def rows(self) -> DataFrame | None:
        """The rows of all commits that count, with their commit."""
        numbers = [c.number for c in self.commits()]
        found = _read(self.spark, f"{ROWS}, commit int", f"{self.folder}/deltas") if numbers else None
        return None if found is None else found.where(F.col("commit").isin(numbers))

    def state(self) -> State:
        """The state that the log comes to. A pending row counts until a later commit fills it in."""
        rows = self.rows()
        if rows is None:
            return empty(self.spark)
        kind = lambda k: rows.where(F.col("kind") == k)
        last = rows.where("kind in ('pending', 'filled')").groupBy("size", "value").agg(F.max(F.struct("commit", "kind")).alias("x"))
        return State(
            kind("hash").select("size", F.col("value").alias("md5")).distinct(),
            last.where("x.kind = 'pending'").select("size", F.col("value").alias("archived_path")),
            kind("path").select(F.col("value").alias("path")).distinct(),
            kind("size").select("size").distinct(),
        )

    def open_run(self) -> tuple[str, int, set[int]] | None:
        """Name, number of steps and committed steps of the last run, if it has not ended."""
        run, steps, done = None, 0, set()
        for label in (c.label.split(":") for c in self.commits()):
            if label[0] == "plan":
                run, steps, done = label[1], int(label[2]), set()
            elif label[0] == "step" and label[1] == run:
                done.add(int(label[2]))
            elif label[0] == "end" and label[1] == run:
                run = None
        return None if run is None else (run, steps, done)

    def new_run(self) -> str:
        return uuid.uuid4().hex
