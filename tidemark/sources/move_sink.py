"""A Python data sink that carries out moves: ``plan.write.format("moves").option("results", folder).mode("append").save()``.

Rows need path, destination and group_id, the rows of a group side by side in one partition. A group is moved as a whole:
if one of its moves fails, those made before it are taken back, and all its rows are reported as not moved. What became
of each row is a file per task in ``results``, put in place under its last name when the task is done; the driver gets
the file's name and two counts per task, and its commit writes the list of the files that count. A task that is run
again finds moves that were made and counts them as done, so after a lost executor every group is whole.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.plans.execute import move

OUTCOME = "path string, error_kind string, error string"
MANIFEST = "moves.json"


def move_group(rows: list[tuple[str, str]], mover: Callable[[str, str], None] = move) -> list[tuple[str, str | None, str | None]]:
    """path, error kind and error of each row after all of them were moved, or none.

    An error that is none of the file system's takes the group's moves back and goes on to the task.
    """
    done: list[tuple[str, str]] = []

    def undo() -> None:
        for source, target in reversed(done):
            mover(target, source)

    for source, target in rows:
        fresh = os.path.exists(source)
        try:
            mover(source, target)
        except OSError as e:
            undo()
            own = f"{type(e).__name__}: {e}"
            return [(p, "ERROR", own if p == source else f"not moved, as {source} could not be") for p, _ in rows]
        except BaseException:
            undo()
            raise
        if fresh:
            done.append((source, target))
    return [(p, None, None) for p, _ in rows]


@dataclass
class Moved(WriterCommitMessage):
    file: str
    moved: int
    failed: int


class _Writer(DataSourceWriter):
    def __init__(self, results: str, mover: Callable[[str, str], None]):
        self.results, self.mover = results, mover

    def write(self, iterator: Iterator[Row]) -> Moved:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.attemptNumber()}.jsonl"
        os.makedirs(self.results, exist_ok=True)
        counts = [0, 0]
        with open(f"{self.results}/.{name}", "w", encoding="utf-8") as f:
            for _, group in itertools.groupby(iterator, key=lambda r: r["group_id"]):
                for path, kind, error in move_group([(r["path"], r["destination"]) for r in group], self.mover):
                    counts[kind is not None] += 1
                    f.write(json.dumps({"path": path, "error_kind": kind, "error": error}) + "\n")
        os.replace(f"{self.results}/.{name}", f"{self.results}/{name}")
        return Moved(name, *counts)

    def _list(self, messages: list[Moved | None], name: str) -> None:
        told = [m for m in messages if m is not None]
        os.makedirs(self.results, exist_ok=True)
        with open(f"{self.results}/.{name}", "w", encoding="utf-8") as f:
            json.dump({"files": sorted(m.file for m in told), "moved": sum(m.moved for m in told), "failed": sum(m.failed for m in told)}, f)
        os.replace(f"{self.results}/.{name}", f"{self.results}/{name}")

    def commit(self, messages: list[Moved | None]) -> None:
        self._list(messages, MANIFEST)

    def abort(self, messages: list[Moved | None]) -> None:
        """Groups that were moved stay so: they are whole, and the next run finds them. What is known of them is listed."""
        self._list(messages, f"aborted-{MANIFEST}")


class MoveSink(DataSource):
    mover = staticmethod(move)

    @classmethod
    def name(cls) -> str:
        return "moves"

    def schema(self) -> str:
        return "path string, destination string, group_id string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["results"], type(self).mover)


def outcomes(spark: SparkSession, results: str) -> DataFrame:
    """path, error_kind, error of the rows of a sink that has committed."""
    with open(f"{results}/{MANIFEST}", encoding="utf-8") as f:
        files = json.load(f)["files"]
    return spark.read.schema(OUTCOME).json([f"{results}/{n}" for n in files]) if files else spark.createDataFrame([], OUTCOME)


def carry_out(plan: DataFrame, results: str, sink: type[MoveSink] = MoveSink) -> DataFrame:
    """The plan's rows with what became of them: rows that were not moved have error_kind ERROR."""
    spark = plan.sparkSession
    spark.dataSource.register(sink)
    todo = plan.where("action <> 'none'").select("path", "destination", "group_id", "role", "ord")
    todo = todo.repartition("group_id").sortWithinPartitions("group_id", F.desc("role"), "ord").select("path", "destination", "group_id")
    todo.write.format(sink.name()).option("results", results).mode("append").save()
    own = outcomes(spark, results).toDF("path", "own_kind", "own_error")
    out = plan.withColumnsRenamed({"error_kind": "plan_kind", "error": "plan_error"}).join(own, "path", "left")
    named = {"error_kind": F.coalesce("plan_kind", "own_kind"), "error": F.coalesce("plan_error", "own_error")}
    return out.select(*(named[c].alias(c) if c in named else F.col(c) for c in plan.columns))
