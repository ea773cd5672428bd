"""Carrying out a plan in steps, each committed to the state's log before the next one begins.

The plan is written first, dealt to steps by bundle, and its commit tells that it is under way. After a step's moves its
delta is committed. A run that breaks off between two commits, however it ends, loses nothing: ``recover`` looks which rows of
the steps that were not committed were moved all the same, finishes bundles that are half moved, and commits those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.archive import Plan
from tidemark.plans.execute import carried_out
from tidemark.sources import move_sink
from tidemark.sources.band_index import BandIndex
from tidemark.sources.state_log import StateLog, step_rows

#: About as many rows are moved between two commits.
STEP = 100_000
Mover = Callable[[DataFrame, str], DataFrame]


def _plan_at(log: StateLog, run: str) -> str:
    return f"{log.folder}/plans/{run}"


def _index(rows: DataFrame, index: BandIndex | None, batch: int) -> None:
    """Put the fingerprints of what a run archived in the index; a run that is met again replaces its own part."""
    if index is not None:
        kept = rows.where("role = 'primary' and action = 'archive' and error_kind is null and code is not null")
        index.append(kept.select("code", F.col("destination").alias("lead")), batch)


def run_in_steps(plan: Plan, log: StateLog, step: int = STEP, mover: Mover = move_sink.carry_out, index: BandIndex | None = None) -> DataFrame:
    """The plan's rows with what became of them."""
    spark, run = log.spark, log.new_run()
    steps = max(1, math.ceil(plan.rows.count() / step))
    dealt = plan.rows.withColumn("step", F.pmod(F.xxhash64("group_id"), F.lit(steps)).cast("int"))
    dealt.write.mode("overwrite").partitionBy("step").parquet(_plan_at(log, run))
    written = spark.read.schema(dealt.schema).parquet(_plan_at(log, run))
    begun = log.commit(plan.refilled, f"plan:{run}:{steps}")
    results = f"{log.folder}/results/{run}"
    for k in range(steps):
        moved = mover(written.where(F.col("step") == k).drop("step"), f"{results}/moves-{k}")
        moved.write.mode("overwrite").parquet(f"{results}/rows/step={k}")
        log.commit(step_rows(spark.read.schema(plan.rows.schema).parquet(f"{results}/rows/step={k}")), f"step:{run}:{k}")
    done = spark.read.schema(plan.rows.schema).parquet(*(f"{results}/rows/step={k}" for k in range(steps)))
    _index(done, index, begun)
    log.commit(plan.refilled.limit(0), f"end:{run}")
    return done


def recover(log: StateLog, index: BandIndex | None = None) -> int:
    """Commit what the last run moved without committing it; returns the number of such rows. Nothing to do gives 0."""
    left = log.open_run()
    if left is None:
        return 0
    run, steps, done = left
    begun = next(c.number for c in log.commits() if c.label == f"plan:{run}:{steps}")
    written = log.spark.read.parquet(_plan_at(log, run))
    todo = written.where(~F.col("step").isin(sorted(done))) if done else written
    found = carried_out(todo)
    # a bundle of which a part was moved is finished
    begun_groups = found.where("action <> 'none'").select("group_id").distinct()
    move_sink.carry_out(todo.join(begun_groups, "group_id", "left_semi"), f"{log.folder}/results/{run}/recovered")
    found = carried_out(todo)
    rows = found.where("action <> 'none'").count()
    log.commit(step_rows(found), f"late:{run}")
    _index(carried_out(written), index, begun)
    log.commit(step_rows(found).limit(0), f"end:{run}")
    return rows
