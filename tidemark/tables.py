"""Tables that cut the lineage, in the folder that driver and executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine whose session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/") if at else FALLBACK_DIR


def fresh(stem: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever a user calls theirs."""
    taken, name = {c.lower() for df in tables for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run alone below the shared one."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df in tasks of so many rows, for work that costs much a row: files, and Spark's own joining of partitions, go by bytes."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps start from files that survive an executor."""
    path = fresh_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that cut the lineage of one run of an operator, emptied once nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.schemas = spark, fresh_folder(spark, label), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, over an earlier table of this name, and read it back."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.schemas[name] = df.schema
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``keep``, and the number of rows as the write met them."""
        seen = Observation()
        return self.keep(df.observe(seen, F.count(F.lit(1)).alias("rows")), name), seen.get["rows"]

    def drop(self, *names: str) -> None:
        """Put no rows in place of the tables of these names, where there are such."""
        for name in names:
            if schema := self.schemas.pop(name, None):
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}")
