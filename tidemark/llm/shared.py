"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables that cut the lineage go when the session names no shared folder (tests only).
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else FALLBACK_DIR


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan above starts from files every executor can reach."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that cut the lineage of one run of an operator, emptied as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.schemas = spark, f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.schemas[name] = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Put no rows in place of the tables of these names, where there are such."""
        for name in names:
            if schema := self.schemas.pop(name, None):
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}")


def crc_mod(column: str, m: int):
    """crc32 of the id as decimal text, modulo m; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)
