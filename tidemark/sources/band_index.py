"""Fingerprints that earlier runs kept, on disk by band, so that a run finds visual duplicates of all runs before it.

A leader has a row per band. The rows of a batch are written once, under ``bands=M/batch=N/band=B/bucket=V``, where the
bucket is the low bits of the band's value. A search reads only the buckets that bands of the new codes fall in (partition
pruning), joins on band and value, and verifies distances. A batch that is written again after a failure replaces its own
part, and a search reads only batches before the one it is for, so a repeated run finds the same leaders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import distance
from tidemark.operators.hamming import BAND_LIMIT, band_masks, band_rows, reaches, tasks

#: Buckets of a band, a power of two: with the bands it bounds the folders of a batch.
BUCKETS = 16
#: Largest threshold that an index serves: beyond, values within reach of a band are too many.
MOST = 15
_ROWS = "value bigint, code bigint, lead string, batch int, band int, bucket int"


class BandIndex:
    """An index for searches within ``threshold`` bits, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int):
        if not 0 <= threshold <= MOST:
            raise ValueError(f"an index serves thresholds of 0 to {MOST} bits")
        self.spark, self.threshold = spark, threshold
        self.bands = threshold + 1 if threshold <= BAND_LIMIT else 4
        self.reach = reaches(threshold, self.bands)  # one band differs in no more bits
        self.at = f"{folder.rstrip('/')}/bands={self.bands}"

    def append(self, leaders: DataFrame, batch: int) -> None:
        """Write what a batch kept: code and lead (what the row is known by, as text)."""
        rows = band_rows(leaders.where("code is not null").select("code", F.col("lead").cast("string").alias("lead")), self.bands)
        rows = rows.withColumn("bucket", F.col("value").bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        rows.repartition("band", "bucket").write.mode("overwrite").partitionBy("band", "bucket").parquet(f"{self.at}/batch={batch}")

    def rows(self, before: int) -> DataFrame | None:
        """The index's rows of batches before this one; None if nothing was ever written."""
        try:
            return self.spark.read.schema(_ROWS).parquet(self.at).where(F.col("batch") < before)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def size(self, before: int) -> int:
        """How many leaders the index holds of batches before this one."""
        held = self.rows(before)
        return 0 if held is None else held.where("band = 0").count()

    def met(self, codes: DataFrame, before: int) -> tuple[DataFrame, DataFrame] | None:
        """The index's rows in the buckets that the codes' bands fall in, and the values that are asked for."""
        held = self.rows(before)
        if held is None:
            return None
        codes = codes.where("code is not null").select("code").distinct()
        asked = band_rows(codes, self.bands, self.reach).withColumnRenamed("code", "own")
        low = F.col("value").bitwiseAND(F.lit(BUCKETS - 1))
        own = band_rows(codes, self.bands).select("band", low.alias("low")).distinct()
        bucket = F.explode(F.transform(F.get(band_masks(self.reach), F.col("band")), lambda off: off.bitwiseXOR(F.col("low")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))
        wanted: dict[int, list[int]] = {}
        for r in own.select("band", bucket.alias("bucket")).distinct().collect():  # bands * BUCKETS rows at most
            wanted.setdefault(r.band, []).append(r.bucket)
        if not wanted:
            held = held.limit(0)
        elif any(len(v) < BUCKETS for v in wanted.values()) or len(wanted) < self.bands:
            held = held.where(reduce(lambda x, y: x | y, ((F.col("band") == b) & F.col("bucket").isin(v) for b, v in wanted.items())))
        return held, asked

    def near(self, codes: DataFrame, before: int) -> DataFrame:
        """code, leader, distance: for each distinct code with a leader of an earlier batch within the threshold, the
        nearest one, of equal ones that of the smallest name."""
        both = self.met(codes, before)
        if both is None:
            return codes.select("code", F.lit(None).cast("string").alias("leader"), F.lit(None).cast("int").alias("distance")).limit(0)
        # rows of the index, and those that are asked for, are sorted in tasks of bounded size
        held, asked = both
        n = tasks(self.spark, codes.select("code").distinct().count(), self.size(before), self.reach)
        held, asked = (side.repartition(n, "band", "value") for side in (held, asked))
        met = held.join(asked.hint("merge"), ["band", "value"]).select("own", "lead", distance(F.col("code"), F.col("own")).alias("distance"))
        best = met.where(F.col("distance") <= self.threshold).groupBy("own").agg(F.min(F.struct("distance", "lead")).alias("x"))
        return best.select(F.col("own").alias("code"), F.col("x.lead").alias("leader"), F.col("x.distance").alias("distance"))
