"""Pairs of 64-bit fingerprints within any Hamming distance.

Two ways, by threshold t:

* up to ``PROBE_LIMIT`` bits: in one of four bands of 16 bits (fewer and wider ones below 3 bits) a pair differs in two bits
  at most, so an equi-join finds it where one side has all values up to as many bits off. The bits are dealt over the bands
  (10 bits: 2, 2, 2 and 1), and the join is cut in tasks by the comparisons it is to make;
* beyond: pivots. Codes go to the nearest of a bounded number of pivots. A code is sent to another group only if that may
  hold one within t: by the triangle inequality against the least and largest distance of the group's codes to its
  pivot, and by the hyperplane between the two pivots (a code near its own pivot, and nearer by more than 2t than to the
  other one, has nothing within t there). Groups and what is sent to them are dealt in blocks of bounded size, and a
  task compares two blocks by exclusive or and bit counts over whole arrays.

On codes with structure, such as those of similar images, few groups are asked. Codes that are drawn evenly lie about 32
bits apart, so that from some 20 bits on no bound can pass over a group, and the join compares nearly every block with
every other: quadratic, as any exact method is there, but in blocks, without a Cartesian product of rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import bands, distance
from tidemark.tables import Scratch

#: Above this distance the bands of an index, one more than the distance, have under 8 bits and prune nothing.
BAND_LIMIT = 7
#: Greatest distance at which one of four bands of 16 bits differs in two bits at most.
PROBE_LIMIT = 11
#: Most bands of a join; rows and comparisons of a task.
BANDS, ROWS, MET = 4, 1 << 20, 1 << 24
#: Most pivots, whose groups' summaries are what tasks are given, and codes of a block.
PIVOTS, BLOCK = 1024, 4096


@dataclass
class Groups:
    """Pivots, and of the codes in each one's group: their number and their least and largest distance to it."""

    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every code of a to every one of b."""
    return np.bitwise_count(a[:, None] ^ b[None, :])


def spread_out(codes: np.ndarray, count: int) -> np.ndarray:
    """Codes that lie apart: the first, then always the one farthest from all taken, while there are different ones."""
    taken, far = [0], _bits(codes[:1], codes)[0]
    while len(taken) < count and far.max():
        taken.append(int(far.argmax()))
        far = np.minimum(far, _bits(codes[taken[-1:]], codes)[0])
    return codes[taken]


def homes(codes: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each code, the first of equal ones, and the distance to it."""
    g, d, step = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32), max(1, (1 << 22) // max(1, len(pivots)))
    for k in range(0, len(codes), step):
        far = _bits(codes[k : k + step], pivots)
        g[k : k + step] = far.argmin(1)
        d[k : k + step] = far.min(1)
    return g, d


def asked(groups: Groups, codes: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """Mask (code, group) of the groups that may hold a code within the threshold: the own one, and others of larger
    number, so that two groups meet in one of them."""
    far = _bits(codes, groups.pivots).astype(np.int32)
    own = np.take_along_axis(far, home[:, None], 1)
    may = (far <= groups.high + threshold) & (far >= groups.low - threshold) & (far - own <= 2 * threshold) & (groups.size > 0)
    may &= np.arange(len(groups.pivots))[None, :] > home[:, None]
    np.put_along_axis(may, home[:, None], True, 1)
    return may


def _codes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _homing(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, d = homes(_codes(batch.column(0)), pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g), pa.array(d)], ["code", "home", "d"])

    return run


def _routing(shared, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                may = asked(shared.value, _codes(part.column(0)), part.column(1).to_numpy(), threshold)
                ends = np.concatenate([[0], np.cumsum(may.sum(1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(may)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["code", "home", "groups"])

    return run


def _comparing(threshold: int):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (_codes(t["code"].combine_chunks()) for t in (left, right))
        own = left["own"].to_numpy()
        found, step = [np.zeros((0, 2), np.int64)], max(1, (1 << 22) // max(1, len(b)))
        for k in range(0, len(a), step):
            i, j = np.nonzero(_bits(a[k : k + step], b) <= threshold)
            pair = np.stack([a[k + i], b[j]], 1).view(np.int64)
            # within a group both orders meet
            found.append(np.sort(pair[~own[k + i] | (pair[:, 0] < pair[:, 1])], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compare


def _cells(codes: DataFrame, threshold: int, held: Scratch, pivots: int | None, block: int) -> tuple[DataFrame, DataFrame] | None:
    """Asking and asked codes, each with the cell (h, b, c) in which they meet; None without codes."""
    spark = codes.sparkSession
    count = codes.count()
    if not count:
        return None
    wanted = pivots or min(PIVOTS, math.isqrt(count) + 1)
    some = codes.orderBy(F.xxhash64("code"), "code").limit(8 * wanted).collect()  # a bounded number
    centre = spread_out(np.array([r[0] for r in some], np.int64).view(np.uint64), wanted)
    home = held.keep(codes.mapInArrow(_homing(centre), "code bigint, home int, d int"), "homes")
    groups = Groups(centre, *(np.zeros(len(centre), np.int64) for _ in range(3)))
    for r in home.groupBy("home").agg(F.count("*"), F.min("d"), F.max("d")).collect():  # a row per pivot
        groups.size[r[0]], groups.low[r[0]], groups.high[r[0]] = r[1:]
    shared = spark.sparkContext.broadcast(groups)
    routed = home.select("code", "home").mapInArrow(_routing(shared, threshold), "code bigint, home int, groups array<int>")
    if count <= block:  # every group, and all that is sent to it, is one block
        whole = (F.lit(0).alias("b"), F.lit(0).alias("c"), "code")
        left = routed.select("code", "home", F.explode("groups").alias("h")).select("h", *whole, (F.col("home") == F.col("h")).alias("own"))
        return left, home.select(F.col("home").alias("h"), *whole)
    routed = held.keep(routed, "routes")
    sent = {r[0]: r[1] for r in routed.select(F.explode("groups").alias("h")).groupBy("h").count().collect()}  # a row per pivot
    deal = F.broadcast(spark.createDataFrame([(h, math.ceil(int(groups.size[h]) / block), math.ceil(n / block)) for h, n in sent.items()], "h int, parts int, turns int"))
    of = lambda seed, n: F.pmod(F.xxhash64("code", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.select("code", "home", F.explode("groups").alias("h")).join(deal, "h").select("h", every("parts").alias("b"), of(1, "turns").alias("c"), "code", (F.col("home") == F.col("h")).alias("own"))
    right = home.select("code", F.col("home").alias("h")).join(deal, "h").select("h", of(2, "parts").alias("b"), every("turns").alias("c"), "code")
    return left, right


def pivot_pairs(codes: DataFrame, threshold: int, held: Scratch | None = None, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct codes a < b within the threshold, by pivots; ``codes`` has one bigint column of distinct codes."""
    held = held or Scratch(codes.sparkSession, "hamming")
    cells = _cells(codes, threshold, held, pivots, block)
    if cells is None:
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b"))
    left, right = (side.groupBy("h", "b", "c") for side in cells)
    return left.cogroup(right).applyInArrow(_comparing(threshold), "a bigint, b bigint")


def compared(codes: DataFrame, threshold: int, pivots: int | None = None, block: int = BLOCK) -> int:
    """How many comparisons ``pivot_pairs`` takes, from the sizes of its cells."""
    cells = _cells(codes, threshold, Scratch(codes.sparkSession, "hamming"), pivots, block)
    if cells is None:
        return 0
    left, right = (side.groupBy("h", "b", "c").agg(F.count("*").alias(n)) for side, n in zip(cells, "xy", strict=True))
    return left.join(right, ["h", "b", "c"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).head()[0]


def reaches(threshold: int, count: int) -> list[int]:
    """Bits that each of ``count`` bands may differ in, so that two patterns within the threshold agree so far in one of
    them at least: with r of a band, the sum of r + 1 is the threshold plus 1. -1: the band is not needed."""
    return [(threshold + 1) // count + (k < (threshold + 1) % count) - 1 for k in range(count)]


def edges(count: int) -> list[int]:
    """Where the bands of ``bands`` begin and end."""
    return [64 * k // count for k in range(count + 1)]


def masks(width: int, reach: int) -> list[int]:
    """All patterns of up to ``reach`` bits."""
    return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(width), n)]


def band_masks(reach: list[int]) -> Column:
    """array<array<bigint>>: by band, what a value is off by; empty for bands that are not needed."""
    at = edges(len(reach))
    lists = [masks(at[k + 1] - at[k], r) for k, r in enumerate(reach)]
    return F.from_json(F.lit(str(lists)), "array<array<bigint>>")


def band_rows(codes: DataFrame, count: int, reach: list[int] | None = None) -> DataFrame:
    """code, band, value: the ``count`` bands of each code, and all values up to as many bits off as ``reach`` says by band."""
    parts = codes.select("*", F.explode(bands(F.col("code"), count)).alias("p")).select("*", "p.band", "p.value").drop("p")
    if reach and any(reach):
        off = F.explode(F.get(band_masks(reach), F.col("band")))
        parts = parts.select("*", off.alias("off")).withColumn("value", F.col("value").bitwiseXOR(F.col("off"))).drop("off")
    return parts


def tasks(spark: SparkSession, asking: int, asked: int, reach: list[int]) -> int:
    """Tasks of a join by bands, so that each has a bounded number of rows to sort and, of codes that are drawn evenly, to
    compare. Spark alone would go by bytes, which are few beside the comparisons."""
    at = edges(len(reach))
    values = [(math.comb(at[k + 1] - at[k], n), at[k + 1] - at[k]) for k, r in enumerate(reach) for n in range(r + 1)]
    rows = asking * sum(n for n, _ in values) + asked * len(reach)
    met = asking * asked * sum(n / 2.0**w for n, w in values)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS), math.ceil(met / MET))


def _band_pairs(codes: DataFrame, threshold: int) -> DataFrame:
    """Distinct codes a < b within the threshold, by bands: one side is probed, and a pair is told by its first band."""
    reach = reaches(threshold, min(BANDS, threshold + 1))
    at, n = edges(len(reach)), codes.count()
    parts = tasks(codes.sparkSession, n, n, reach)
    a, b = (band_rows(codes, len(reach), r).withColumnRenamed("code", side).repartition(parts, "band", "value") for side, r in (("a", reach), ("b", None)))
    x = F.col("a").bitwiseXOR(F.col("b"))
    part = lambda k: F.bit_count(F.shiftrightunsigned(x, at[k]).bitwiseAND(F.lit((1 << (at[k + 1] - at[k])) - 1)))
    sooner = F.lit(False)
    for k, r in enumerate(reach[:-1]):
        sooner = sooner | ((F.col("band") > k) & (part(k) <= r))
    met = a.join(b.hint("merge"), ["band", "value"])
    return met.where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= threshold) & ~sooner).select("a", "b")


def code_pairs(codes: DataFrame, threshold: int, held: Scratch | None = None) -> DataFrame:
    """Distinct codes a < b within the threshold, with their distance; codes has one bigint column ``code``."""
    pairs = pivot_pairs(codes, threshold, held) if threshold > PROBE_LIMIT else _band_pairs(codes, threshold)
    return pairs.select("a", "b", distance(F.col("a"), F.col("b")).alias("distance"))
