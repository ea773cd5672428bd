"""Pairs of fingerprints by pivots, and the index of earlier runs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hamming, neardup
from tidemark.sources.band_index import BandIndex
from tidemark.tables import Scratch

FULL = 2**64 - 1


def signed(v):
    return v if v < 2**63 else v - 2**64


def near(a, b):
    return bin((a ^ b) & FULL).count("1")


def flipped(rng, v, most):
    return v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))


def clusters(seed, count, each, most=6):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(count)]
    return sorted({flipped(rng, v, most) for v in base for _ in range(each)} | {0, FULL})


def codes(spark, values):
    return spark.createDataFrame([(signed(v),) for v in values], "code bigint")


@pytest.mark.parametrize("threshold, pivots, block", [(12, None, 4096), (12, 7, 10), (20, 7, 10), (33, 1, 16)])
def test_pivot_pairs_equal_brute_force(spark, threshold, pivots, block):
    values = clusters(threshold, 12, 12)
    got = [tuple(r) for r in hamming.pivot_pairs(codes(spark, values), threshold, pivots=pivots, block=block).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for k, a in enumerate(values) for b in values[:k] if near(a, b) <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_pivots_pass_over_most_of_clustered_codes(spark):
    values = clusters(3, 60, 60, 5)
    n = len(values)
    assert hamming.compared(codes(spark, values), 12, pivots=60) < 0.15 * n * n / 2
    assert hamming.compared(codes(spark, []), 12) == 0
    assert hamming.pivot_pairs(codes(spark, []), 20).count() == hamming.pivot_pairs(codes(spark, [5]), 20).count() == 0


@pytest.mark.parametrize("threshold", [4, 10, 20])
def test_no_plan_holds_a_cartesian_product(spark, threshold):
    rows = codes(spark, clusters(4, 6, 6)).withColumn("ord", F.monotonically_increasing_id())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (neardup.hamming_pairs(rows, threshold), neardup.nearest_leader(rows, threshold), neardup.leaders(rows, threshold), hamming.code_pairs(rows.select("code"), threshold)):
            plan = df._jdf.queryExecution().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pass_in_order(values, threshold, kept=()):
    kept, out = list(kept), []
    for v in values:
        out.append(all(near(v, x) > threshold for x in kept))
        if out[-1]:
            kept.append(v)
    return out


def test_leaders_of_odd_rows(spark):
    """Null codes, repeated rows, and columns with the names that the operator uses itself."""
    rng = random.Random(8)
    values = [flipped(rng, v, 9) for v in clusters(5, 4, 8)] * 2
    rows = spark.createDataFrame([(k, signed(v), 1, "x", 2) for k, v in enumerate(values)] + [(999, None, 1, "x", 2)], "ord bigint, code bigint, lead int, leader string, o int")
    got = neardup.leaders(rows, 20)
    assert got.columns == ["ord", "code", "lead", "leader", "o", "is_leader"]
    assert [r.is_leader for r in got.orderBy("ord").collect()] == [*pass_in_order(values, 20), True]
    assert neardup.leaders(rows.limit(0), 20).count() == neardup.nearest_leader(rows.limit(0), 20).count() == 0


@pytest.mark.parametrize("threshold", [0, 4, 10, 15])
def test_index_of_earlier_runs(spark, tmp_path, threshold):
    rng = random.Random(threshold)
    base = clusters(threshold, 8, 3, 3)
    runs = [[flipped(rng, rng.choice(base), threshold // 2 + 2) for _ in range(25)] for _ in range(2)]
    index, kept = BandIndex(spark, str(tmp_path / "index"), threshold), []
    assert index.near(codes(spark, runs[0]), 0).count() == 0
    for batch, values in enumerate(runs):
        for _ in range(2 if batch == 1 else 1):  # a batch that is run again finds what it found before
            found = index.near(codes(spark, values), batch)
            want = {}
            for v in set(values):
                there = [(near(v, x), name) for x, name in kept if near(v, x) <= threshold]
                if there:
                    want[signed(v)] = min(there)
            assert {r.code: (r.distance, r.leader) for r in found.collect()} == want
            rows = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(values)], "ord bigint, code bigint")
            lead = neardup.leaders(rows, threshold, known=found)
            assert [r.is_leader for r in lead.orderBy("ord").collect()] == pass_in_order(values, threshold, [x for x, _ in kept])
            index.append(lead.where("is_leader").select("code", F.format_string("%d-%03d", F.lit(batch), "ord").alias("lead")), batch)
        kept += [(v, f"{batch}-{k:03d}") for k, (v, stays) in enumerate(zip(values, pass_in_order(values, threshold, [x for x, _ in kept]), strict=True)) if stays]


def test_only_buckets_that_bands_meet_are_read(spark, tmp_path):
    index = BandIndex(spark, str(tmp_path), 4)
    rows = codes(spark, [random.Random(k).getrandbits(64) for k in range(300)])
    index.append(rows.withColumn("lead", F.col("code")), 0)
    one = rows.limit(1)
    assert index.near(one, 1).count() == 1
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    assert files(index.met(one, 1)[0]) <= 5 < 70 < files(spark.read.parquet(index.at))
    assert index.near(rows.limit(0), 1).count() == 0
    assert index.size(1) == 300 and index.size(0) == 0 == BandIndex(spark, str(tmp_path / "none"), 4).size(1)
    with pytest.raises(ValueError):
        BandIndex(spark, str(tmp_path), 16)


def test_scratch_tables_are_emptied(spark):
    held = Scratch(spark, "test")
    df, n = held.counted(spark.range(5), "five")
    assert (df.count(), n) == (5, 5)
    held.drop("five", "none")
    assert spark.read.parquet(f"{held.root}/five").count() == 0


@pytest.mark.parametrize("threshold", [0, 1, 2, 5, 7, 10, 11])
def test_band_pairs_equal_brute_force_and_come_once(spark, threshold):
    reach = hamming.reaches(threshold, min(hamming.BANDS, threshold + 1))
    assert sum(r + 1 for r in reach) == threshold + 1
    values = clusters(40 + threshold, 6, 8, 7)
    got = [tuple(r) for r in hamming.code_pairs(codes(spark, values), threshold).select("a", "b").collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for k, a in enumerate(values) for b in values[:k] if near(a, b) <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_band_joins_are_cut_by_comparisons(spark):
    """More tasks with more codes, and few of the codes are met: one in some 960 at 7 bits, where 8 bands had one in 32."""
    reach = hamming.reaches(7, 4)
    assert reach == [1, 1, 1, 1] and hamming.reaches(10, 4) == [2, 2, 2, 1]
    assert hamming.tasks(spark, 4_000_000, 4_000_000, reach) > 4 * hamming.tasks(spark, 1_000_000, 1_000_000, reach) / 1.01
    assert hamming.masks(16, 2)[0] == 0 and len(set(hamming.masks(16, 2))) == 137


def test_index_is_asked_for_each_value_once(spark, tmp_path):
    """At 10 bits 3 bands of 137 values and one of 17 a code, and every leader within 10 bits is found."""
    rng = random.Random(77)
    kept = [rng.getrandbits(64) for _ in range(40)]
    new = sorted({flipped(rng, v, 12) for v in kept for _ in range(3)})
    index = BandIndex(spark, str(tmp_path), 10)
    index.append(codes(spark, kept).withColumn("lead", F.col("code").cast("string")), 0)
    assert index.met(codes(spark, new), 1)[1].count() == (3 * 137 + 17) * len(new)
    got = {r.code: r.distance for r in index.near(codes(spark, new), 1).collect()}
    best = {signed(v): min(near(v, k) for k in kept) for v in new}
    assert got == {v: d for v, d in best.items() if d <= 10}
