"""The stream with state per size equals the batch operators, its ledger included, across restarts."""

import hashlib
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exact
from tidemark.sources.files import md5_of_file
from tidemark.streaming.stateful import dedup_by_size, known_hashes, ledger


def batches(seed, count=3, n=25):
    rng = random.Random(seed)
    out = []
    for b in range(count):
        rows = [(b * 100 + k, rng.choice("abcd") * rng.choice([1, 2, 3, rng.randint(4, 60)])) for k in range(n)]
        out.append(rows + [(b * 100 + 98, None), (b * 100 + 99, "")])
    return out


def start(spark, stream, at, out):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_stream_with_state_equals_batches(spark, tmp_path):
    given = batches(5)
    source, at, out = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out")
    source.mkdir()
    stream = spark.readStream.schema("id bigint, text string, md5_ string").json(str(source))
    size = F.octet_length(F.col("text").cast("binary")).cast("bigint")
    seen, pending, known = (spark.createDataFrame([], s) for s in ("size bigint, md5 string", "size bigint, archived_path bigint", "size bigint"))
    want = {}
    for b, rows in enumerate(given):  # each start goes on from the checkpoint
        (source / f"{b}.json").write_text("".join(json.dumps({"id": i, "text": t}) + "\n" for i, t in rows))
        start(spark, dedup_by_size(stream.withColumn("size", size), "id", content=F.col("text")).drop("text"), at, out)
        # the batch operators, with the state of earlier batches
        df = spark.createDataFrame(rows, "ord bigint, text string").withColumn("size", size)
        hashed = exact.with_hash(exact.hash_candidates(df, known.union(pending.select("size"))), F.col("text"))
        old = {i: t for r in given[:b] for i, t in r}
        fill = lambda p, old=old: spark.createDataFrame([(r.size, hashlib.md5(old[r.archived_path].encode()).hexdigest()) for r in p.collect()], "size bigint, md5 string")
        extra, rest = exact.backfill(pending, hashed, fill)
        judged = exact.first_wins(hashed, seen.union(extra)).collect()
        want |= {r.ord: (r.size, r.md5, r.hash_status, r.is_duplicate) for r in judged}
        keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
        fresh = [(r.size, r.md5) for r in judged if r.md5 is not None and r.size is not None]
        seen = keep(seen.union(extra).union(spark.createDataFrame(fresh, "size bigint, md5 string")).distinct())
        pending = keep(rest.union(spark.createDataFrame([(r.size, r.ord) for r in judged if r.hash_status == "not_needed"], "size bigint, archived_path bigint")))
        known = keep(known.union(df.where("size is not null").select("size")).distinct())
        got = {r.id: (r.size, r.md5, r.hash_status, r.is_duplicate) for r in spark.read.parquet(out).collect()}
        assert got == want
        assert {(r.size, int(r.ord)) for r in ledger(spark, at).collect()} == {tuple(r) for r in pending.collect()}
        assert {(r.size, r.md5) for r in known_hashes(spark, at).collect()} == {tuple(r) for r in seen.collect()}


def test_files_are_hashed_only_once_their_size_recurs(spark, tmp_path):
    source, at, out = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out")
    source.mkdir()
    names = {n: str(tmp_path / n) for n in "abcde"}
    for n, text in {"a": "xx", "b": "gone!", "c": "xx", "d": "after", "e": "alone."}.items():
        (tmp_path / n).write_text(text)
    stream = spark.readStream.schema("path string, size bigint").json(str(source))

    def feed(k, *given):
        (source / f"{k}.json").write_text("".join(json.dumps({"path": names[n], "size": os.path.getsize(names[n])}) + "\n" for n in given))
        start(spark, dedup_by_size(stream, "path", path_col="path", hasher=md5_of_file), at, out)

    feed(0, "a", "b", "e")
    os.remove(names["b"])  # what its ledger entry points at is gone when it is due
    feed(1, "c", "d")
    got = {r.path[-1]: (r.hash_status, r.is_duplicate) for r in spark.read.parquet(out).collect()}
    assert got == {"a": ("not_needed", False), "b": ("not_needed", False), "c": ("ok", True), "d": ("ok", False), "e": ("not_needed", False)}
    assert [r.path for r in ledger(spark, at).collect()] == [names["e"]]
    assert Counter(r.size for r in known_hashes(spark, at).collect()) == {2: 1, 5: 1}


def test_what_must_be_given(spark):
    df = spark.createDataFrame([], "id bigint, size bigint")
    for bad in ({}, {"hasher": md5_of_file}, {"content": F.col("id"), "hasher": md5_of_file, "path_col": "id"}):
        with pytest.raises(ValueError):
            dedup_by_size(df, "id", **bad)
