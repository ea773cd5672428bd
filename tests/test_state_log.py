"""The state's log, moves as a sink, and runs that break off."""

import os
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.plans.execute import move
from tidemark.sources import move_sink, state
from tidemark.sources.move_sink import MoveSink, carry_out, move_group
from tidemark.sources.state_log import ROWS, StateLog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def content(s):
    return tuple({tuple(r) for r in df.collect()} for df in (s.seen, s.pending, s.processed, s.known_sizes))


def test_log_is_what_its_commits_come_to(spark, tmp_path):
    log = StateLog(spark, str(tmp_path), compact=3)
    assert log.commits() == [] and content(log.state()) == (set(), set(), set(), set())
    log.commit(put(spark, ("hash", 1, "a"), ("hash", 1, "a"), ("size", 1, None), ("path", None, "/p"), ("pending", 7, "/t/x"), ("pending", 8, "/t/y")))
    want = ({(1, "a")}, {(7, "/t/x"), (8, "/t/y")}, {("/p",)}, {(1,)})
    assert content(log.state()) == want
    # a commit that was broken off: its rows are there, but nothing names it
    put(spark, ("hash", 9, "z")).write.parquet(f"{tmp_path}/deltas/commit=1")
    assert content(StateLog(spark, str(tmp_path)).state()) == want
    assert log.commit(put(spark, ("hash", 7, "b"), ("filled", 7, "/t/x"))) == 1
    assert content(log.state()) == ({(1, "a"), (7, "b")}, {(8, "/t/y")}, {("/p",)}, {(1,)})
    log.commit(put(spark, ("pending", 7, "/t/x")))  # the same place again, later
    want = ({(1, "a"), (7, "b")}, {(8, "/t/y"), (7, "/t/x")}, {("/p",)}, {(1,)})
    assert content(log.state()) == want
    log.commit(put(spark, ("hash", 1, "a"), ("size", None, None)))
    assert [c.base for c in log.commits()] == [True] and content(log.state())[:3] == want[:3]
    assert log.rows().select("commit").distinct().count() == 1
    log.commit(put(spark, ("hash", 2, "c")))
    assert [c.number for c in log.commits()] == [4, 5] and (2, "c") in content(log.state())[0]


def test_the_document_is_what_the_log_holds(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"))
    log.commit(put(spark, *(("hash", s, f"{h}") for s in (5, 40, 300) for h in range(s % 7)), ("size", 9, None), ("pending", 9, 'q"\\'), ("path", None, "ä\n")))
    state.save(log.state(), str(tmp_path))
    text = open(tmp_path / config.STATE_FILENAME, encoding="utf-8").read()
    assert text.startswith('{"version": 3, "size_hashes": {"300": ["0", "1", "2", "3", "4", "5"], "40": [')
    seen, pending, processed, sizes = content(state.load(spark, str(tmp_path)))
    assert (seen, pending, processed) == content(log.state())[:3] and sizes == {(5,), (40,), (300,), (9,)}
    state.save(state.empty(spark), str(tmp_path))
    assert content(state.load(spark, str(tmp_path))) == (set(), set(), set(), set())


def files(folder, *names):
    folder.mkdir(parents=True, exist_ok=True)
    for n in names:
        (folder / n).write_text(n)


def listing(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and config.WORK_FOLDER not in p.parts and not p.name.startswith("."))


def test_a_group_is_moved_as_a_whole(tmp_path):
    files(tmp_path / "s", "a", "b", "c")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "taken").write_text("x")
    at = lambda n, m: (str(tmp_path / "s" / n), str(tmp_path / "t" / m))
    got = move_group([at("a", "a"), at("b", "taken/b"), at("c", "c")])
    assert [k for _, k, _ in got] == ["ERROR"] * 3 and "could not be" in got[0][2] and "Error" in got[1][2]
    assert listing(tmp_path) == ["s/a", "s/b", "s/c", "t/taken"]
    move(*at("a", "a"))  # as a task that was lost left it: taken up, and not taken back when a later one fails
    assert move_group([at("a", "a"), at("b", "b")]) == [(at("a", "")[0], None, None), (at("b", "")[0], None, None)]
    assert listing(tmp_path) == ["s/c", "t/a", "t/b", "t/taken"]


def plan_of(spark, tmp_path, groups=6, bad=()):
    files(tmp_path / "s", *(f"{g}{c}" for g in range(groups) for c in "abc"))
    rows = [(str(tmp_path / "s" / f"{g}{c}"), str(tmp_path / ("bad/x" if (g, c) in bad else "t") / f"{g}{c}"), str(g), "archive", "primary" if c == "a" else "companion", c, None, None) for g in range(groups) for c in "abc"]
    return spark.createDataFrame(rows, "path string, destination string, group_id string, action string, role string, ord string, error_kind string, error string")


def test_sink_reports_groups_that_cannot_be_moved(spark, tmp_path):
    (tmp_path / "bad").write_text("a file where a folder is wanted")
    out = carry_out(plan_of(spark, tmp_path, bad={(2, "b"), (4, "a")}), str(tmp_path / "results"))
    assert {r.path[-2:] for r in out.where("error_kind = 'ERROR'").collect()} == {f"{g}{c}" for g in (2, 4) for c in "abc"}
    assert listing(tmp_path / "t") == [f"{g}{c}" for g in (0, 1, 3, 5) for c in "abc"]
    assert listing(tmp_path / "s") == [f"{g}{c}" for g in (2, 4) for c in "abc"]
    assert carry_out(plan_of(spark, tmp_path).limit(0), str(tmp_path / "none")).count() == 0


def test_a_task_that_fails_leaves_no_half_moved_group(spark, tmp_path):
    def breaking(source, target):
        if source.endswith(("3b", "5c")):
            raise RuntimeError("injected")
        move(source, target)

    class Breaking(MoveSink):
        mover = staticmethod(breaking)

        @classmethod
        def name(cls):
            return "breaking"

    with pytest.raises(Exception, match="injected"):
        carry_out(plan_of(spark, tmp_path), str(tmp_path / "results"), Breaking)
    there = listing(tmp_path / "t") if (tmp_path / "t").exists() else []
    assert all(there.count(f"{g}a") == there.count(f"{g}b") == there.count(f"{g}c") for g in range(6)) and not {"3a", "5a"} & set(there)
    assert os.path.exists(tmp_path / "results" / f"aborted-{move_sink.MANIFEST}") and not os.path.exists(tmp_path / "results" / move_sink.MANIFEST)
    again = carry_out(plan_of(spark, tmp_path).where(~F.col("path").isin([str(tmp_path / "s" / n) for n in there])), str(tmp_path / "results"))
    assert again.where("error_kind is not null").count() == 0 and len(listing(tmp_path / "t")) == 18


def args(tmp_path, *more):
    return cli.parser().parse_args(["--source", str(tmp_path / "s"), "--target", str(tmp_path / "t"), "--duplicates", str(tmp_path / "d"), *more])


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from tidemark import cli
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
real, calls = cli.carry_out, []
def killing(plan, results):
    calls.append(1)
    if len(calls) == 2:  # between two commits, with one bundle moved and one half moved
        for r in plan.orderBy("group_id", "path").limit(3).collect():
            os.makedirs(os.path.dirname(r.destination), exist_ok=True)
            os.replace(r.path, r.destination)
        os.kill(os.getpid(), signal.SIGKILL)
    return real(plan, results)
cli.carry_out = killing
at = sys.argv[1]
cli.run(cli.parser().parse_args(["--source", at + "/s", "--target", at + "/t", "--duplicates", at + "/d", "--step", "6"]), spark)
"""


def test_a_killed_run_loses_nothing(spark, tmp_path):
    """SIGKILL between two commits: what was moved is known to the next run, half-moved bundles are finished."""
    for k in range(8):
        for ext in (".HEIC", ".MOV"):
            files(tmp_path / "s", f"IMG_{k}{ext}")
            (tmp_path / "s" / f"IMG_{k}{ext}").write_text(f"{k}{ext}" * (k + 1))
    env = {**os.environ, "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    broken = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path), str(tmp_path / "shared")], cwd=ROOT, env=env, timeout=300, capture_output=True, text=True)
    assert broken.returncode == -signal.SIGKILL, broken.stderr[-2000:]
    moved = [p for p in listing(tmp_path / "t")]
    assert 3 < len(moved) < 16
    (tmp_path / "s" / "again.HEIC").write_text("0.HEIC")  # the content of a file that was moved before
    assert cli.run(args(tmp_path), spark) == 0
    assert listing(tmp_path / "s") == [] and listing(tmp_path / "d") == ["again.HEIC"]
    assert sorted(os.path.basename(p) for p in listing(tmp_path / "t")) == sorted(f"IMG_{k}{e}" for k in range(8) for e in (".HEIC", ".MOV"))
    done = {r.path for r in StateLog(spark, str(tmp_path / "t" / config.WORK_FOLDER / "state")).state().processed.collect()}
    assert done == {str(tmp_path / "s" / f"IMG_{k}{e}") for k in range(8) for e in (".HEIC", ".MOV")} | {str(tmp_path / "s" / "again.HEIC")}


def image(seed, noise=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    grey = np.kron(rng.integers(0, 250, (8, 8)), np.ones((16, 16))) + noise
    return b"P5 128 128 255\n" + grey.astype(np.uint8).tobytes()


def test_visual_duplicates_of_an_earlier_run(spark, tmp_path):
    """And a file that is met under the path of an earlier one, told apart by its version."""
    (tmp_path / "s").mkdir()
    for k in range(3):
        (tmp_path / "s" / f"{k}.jpg").write_bytes(image(k))
    more = ("--phash", "--resume-key", "version")
    assert cli.run(args(tmp_path, *more), spark) == 0
    (tmp_path / "s" / "near.jpg").write_bytes(image(1, 2))
    (tmp_path / "s" / "other.jpg").write_bytes(image(9))
    (tmp_path / "s" / "2.jpg").write_bytes(image(12) + b" ")
    assert cli.run(args(tmp_path, *more), spark) == 0
    assert listing(tmp_path / "d") == ["near.jpg"] and listing(tmp_path / "s") == []
    assert sorted(os.path.basename(p) for p in listing(tmp_path / "t")) == ["0.jpg", "1.jpg", "2.jpg", "2_1.jpg", "other.jpg"]
