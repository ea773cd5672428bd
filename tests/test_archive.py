import json
import os
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.config import ArchiveConfig
from tidemark.functions.fingerprints import decode, fingerprint
from tidemark.plans import execute as ex
from tidemark.plans.archive import plan_archive
from tidemark.sources import files, metadata, state
from tidemark.sources.state_log import StateLog, state_rows
from tidemark.streaming.incremental import dedup_stream

CFG = ArchiveConfig("/t", "/d")
SCHEMA = "path string, ord string, size bigint, mtime timestamp, content binary, meta map<string,string>, code bigint"


def rows(spark, *given):
    out = [(p, p, None if c is None else len(c), datetime(2020, 2, 1), None if c is None else c.encode(), m, code) for p, c, m, code in given]
    return spark.createDataFrame(out, SCHEMA)


def test_plan_bundles_duplicates_and_counters(spark):
    dated = {"EXIF:DateTimeOriginal": "2024:01:15 10:30:45"}
    plan = plan_archive(
        rows(spark, ("/s/IMG_1.HEIC", "aa", dated, None), ("/s/IMG_1.MOV", "m", None, None), ("/s/IMG_E1.AAE", "s", None, None), ("/s/z.jpg", "aa", None, None), ("/s/y.jpg", "unique!", None, None), ("/s/note.txt", "t", None, None), ("/s/bad.jpg", None, None, None)),
        CFG,
    )
    got = {r.path: (r.action, r.destination) for r in plan.rows.collect()}
    assert got == {
        "/s/IMG_1.HEIC": ("archive", "/t/2024/01/IMG_1.HEIC"),
        "/s/IMG_1.MOV": ("archive", "/t/2024/01/IMG_1.MOV"),
        "/s/IMG_E1.AAE": ("archive", "/t/2024/01/IMG_E1.AAE"),
        "/s/z.jpg": ("duplicate", "/d/z.jpg"),
        "/s/y.jpg": ("archive", "/t/2020/02/y.jpg"),
        "/s/bad.jpg": ("none", None),
    }
    c = plan.counters.head().asDict()
    assert c == dict(scanned=7, moved=2, duplicates=1, visual_duplicates=0, sidecars_paired=1, livephotos_paired=1, skipped=1, resumed=0, date_from_mtime=1, failed=0, errored=1)
    assert plan.exit_code().head()[0] == 2
    assert [r.path for r in plan.failures().collect()] == ["/s/bad.jpg"]


def test_same_names_do_not_collide(spark):
    plan = plan_archive(rows(spark, ("/a/x.jpg", "1", None, None), ("/b/x.jpg", "22", None, None)), CFG, existing=spark.createDataFrame([("/t/2020/02", "x_1.jpg")], "folder string, name string"))
    assert sorted(r.destination for r in plan.rows.collect()) == ["/t/2020/02/x.jpg", "/t/2020/02/x_2.jpg"]


def test_visual_duplicates(spark):
    plan = plan_archive(rows(spark, ("/a.jpg", "1", None, 0xFF00), ("/b.jpg", "22", None, 0xFF01)), ArchiveConfig("/t", "/d", True, 4))
    assert {r.path: r.action for r in plan.rows.collect()} == {"/a.jpg": "archive", "/b.jpg": "visual_duplicate"}


def test_second_run_fills_in_missing_hashes(spark):
    first = plan_archive(rows(spark, ("/s/a.jpg", "x" * 50, None, None)), CFG)
    assert first.rows.head().hash_status == "not_needed"
    after = first.next_state()
    assert [tuple(r) for r in after.pending.collect()] == [(50, "/t/2020/02/a.jpg")]
    again = lambda text, there=True: plan_archive(
        rows(spark, ("/s/a.jpg", "x" * 50, None, None), ("/s/b.jpg", text, None, None)), CFG, after, pending_hasher=lambda df: df.withColumn("md5", F.md5(F.lit("x" * 50).cast("binary")) if there else F.lit(None).cast("string"))
    )
    second = again("x" * 50)
    assert {r.path: r.action for r in second.rows.collect()} == {"/s/b.jpg": "duplicate"}
    assert second.counters.head().resumed == 1 and second.next_state().pending.count() == 0
    assert {r.path: r.action for r in again("y" * 50).rows.collect()} == {"/s/b.jpg": "archive"}
    assert {r.path: r.action for r in again("x" * 50, False).rows.collect()} == {"/s/b.jpg": "archive"}


@pytest.mark.parametrize(
    "text, seen, known, pending, processed",
    [
        ("{ not json", set(), set(), set(), set()),
        ('{"processed_hashes":["aa","bb"],"processed_paths":["D:/a.jpg"]}', set(), set(), set(), {"D:/a.jpg"}),
        ('{"version":2,"size_hashes":{"100":["aa"],"200":[]},"processed_paths":["D:/a.jpg"]}', {(100, "aa")}, {100, 200}, set(), {"D:/a.jpg"}),
        ('{"version":3,"size_hashes":{"100":["aa","bb"],"250":[]},"size_pending":{"250":["D:/x.jpg"]},"processed_paths":["D:/x.jpg"]}', {(100, "aa"), (100, "bb")}, {100, 250}, {(250, "D:/x.jpg")}, {"D:/x.jpg"}),
    ],
)
def test_state_documents(spark, tmp_path, text, seen, known, pending, processed):
    (tmp_path / config.STATE_FILENAME).write_text(text)
    s = state.load(spark, str(tmp_path))
    check = lambda s: ({tuple(r) for r in s.seen.collect()}, {r[0] for r in s.known_sizes.collect()}, {tuple(r) for r in s.pending.collect()}, {r[0] for r in s.processed.collect()})
    assert check(s) == (seen, known, pending, processed)
    out = str(tmp_path / "out")
    state.save(s, out)
    doc = json.load(open(f"{out}/{config.STATE_FILENAME}"))
    assert doc["version"] == 3 and doc["processed_paths"] == sorted(processed)
    assert check(state.load(spark, out)) == (seen, known, pending, processed)
    kept = StateLog(spark, str(tmp_path / "log"))
    kept.commit(state_rows(s))
    assert check(kept.state()) == (seen, known, pending, processed)


def test_missing_state_is_empty(spark, tmp_path):
    assert state.load(spark, str(tmp_path)).processed.count() == 0
    assert StateLog(spark, str(tmp_path)).state().seen.count() == 0


def tree(root, **names):
    for name, content in names.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        os.utime(path, (1580000000, 1580000000))


def arguments(tmp_path, *more):
    return cli.parser().parse_args(["--source", str(tmp_path / "s"), "--target", str(tmp_path / "t"), "--duplicates", str(tmp_path / "d"), *more])


def found(root):
    return {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and p.name != config.STATE_FILENAME and config.WORK_FOLDER not in p.parts}


def test_scan(spark, tmp_path):
    tree(tmp_path, a_dot_jpg="1", sub__b_dot_jpg="", _dot_hid__c_dot_jpg="3", _dot_x="4", Thumbs_dot_db="5", skip__d_dot_jpg="6")
    got = {r.path: r.size for r in files.scan(spark, str(tmp_path), [str(tmp_path / "skip")]).collect()}
    assert got == {f"{tmp_path}/a.jpg": 1, f"{tmp_path}/sub/b.jpg": 0, f"{tmp_path}/.hid/c.jpg": 1}
    with pytest.raises(Exception, match="does not exist"):
        files.scan(spark, str(tmp_path / "none")).collect()


def test_scan_of_a_deep_tree_is_many_tasks(spark, tmp_path):
    for k in range(80):
        folder = tmp_path / "one" / "two" / f"{k % 8}" / f"{k}"
        folder.mkdir(parents=True)
        (folder / "x.jpg").write_text("x")
    for at in (tmp_path, tmp_path / "one", tmp_path / "one" / "two" / "3"):
        (at / "y.jpg").write_text("yy")
    want = sorted(str(p) for p in tmp_path.rglob("*.jpg"))
    for share in (1, 7, 1000):  # folders that a task has no share left for go to other tasks
        got = [r.path for r in files.walk(spark, str(tmp_path), share=share).collect()]
        assert sorted(got) == want and len(got) == 83


def test_what_a_walk_enters(spark, tmp_path, monkeypatch):
    tree(tmp_path, a_dot_jpg="1", a_dot_txt="2", sub__b_dot_JPG="", sub__deep__c_dot_jpg="3", _dot_hid__d_dot_jpg="4", skip__e_dot_jpg="5", cut__f_dot_jpg="6", else__g_dot_jpg="7")
    (tmp_path / "sub" / "up").symlink_to(tmp_path)
    (tmp_path / "link").symlink_to(tmp_path / "else")
    (tmp_path / "broken.jpg").symlink_to(tmp_path / "nowhere")
    look = lambda **k: sorted(os.path.relpath(r.path, tmp_path) for r in files.walk(spark, str(tmp_path), share=2, **k).collect())
    every = [".hid/d.jpg", "a.jpg", "a.txt", "broken.jpg", "cut/f.jpg", "else/g.jpg", "skip/e.jpg", "sub/b.JPG", "sub/deep/c.jpg"]
    assert look() == every
    assert look(accept=["jpg"], ignore=["skip"], prune=[str(tmp_path / "cut")], hidden=False) == ["a.jpg", "broken.jpg", "else/g.jpg", "sub/b.JPG", "sub/deep/c.jpg"]
    assert look(depth=0) == ["a.jpg", "a.txt", "broken.jpg"] and look(depth=1) == [p for p in every if p.count("/") < 2]
    assert look(follow=True) == sorted([*every, "link/g.jpg"])
    bad = files.walk(spark, str(tmp_path)).where("path like '%broken%'").head()
    assert bad.size is None and "NotFound" in bad.stat_error
    # the driver lists nothing: it cannot
    monkeypatch.setattr(os, "scandir", None)
    assert look(accept=["txt"]) == ["a.txt"]


def test_two_runs_end_to_end(spark, tmp_path):
    tree(tmp_path, s__a_dot_jpg="x" * 100, s__sub__IMG_1_dot_HEIC="h", s__sub__IMG_1_dot_MOV="m")
    assert cli.run(arguments(tmp_path, "--dry-run", "--report", str(tmp_path / "r.json")), spark) == 0
    assert found(tmp_path / "s") == {"a.jpg", "sub/IMG_1.HEIC", "sub/IMG_1.MOV"} and not (tmp_path / "t").exists()
    assert json.load(open(tmp_path / "r.json"))["stats"]["moved"] == 2
    assert cli.run(arguments(tmp_path), spark) == 0
    assert found(tmp_path / "t") == {"2020/01/a.jpg", "2020/01/IMG_1.HEIC", "2020/01/IMG_1.MOV"} and not found(tmp_path / "s")
    tree(tmp_path, s__b_dot_jpg="x" * 100, s__c_dot_jpg="y" * 100)
    assert cli.run(arguments(tmp_path), spark) == 0
    assert found(tmp_path / "d") == {"b.jpg"} and "2020/01/c.jpg" in found(tmp_path / "t")
    assert cli.run(cli.parser().parse_args(["--source", str(tmp_path / "none"), "--target", "/t", "--duplicates", "/d"]), spark) == 2


def test_paths_are_checked():
    for bad in (("/a", "/a", "/d"), ("/a", "/b", "/b"), ("/b/c", "/b", "/d")):
        with pytest.raises(config.ConfigError):
            config.check_paths(*bad)
    config.check_paths("/a", "/a/t", "/a/d")


def test_moves_between_volumes(tmp_path, monkeypatch):
    import errno

    tree(tmp_path, a="1")
    real, calls = os.replace, []

    def replace(a, b):
        calls.append(a)
        if len(calls) == 1:
            raise OSError(errno.EXDEV, "other volume")
        real(a, b)

    monkeypatch.setattr(os, "replace", replace)
    ex.move(str(tmp_path / "a"), str(tmp_path / "x/b"))
    assert found(tmp_path) == {"x/b"}
    ex.move(str(tmp_path / "a"), str(tmp_path / "x/b"))  # again: done already
    monkeypatch.setattr(os, "replace", lambda a, b: (_ for _ in ()).throw(OSError(errno.EACCES, "no")))
    with pytest.raises(OSError):
        ex.move(str(tmp_path / "x/b"), str(tmp_path / "c"))
    assert found(tmp_path) == {"x/b"}


def test_failed_copy_leaves_nothing(tmp_path, monkeypatch):
    import errno

    tree(tmp_path, a="1")
    monkeypatch.setattr(os, "replace", lambda a, b: (_ for _ in ()).throw(OSError(errno.EXDEV, "other volume")))
    with pytest.raises(OSError):
        ex.move(str(tmp_path / "a"), str(tmp_path / "b"))
    assert found(tmp_path) == {"a"}


READER = """import sys, json
args = []
for line in sys.stdin:
    line = line.rstrip("\\n")
    if line == "-execute":
        paths = [a for a in args if not a.startswith("-")]
        print(json.dumps([{"SourceFile": p, "EXIF:DateTimeOriginal": "2022:03:04 05:06:07", "n": 5} for p in paths if "none" not in p]))
        print("{ready}", flush=True)
        args = []
    elif line == "False":
        break
    else:
        args.append(line)
"""


def test_tag_reader(spark, tmp_path):
    script = tmp_path / "reader"
    script.write_text(f"#!{sys.executable}\n{READER}")
    script.chmod(0o755)
    df = spark.createDataFrame([("C:\\A.jpg",), ("/none.jpg",)], "path string")
    got = {r.path: r.meta for r in metadata.read_tags(df, str(script)).collect()}
    assert got["/none.jpg"] is None and got["C:\\A.jpg"]["EXIF:DateTimeOriginal"] == "2022:03:04 05:06:07" and got["C:\\A.jpg"]["n"] == "5"
    assert {r.meta for r in metadata.read_tags(df, str(tmp_path / "absent")).collect()} == {None}
    talk = metadata.conversation(str(script))
    assert next(talk) == {} and set(talk.send(["/X.jpg"])) == {"/x.jpg"} and talk.send(["/none"]) == {}
    talk.close()
    started = []

    def spawn(*a, **k):
        started.append(subprocess.Popen(*a, **k))
        return started[-1]

    def killing():
        for k in range(5):
            if started:
                started[-1].kill()
                started[-1].wait()
            yield [f"/{k}.jpg"]

    # a process that was killed is found gone when it is asked: the batch has no second try, as it is one file
    assert [set(r) for r in metadata.answers(str(script), killing(), 1, spawn)] == [{"/0.jpg"}, set(), {"/2.jpg"}, set(), set()]
    assert len(started) == 2 and all(p.poll() is not None for p in started)


def test_files_of_a_failed_batch_are_asked_one_by_one(spark, tmp_path):
    script = tmp_path / "reader"
    script.write_text(f"#!{sys.executable}\n" + READER.replace("        print(json", "        if any('bad' in p for p in paths):\n            sys.exit(1)\n        print(json", 1))
    script.chmod(0o755)
    ask = lambda *paths: {r.path: r.meta is not None for r in metadata.read_tags(spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1), str(script)).collect()}
    assert ask("/a.jpg", "/bad.jpg", "/c.jpg") == {"/a.jpg": True, "/bad.jpg": False, "/c.jpg": True}
    # a reader that ended too often is asked no more: the fourth file that ends it is the last that is asked
    assert ask("/bad1", "/bad2", "/bad3", "/bad4", "/c.jpg") == {"/bad1": False, "/bad2": False, "/bad3": False, "/bad4": False, "/c.jpg": False}


def test_header_time():
    import struct

    ifd = struct.pack("<HHHII", 1, 0x0132, 2, 20, 26) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd
    tiff += b"\0" * (26 - len(tiff)) + b"2011:12:13 14:15:16\0"
    assert metadata.header_time(tiff) == "2011:12:13 14:15:16"
    assert metadata.header_time(b"\xff\xd8\xff\xe1..Exif\0\0" + tiff) == "2011:12:13 14:15:16"
    assert metadata.header_time(b"no") is None and metadata.header_time(None) is None and metadata.header_time(b"II*\0") is None


def test_sidecar_time(spark):
    row = spark.createDataFrame([("<plist><date>2021-02-03T04:05:06Z</date></plist>",), ("<x/>",)], "x string")
    got = [r[0] for r in row.select(metadata.sidecar_time(F.col("x"))).collect()]
    assert got == [datetime(2021, 2, 3, 4, 5, 6), None]


def test_fingerprints():
    import numpy as np

    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))
    raw = b"P5 128 128 255\n" + image.astype(np.uint8).tobytes()
    assert decode(raw).shape == (128, 128) and decode(b"nothing") is None
    a, b, c = fingerprint(image), fingerprint(np.clip(image + 3, 0, 255)), fingerprint(rng.integers(0, 255, (128, 128)))
    bits = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert len(a) == 16 and bits(a, b) <= 4 < bits(a, c)


def test_stream_remembers_earlier_batches(spark, tmp_path):
    source, seen = tmp_path / "in", {}
    source.mkdir()
    stream = spark.readStream.schema("id bigint, text string").json(str(source))
    sink = lambda df, batch: seen.update({r.id: r.is_duplicate for r in df.collect()})

    def run():
        q = dedup_stream(stream, str(tmp_path / "state"), F.col("text"), "id", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    (source / "1.json").write_text('{"id":1,"text":"a"}\n{"id":2,"text":"a"}\n')
    run()
    (source / "2.json").write_text('{"id":3,"text":"a"}\n{"id":4,"text":"b"}\n')
    run()
    assert seen == {1: False, 2: True, 3: True, 4: False}


def test_an_interrupted_run_keeps_what_it_moved(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(4):
        (source / f"p{k}.jpg").write_bytes(b"x" * (k + 1))
    args = cli.parser().parse_args(["--source", str(source), "--target", str(target), "--duplicates", str(tmp_path / "dup")])

    def half(plan, results):
        rows = plan.orderBy("path").limit(2).collect()
        for r in rows:
            ex.move(r.path, r.destination)
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "carry_out", half)
    with pytest.raises(KeyboardInterrupt):
        cli.run(args, spark)
    assert {r.path for r in state.load(spark, str(target)).processed.collect()} == {str(source / f"p{k}.jpg") for k in (0, 1)}
    monkeypatch.undo()
    assert cli.run(args, spark) == 0
    assert not list(source.iterdir()) and sorted(p.name for p in target.rglob("*.jpg")) == [f"p{k}.jpg" for k in range(4)]


def test_embedded_times_are_used(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    when = b"2011:03:04 05:06:07\x00"
    tiff = b"II*\x00" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x0132).to_bytes(2, "little") + (2).to_bytes(2, "little") + len(when).to_bytes(4, "little") + (26).to_bytes(4, "little") + bytes(4) + when
    (source / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1\x00\x40Exif\x00\x00" + tiff)
    assert cli.run(cli.parser().parse_args(["--source", str(source), "--target", str(target), "--duplicates", str(tmp_path / "dup")]), spark) == 0
    assert (target / "2011" / "03" / "a.jpg").exists()


def test_images_that_cannot_be_decoded_are_refused_or_told(spark, tmp_path, monkeypatch, caplog):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.jpg").write_bytes(b"no image")
    (tmp_path / "s" / "b.mov").write_bytes(b"no image either")
    (tmp_path / "s" / ".c.jpg").write_bytes(b"hidden")
    monkeypatch.setattr(cli.importlib.util, "find_spec", lambda _: None)
    with pytest.raises(config.ConfigError, match="1 images"):
        cli.run(arguments(tmp_path, "--phash"), spark)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == [".c.jpg", "a.jpg", "b.mov"]
    monkeypatch.setattr(cli.importlib.util, "find_spec", lambda _: object())
    with caplog.at_level("WARNING"):
        assert cli.run(arguments(tmp_path, "--phash", "--dry-run"), spark) == 0
    assert "1 images cannot be decoded" in caplog.text


def test_the_tag_program_is_looked_for_on_the_search_path(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    assert arguments(tmp_path).exiftool is None
    program = tmp_path / cli.READER
    program.write_text("#!/bin/sh\n")
    program.chmod(0o755)
    assert arguments(tmp_path).exiftool == str(program)
    assert arguments(tmp_path, "--exiftool", "other").exiftool == "other"
