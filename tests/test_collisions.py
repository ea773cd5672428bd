"""Copy numbers against a pass in order that follows the template letter by letter."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import collisions, tags
from tidemark.operators.collisions import Numbering, families, numbering


def after(a):
    """The text that comes after a in a, b ... z, aa, ab ..."""
    if not a:
        return "a"
    return a[:-1] + chr(ord(a[-1]) + 1) if a[-1] != "z" else after(a[:-1]) + "a"


def in_order(template, rows, taken):
    """rows of (folder, stem, extension): the first unused name of each, by trying one copy after the other."""
    taken, out = set(taken), []
    for folder, f, e in rows:
        copy, letters = 0, "a"
        while True:
            m = collisions.COPY.search(template)
            sign, w, dot, w2, kind = m.groups()
            text = ""
            if copy or dot:
                width = max(int(w or 0), int(w2 or 0))
                text = {"-": "-", "+": "_"}.get(sign, "") + ((letters.upper() if kind == "u" else letters).rjust(width, "A" if kind == "u" else "a") if kind in ("l", "u") else str(copy + (kind == "n")).zfill(width))
            name = (template[: m.start()] + text + template[m.end() :]).replace("%f", f).replace("%e", e)
            if (folder, name) not in taken:
                break
            copy, letters = copy + 1, after(letters)
        taken.add((folder, name))
        out.append(name)
    return out


TEMPLATES = ["%f%+c.%e", "%f%-c.%e", "%f%c.%e", "%f%nc.%e", "%f%+3.c.%e", "%f%-.2nc.%e", "%f%-lc.%e", "%f%+.uc.%e", "%f%lc.%e", "x%c.txt", "%f%-3nc", "%f%-3lc.%e", "%f%.2uc.%e", "x%-2lc.%e", "x%2uc", "%f%-cZ.%e", "x%-:2cZ.y.txt", "%c.txt", "%c%f.x".replace("%f", "1"), "%f%+2lc Z"]


@pytest.mark.parametrize("template", TEMPLATES)
def test_unused_names_equal_a_pass_in_order(spark, template):
    rng = random.Random(template)
    stems = ["a", "a_1", "a-1", "a1", "a2", "a_001", "a-b", "ab", "a_B", "a10", "a_1_1", "IMG_0001", "IMG_0002", "z", "1"]
    rows = [(rng.choice("pq"), rng.choice(stems[: rng.choice([3, 15])]), rng.choice(["x", "y"])) for _ in range(160)]
    taken = {(rng.choice("pq"), rng.choice(stems) + rng.choice(["", "_1", "-2", "3", "-c", "_A", "_002", "-02", "b", "-aab", "-1Z", "Z", "-ab"]) + rng.choice([".x", ".y", "", ".txt", "Z.y.txt", " Z"])) for _ in range(60)}
    df = spark.createDataFrame([(k, f"/{d}/{f}.{e}") for k, (d, f, e) in enumerate(rows)], "ord bigint, path string")
    there = spark.createDataFrame([(f"/{d}", n) for d, n in taken], "folder string, name string")
    got = [r.name for r in tags.unused_names(df, "%d" + template, "path", "ord", there).orderBy("ord").collect()]
    assert got == [f"/{d}/{n}" for (d, _, _), n in zip(rows, in_order(template, rows, taken), strict=True)]


def test_numbers_and_letters(spark):
    for how in (Numbering(), Numbering("-", 3, 1, True), Numbering("", letters="lower"), Numbering("_", always=True, letters="upper"), Numbering("-", 3, letters="lower"), Numbering("", 2, always=True, letters="upper")):
        df = spark.range(0, 2000, 7).withColumn("t", how.column(F.col("id"))).withColumn("back", how.copy_of(F.col("t")))
        for r in df.collect():
            assert r.t == how.text(r.id) and r.back == r.id
    letters = [Numbering("", letters="lower", always=True).text(k) for k in range(800)]
    want = [""]
    for _ in range(800):
        want.append(after(want[-1]))
    assert letters == want[1:] and letters[25:28] == ["z", *(string.ascii_lowercase[0] + c for c in "ab")]
    for bad in ("%f.%e", "%f%c%c.%e", "%c%f.%e", "%f%8lc.%e", "%f%c%e", "%f%c/x"):
        with pytest.raises(ValueError):
            numbering(bad)


def test_names_by_place_equal_a_pass_in_order(spark):
    rng = random.Random(5)
    rows = [(k * 3, None if k % 50 == 9 else f"/{rng.choice('ppppq')}/{rng.choice('ab')}.x") for k in range(300)]
    df = spark.createDataFrame(rows, "ord bigint, path string").withColumns({"part": F.lit(1), "before": F.lit(2), "name": F.lit("n")}).repartition(5)
    got = tags.sequence_names(df, "%d%f_%2C_%-7.3C_%-.2uC_%-.2nC%%.%e")
    assert {r.ord: r.name for r in got.collect()} == by_place(rows)
    assert got.columns == ["ord", "path", "part", "before", "name"] and tags.sequence_names(df.limit(0), "%C").count() == 0
    # with a copy number after it: names of the same place in two folders
    flat = {r.ord: r.name for r in tags.unused_names(df, "/o/%-.3C%-c.%e").collect()}
    met, want = {}, {}
    for o, p in rows:
        if p:
            at = sum(1 for o2, p2 in rows if o2 < o and p2 and p2[:3] == p[:3])
            n = met[at] = met.get(at, -1) + 1
            want[o] = f"/o/{at:03d}{'-' + str(n) if n else ''}.x"
    assert {o: n for o, n in flat.items() if n} == want
    for bad in ("%:C", "%-3:2C"):
        with pytest.raises(ValueError):
            tags.sequence_names(df, bad)
    with pytest.raises(ValueError):
        tags.output_name("%C", F.col("path"))


def by_place(rows):
    of_all, of_folder, out = 0, {}, {}
    for o, p in rows:
        folder = p[:3] if p else None
        k = of_folder.get(folder, 0)
        letters = ""
        for _ in range(k + 1):
            letters = after(letters)
        out[o] = f"{p[:-2]}_{of_all + 2}_{k + 7:03d}_{letters.upper().rjust(2, 'A')}_{k + 1:02d}%.x" if p else None
        of_all, of_folder[folder] = of_all + 1, k + 1
    return out


def test_camera_names_are_no_family(spark):
    rows = spark.range(1000).select(F.lit("d").alias("dir"), F.format_string("IMG_%04d", "id").alias("stem"), F.lit(".HEIC").alias("suffix"))
    got = families(rows, rows.limit(0), Numbering())
    assert got.select("dir", "family", "suffix").distinct().count() == 1000
    # numbers that copies do have: a family only with the name that they are copies of, if that one has copies
    rows = rows.withColumn("stem", F.regexp_replace("stem", "_0+", "_"))
    assert families(rows, rows.limit(0), Numbering()).select("family").distinct().count() == 1000
    twice = rows.union(spark.createDataFrame([("d", "IMG", ".HEIC")] * 2, rows.schema))
    assert families(twice, rows.limit(0), Numbering()).select("family").distinct().count() == 2  # IMG with 1 ... 999, and IMG_, which was IMG_0000


@pytest.mark.parametrize("holes", [[], [0], [1, 2, 5, 40, 41], list(range(0, 400, 3))])
def test_one_name_of_many_rows_is_many_tasks(spark, holes):
    n, how = 900, Numbering()
    df = spark.range(n).select(F.col("id").alias("ord"), F.lit("d").alias("folder"), F.lit("a.jpg").alias("name")).repartition(6)
    there = spark.createDataFrame([("d", f"a{how.text(k)}.jpg") for k in holes] + [("d", "other.jpg"), ("e", "a.jpg")], "folder string, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = collisions.unique_names(df, existing=there)
        free = (k for k in range(n + 500) if k not in set(holes))
        assert [r.final_name for r in out.orderBy("ord").collect()] == [f"a{how.text(next(free))}.jpg" for _ in range(n)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    cut = collisions.running(df.select(F.lit("d").alias("k"), "ord"), ["k"], ["ord"], F.lit(1), collisions.Scratch(spark, "test"), "cut")
    assert [r.before for r in cut.orderBy("ord").collect()] == list(range(n))


def test_rows_without_a_name_get_none(spark):
    df = spark.createDataFrame([(1, "d", None, "x"), (2, None, "a", "y"), (3, "d", "a", "z")], "ord bigint, folder string, name string, stem string")
    got = {r.ord: (r.final_name, r.stem) for r in collisions.unique_names(df).collect()}
    assert got == {1: (None, "x"), 2: (None, "y"), 3: ("a", "z")}


def test_copies_go_on_beyond_their_width(spark):
    """Numbers of two digits go on with 100, letters with AAA after ZZ, and no name is given twice."""
    rows = spark.range(760).select(F.col("id").alias("ord"), F.lit("/in/a.jpg").alias("path"))
    there = spark.createDataFrame([], "folder string, name string")
    for template, at, want in (("/out/%f%-2nc.%e", 99, "/out/a-100.jpg"), ("/out/%f%+.uc.%e", 702, "/out/a_AAA.jpg")):
        got = {r.ord: r.name for r in tags.unused_names(rows, template, "path", "ord", there).collect()}
        assert got[at] == want and len(set(got.values())) == 760


@pytest.mark.parametrize(("name", "template", "numbers", "writes"), [("copy_letters", "%f%+.uc.%e", 50, 702), ("copy_numbers", "%f%-2nc.%e", 9, 99)])
def test_copies_equal_their_sql_as_far_as_that_can_write_them(spark, tmp_path, name, template, numbers, writes):
    """The SQL can write so many copies of a name; those after them are named in order too, each once."""
    duckdb, how = pytest.importorskip("duckdb"), numbering(template)[1]
    spark.range(760).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.name for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    taken = {("/out", f"red_bolt{how.text((k % 50 + 1) % numbers)}.jpg") for k in range(0, 760, 4)}
    assert [got[k] for k in range(760)] == [f"/out/{n}" for n in in_order(template, [("/out", "red_bolt", "jpg")] * 760, taken)]
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    sql, able = dict(con.execute(catalog.SQL[name]).fetchall()), {f"/out/red_bolt{how.text(k)}.jpg" for k in range(writes)}
    assert {k: n for k, n in got.items() if n in able} == {k: n for k, n in sql.items() if got[k] in able}
    assert sorted(sql) == list(range(760)) and len(set(got.values())) == 760 and not set(got.values()) <= able


def test_names_are_worked_out_once(spark):
    """However often names are asked for, what they are made of is worked out once for all rows, and once for those taken."""
    met, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counter(acc):
        def seen(n):
            acc.add(1)
            return f"a{n % 7}.jpg"

        return F.udf(seen, "string")

    rows = spark.range(300).select(F.col("id").alias("ord"), F.lit("d").alias("folder"), counter(asked)("id").alias("name"))
    there = spark.range(100).select(F.lit("d").alias("folder"), counter(met)("id").alias("name"))
    out = collisions.unique_names(rows, existing=there)
    got = {r.ord: r.final_name for r in out.select("ord", "final_name").collect()}
    assert [got[k] for k in (0, 7, 14)] == ["a0_1.jpg", "a0_2.jpg", "a0_3.jpg"] and len(set(got.values())) == 300
    assert (asked.value, met.value) == (300, 100)
