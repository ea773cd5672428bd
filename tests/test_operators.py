import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import collisions, exact, filters, grouping, neardup, tags


def items(spark, *paths):
    return spark.createDataFrame(list(enumerate(paths)), "ord bigint, path string")


@pytest.mark.parametrize(
    "paths, groups, primary",
    [
        (["/x/IMG_1234.HEIC"], 1, "/x/IMG_1234.HEIC"),
        (["/x/IMG_1234.MOV", "/x/IMG_1234.HEIC"], 1, "/x/IMG_1234.HEIC"),
        (["/x/IMG_1234.HEIC", "/x/IMG_E1234.AAE"], 1, "/x/IMG_1234.HEIC"),
        (["/x/IMG_1234.HEIC", "/x/IMG_1234.MOV", "/x/IMG_E1234.JPG", "/x/IMG_E1234.AAE"], 1, "/x/IMG_1234.HEIC"),
        (["/a/IMG_1.HEIC", "/b/IMG_1.HEIC"], 2, None),
        (["/x/IMG_1234.HEIC", "/x/img_1234.MOV"], 1, "/x/IMG_1234.HEIC"),
        (["/x/only.AAE"], 1, "/x/only.AAE"),
        ([], 0, None),
    ],
)
def test_grouping(spark, paths, groups, primary):
    got = grouping.group_files(items(spark, *paths)).collect()
    assert len(got) == groups
    assert sum(len(g.companions) for g in got) == len(paths) - groups
    if primary:
        assert got[0].primary.path == primary
    flat = grouping.with_roles(items(spark, *paths))
    assert flat.where("role = 'primary'").count() == groups


def sized(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord bigint, size bigint, content string")


def test_hash_candidates(spark):
    pick = lambda df: {r.ord for r in df.collect() if r.is_candidate}
    assert pick(exact.hash_candidates(sized(spark, (100, "a"), (200, "b"), (300, "c")))) == set()
    assert pick(exact.hash_candidates(sized(spark, (100, "x"), (100, "y"), (200, "b")))) == {0, 1}
    assert pick(exact.hash_candidates(sized(spark, (None, "x"), (200, "b")))) == {0}
    assert pick(exact.hash_candidates(sized(spark, (100, "x"), (200, "b")), spark.createDataFrame([(100,)], "size bigint"))) == {0}


def test_first_wins_with_history(spark):
    rows = exact.with_hash(exact.hash_candidates(sized(spark, (1, "x"), (1, "x"), (1, "y"), (2, "zz"), (1, None))), F.col("content"))
    got = {r.ord: (r.is_duplicate, r.hash_status) for r in exact.first_wins(rows).collect()}
    assert got == {0: (False, "ok"), 1: (True, "ok"), 2: (False, "ok"), 3: (False, "not_needed"), 4: (False, "failed")}
    seen = rows.where("ord = 2").select("size", "md5")
    assert {r.ord for r in exact.first_wins(rows, seen).collect() if r.is_duplicate} == {1, 2}


def test_size_first_agrees_with_hashing_everything(spark):
    rng = random.Random(3)
    rows = [(len(t), t) for t in ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(300))]
    df = sized(spark, *rows)
    a = exact.first_wins(exact.with_hash(exact.hash_candidates(df), F.col("content")))
    b = exact.dedup_all_hashes(df, F.col("content"))
    assert {r.ord for r in a.collect() if r.is_duplicate} == {r.ord for r in b.collect() if r.is_duplicate}


def codes(spark, values):
    return spark.createDataFrame([(k, v if v is None or v < 2**63 else v - 2**64) for k, v in enumerate(values)], "ord bigint, code bigint")


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("threshold", [0, 4, 8, 11, 12, 64])
def test_hamming_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(42)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for v in base for _ in range(3)]
    got = {tuple(r) for r in neardup.hamming_pairs(codes(spark, values), threshold).collect()}
    want = {(i, j, near(values[i], values[j])) for i in range(len(values)) for j in range(i + 1, len(values)) if near(values[i], values[j]) <= threshold}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    values = [rng.getrandbits(64)]
    for _ in range(150):  # walks make long chains of neighbours
        values.append(rng.choice(values) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    rng.shuffle(values)
    kept, want = [], set()
    for k, v in enumerate(values):
        if all(near(v, x) > 4 for x in kept):
            kept.append(v)
            want.add(k)
    rows = codes(spark, [*values, None])
    assert {r.ord for r in neardup.leaders(rows, 4).collect() if r.is_leader} == want | {len(values)}
    best = {r.ord: (r.leader, r.distance) for r in neardup.nearest_leader(rows, 4).collect()}
    assert set(best) == set(range(len(values))) - want
    for k, (lead, d) in best.items():
        assert (d, lead) == min((near(values[k], values[j]), j) for j in want if j < k)


def test_chain_keeps_every_other(spark):
    assert [r.is_leader for r in neardup.leaders(codes(spark, [0, 0xF, 0xFF, 0xFFF]), 4).orderBy("ord").collect()] == [True, False, True, False]


def test_within_is_sorted(spark):
    got = neardup.within(codes(spark, [0, 1, 3, 7, 15]), F.lit(0).cast("bigint"), 3).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def sequential(rows, taken=()):
    taken, out = set(taken), []
    for folder, name in rows:
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        free, k = name, 0
        while (folder, free) in taken:
            k += 1
            free = f"{stem}_{k}{dot}{ext}"
        taken.add((folder, free))
        out.append(free)
    return out


def test_collisions(spark):
    rows = [("d", "a.jpg"), ("d", "a_1.jpg"), ("d", "a.jpg"), ("d", "a.jpg"), ("e", "a.jpg"), ("d", "a_1.jpg"), ("d", "b"), ("d", "b"), ("d", "a_1_1.jpg")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord bigint, folder string, name string")
    assert [r.final_name for r in collisions.unique_names(df).orderBy("ord").collect()] == sequential(rows)
    there = [("d", "a_2.jpg"), ("d", "b")]
    existing = spark.createDataFrame(there, "folder string, name string")
    assert [r.final_name for r in collisions.unique_names(df, existing=existing).orderBy("ord").collect()] == sequential(rows, there)


def test_collisions_random(spark):
    rng = random.Random(9)
    rows = [(rng.choice("de"), rng.choice(["a", "a_1", "a_2", "a_1_1", "b"]) + rng.choice([".x", ".y", ""])) for _ in range(200)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord bigint, folder string, name string")
    assert [r.final_name for r in collisions.unique_names(df).orderBy("ord").collect()] == sequential(rows)


def test_a_name_that_all_share_is_many_tasks(spark):
    rows = [("d", "a.jpg")] * 300 + [("d", "b_1.x"), ("d", "b.x"), ("d", "b.x"), ("e", "c")] + [("e", "a.jpg")] * 40
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord bigint, folder string, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [r.final_name for r in collisions.unique_names(df).orderBy("ord").collect()] == sequential(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    there = spark.createDataFrame([("d", "a_7.jpg")], "folder string, name string")
    assert [r.final_name for r in collisions.unique_names(df, existing=there).orderBy("ord").collect()] == sequential(rows, [("d", "a_7.jpg")])
    assert collisions.unique_names(df.limit(0)).count() == 0


def test_extension_filter(spark):
    df = items(spark, "/a.JPG", "/b.mov", "/c", "/d.heic")
    pick = lambda **k: [r.path for r in filters.by_extension(df, **k).orderBy("ord").collect()]
    assert pick() == ["/a.JPG", "/b.mov", "/c", "/d.heic"]
    assert pick(accept=["jpg"]) == ["/a.JPG"]
    assert pick(reject=["jpg"]) == ["/b.mov", "/c", "/d.heic"]
    assert pick(accept=["mov"], reject=["*"]) == ["/b.mov"]
    assert pick(accept=["*"], reject=["mov"]) == ["/a.JPG", "/c", "/d.heic"]


def test_tags(spark):
    df = spark.createDataFrame([("b", {"n": "10", "t": "x"}), ("a", {"n": "9"}), ("c", {"n": "img9"}), ("d", {"n": "img10"}), ("e", {})], "name string, meta map<string,string>")
    assert [r.name for r in tags.sort_by(df, "meta", ["n"], "name").collect()] == ["a", "b", "c", "d", "e"]
    assert [r.name for r in tags.sort_by(df, "meta", ["-n"], "name").collect()] == ["e", "d", "c", "b", "a"]
    assert tags.all_tags(df, "meta") == ["n", "t"]
    assert [tuple(r) for r in tags.spread(df, "meta", "name", ["n", "t"]).orderBy("SourceFile").collect()][0] == ("a", "9", "")
    js = spark.createDataFrame([("1.5",), ("True",), ("007",), ('q"\n',)], "v string").select(tags.json_scalar(F.col("v"))).collect()
    assert [r[0] for r in js] == ["1.5", "true", '"007"', '"q\\"\\n"']
    left, right = (spark.createDataFrame(x, "t string, v string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in tags.difference(left, right).collect()} == {("b", "2", "3"), ("c", None, "4")}
    item = spark.range(1).select(tags.list_item(F.array(F.lit(1), F.lit(2)), 0), tags.list_item(F.array(F.lit(1), F.lit(2)), -1), tags.list_item(F.array(F.lit(1)), 5)).head()
    assert tuple(item) == (1, 2, None)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_sections(spark, parts):
    """Against a plain loop, whatever the ranges are, some of them empty."""
    rng = random.Random(parts)
    rows = [(k, {"a": str(rng.choice([1, 1, 1, 2])), **({"b": "x"} if rng.random() < 0.7 else {}), "k": str(k)}) for k in sorted(rng.sample(range(1000), 35))]
    want, last = [], None
    for n, (k, m) in enumerate(rows):
        if not n:
            want.append((k, f"H{k}"))
        if last is None or last[0] != m["a"]:
            want += [(k, f"E{last[1]}")] if last else []
            want.append((k, f"S{m['a']}"))
        if "b" in m:
            want.append((k, f"B{k} x"))
        last = m["a"], k
    want += [(last[1], f"E{last[1]}"), (last[1], f"T{last[1]}")]
    df = spark.createDataFrame(rows, "o int, meta map<string,string>").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = tags.sections(df, "meta", "o", "B$k $b", "H$k", "S$a", ["b"], "E$k", "T$k")
        assert [(r.o, r.line) for r in got.orderBy("o", "seq").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tags.sections(df.limit(0), "meta", "o", "$k").count() == 0
    assert [r.line for r in tags.sections(df, "meta", "o", "$k").orderBy("o").collect()] == [str(k) for k, _ in rows]


def test_columns_have_a_budget(spark):
    df = spark.createDataFrame([("a", {f"t{k}": "1" for k in range(20)})], "name string, meta map<string,string>")
    assert len(tags.spread_all(df, "meta", "name", 20).columns) == 21
    with pytest.raises(ValueError, match="more than 19"):
        tags.spread_all(df, "meta", "name", 19)


def test_elected_in_bundles_of_any_size(spark):
    rows = [(k, None if k % 5 == 0 else k % 3, "x", 7) for k in range(60)]
    got = grouping.elected(spark.createDataFrame(rows, "ord int, key int, role_ string, own_key int"), ["key"], F.col("ord") % 2, "ord").collect()
    for r in got:
        mine = [o for o, k, *_ in rows if k == r.key]
        assert (r.primary_ord, r.group_ord, r.members) == (min(mine, key=lambda o: (o % 2, o)), min(mine), len(mine))
        assert (r.role == "primary") == (r.ord == r.primary_ord) and r.own_key == 7
