import json
import random
import xml.etree.ElementTree as ET


from tidemark import tables
from tidemark.operators import tag_output
from pyspark.sql import functions as F


def shown(spark, maps, column):
    rows = spark.createDataFrame(list(enumerate(maps)), "k int, meta map<string,string>")
    return [r.x for r in rows.select("k", column(F.col("meta")).alias("x")).orderBy("k").collect()]


def cut(path):
    """A path's parts, places as ints."""
    out = []
    for piece in path.split("."):
        places = []
        while piece.endswith("]") and (at := piece.rfind("[")) >= 0:
            digits = piece[at + 1 : -1]
            if not (digits.isascii() and digits.isdigit() and len(digits) <= 9 and str(int(digits)) == digits):
                break
            places.insert(0, int(digits))
            piece = piece[:at]
        out += [piece, *places]
    return out


def tree(meta):
    """The nested value by recursion over groups of parts."""

    def build(rows):
        groups = {}
        for parts, value in rows:
            groups.setdefault((isinstance(parts[0], str), parts[0]), []).append((parts[1:], value))
        members = []
        for (_, part), below in sorted(groups.items()):
            here = [v for p, v in below if not p]
            deeper = [(p, v) for p, v in below if p]
            if deeper:
                members.append((part, build(deeper + [(["."], v) for v in here])))
            else:
                members.append((part, here[0]))
        if all(isinstance(p, int) for p, _ in members):
            return [v for _, v in members]
        return {str(p): v for p, v in members}

    return build([(cut(k), v) for k, v in meta.items()]) if meta else {}


MAPS = [
    {},
    {"A": "x"},
    {"A.B": "1", "A.C": "two", "D": "true"},
    {"L[0]": "a", "L[2]": "b", "L[10]": "c"},
    {"L[0].x": "a", "L[0].y": "b", "L[1].x": "c", "L[1].z[0][1]": "d"},
    {"A": "own", "A.B": "below", "A.B.C": "further"},
    {"A[0]": "p", "A.n": "q"},
    {"A": "own", "A[0]": "p"},
    {"A[01]": "name", "A[1]": "place", "A.[1]": "below nothing", "": "empty", ".": "two"},
    {'q"uote\\': 'v"al\\ue\n', "é.ü[0]": "日本"},
    {"ab": "1", "a.b": "2", "a b": "3", "a-b": "4"},
]


def strings(value):
    if isinstance(value, dict):
        return {k: strings(v) for k, v in value.items()}
    if isinstance(value, list):
        return [strings(v) for v in value]
    return value if value is None or isinstance(value, str) else json.dumps(value)


def test_trees_equal_a_recursion(spark):
    rng = random.Random(5)
    names = ["a", "b", "ab", "a[0]", "a[1]", "b[0]", "b[10]", "c[0][1]", "[0]", "x[01]", ""]
    made = [{".".join(rng.choice(names) for _ in range(rng.randint(1, 4))): f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 12))} for _ in range(300)]
    maps = MAPS + made
    got = shown(spark, maps, tag_output.nested)
    for meta, text in zip(maps, got, strict=True):
        assert strings(json.loads(text)) == tree(meta), (meta, text)


def test_null_maps_and_null_values(spark):
    assert shown(spark, [None, {"A.B": None, "A.C": "x"}], tag_output.nested) == [None, '{"A":{"B":null,"C":"x"}}']
    assert shown(spark, [None, {"A": None}], tag_output.html_table) == [None, "<table><tr><td>A</td><td></td></tr></table>"]
    assert shown(spark, [None, {}, {"B": "x\ty", "A": None}], tag_output.tab_table) == [None, "", "A\t\nB\tx y"]


def test_other_separators(spark):
    assert shown(spark, [{"A/B": "x", "A.C/D": "y", "A": "z"}], lambda m: tag_output.nested(m, separator="/")) == ['{"A":{"/":"z","B":"x"},"A.C":{"D":"y"}}']


def test_php(spark):
    got = shown(spark, [{"A.B": "1", "A.L[0]": "x$y", "T": "true", "U": '"\\\t\x01'}, {}], lambda m: tag_output.nested(m, tag_output.PHP))
    assert got == [r'Array("A" => Array("B" => 1,"L" => Array("x\$y")),"T" => "true","U" => "\"\\\t\x01")', "Array()"]


def test_xml_is_well_formed_and_whole(spark):
    maps = [{"A.B": "<&'\">", "A.L[0]": "x", "A.L[1].m": "y"}, {"1 a": "v"}, {}]
    got = shown(spark, maps, lambda m: tag_output.description(m, F.lit("it's")))
    parsed = [ET.fromstring(x.replace("<rdf:Description", "<rdf:Description xmlns:rdf='r'", 1)) for x in got]
    assert all(x.attrib["{r}about"] == "it's" for x in parsed)
    a = parsed[0].find("A")
    assert a.find("B").text == "<&'\">" and a.attrib["{r}parseType"] == "Resource"
    bag = a.find("L").find("{r}Bag")
    assert [x.text for x in bag.findall("{r}li")][:1] == ["x"] and bag.findall("{r}li")[1].find("m").text == "y"
    assert parsed[1][0].tag == "_1_a" and parsed[1][0].text == "v" and len(parsed[2]) == 0


def test_html(spark):
    assert shown(spark, [{"b": "<1>", "a": "2"}], tag_output.html_table) == ["<table><tr><td>a</td><td>2</td></tr><tr><td>b</td><td>&lt;1&gt;</td></tr></table>"]


def test_trees_take_no_shuffle_and_no_python(spark, capsys):
    rows = spark.createDataFrame([(1, {"A.B": "x"})], "k int, meta map<string,string>")
    rows.select(tag_output.nested(F.col("meta"))).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_texts_of_one_tree_equal_those_of_the_map_in_many_tasks(spark):
    rows = tables.spread(spark.range(1, 41, numPartitions=1).select("id", F.create_map(F.lit("A.B[0]"), F.col("id").cast("string"), F.lit("A"), F.lit("x")).alias("m")), 10)
    assert rows.rdd.getNumPartitions() == 4
    rows = rows.withColumn("tree", tag_output.entries(F.col("m")))
    for style in (tag_output.JSON, tag_output.PHP, tag_output.XML):
        assert rows.where(tag_output.written(F.col("tree"), style) == tag_output.nested(F.col("m"), style)).count() == 40
    assert rows.select(tag_output.written(tag_output.entries(F.lit(None).cast("map<string,string>")))).head()[0] is None
