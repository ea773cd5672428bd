"""Tag maps as texts: nested values rebuilt from flat tag paths (JSON, PHP and XML), and tables (HTML, tabs).

A tag path names the way to a value: parts are divided by a separator, and ``Name[0]`` is a place in the list ``Name``. All
members of a row's tree are found in its own map, so trees are rebuilt by expressions within the row: no shuffle, no Python.

The paths of a row are sorted by their parts. Then everything below a part stands together, and a path needs only the
one before it: what is no longer shared with that is closed, what is new is opened.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.tags import JSON_NUMBER, json_scalar

_INDEX = r"\[(?:0|[1-9]\d{0,8})\]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _choose(test: Column, yes: str, no: str) -> Column:
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def php_scalar(value: Column) -> Column:
    """A value as PHP text: plain numbers bare, all else quoted, with dollars and control characters escaped."""
    text = F.regexp_replace(value, r'(["\\$])', r"\\$1")
    for raw, name in (("\t", "t"), ("\n", "n"), ("\r", "r")):
        text = F.replace(text, F.lit(raw), F.lit("\\" + name))
    control = r"[\x00-\x1f\x7f]"
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    text = F.when(text.rlike(control), F.array_join(each, "")).otherwise(text)
    return F.when(value.rlike(JSON_NUMBER), value).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def escaped(text: Column) -> Column:
    """Text for HTML and XML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


@dataclass(frozen=True)
class Style:
    """How a tree is written. A step is a part on the way: name, in_list (its parent is a list), is_list (it is one itself)."""

    open: Callable[[Column], Column]
    close: Callable[[Column], Column]
    leaf: Callable[[Column, Column], Column]
    between: str
    ends: tuple[str, str]


def _member(step: Column, arrow: str) -> Column:
    return F.when(step["in_list"], F.lit("")).otherwise(F.concat(_quoted(step["name"]), F.lit(arrow)))


def _element(step: Column) -> Column:
    """The name of an element: characters that no name may hold, and ends that none may begin with, become '_'."""
    name = F.regexp_replace(step["name"], r"[^A-Za-z0-9_.:-]", "_")
    return F.when(step["in_list"], F.lit("rdf:li")).otherwise(F.when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("_"), name)))


JSON = Style(
    lambda s: F.concat(_member(s, ":"), _choose(s["is_list"], "[", "{")),
    lambda s: _choose(s["is_list"], "]", "}"),
    lambda s, v: F.concat(_member(s, ":"), F.coalesce(json_scalar(v), F.lit("null"))),
    ",",
    ("{", "}"),
)
PHP = Style(
    lambda s: F.concat(_member(s, " => "), F.lit("Array(")),
    lambda s: F.lit(")"),
    lambda s, v: F.concat(_member(s, " => "), F.coalesce(php_scalar(v), F.lit("null"))),
    ",",
    ("Array(", ")"),
)
XML = Style(
    lambda s: F.concat(F.lit("<"), _element(s), _choose(s["is_list"], "><rdf:Bag>", " rdf:parseType='Resource'>")),
    lambda s: F.concat(_choose(s["is_list"], "</rdf:Bag></", "</"), _element(s), F.lit(">")),
    lambda s, v: F.concat(F.lit("<"), _element(s), F.lit(">"), F.coalesce(escaped(v), F.lit("")), F.lit("</"), _element(s), F.lit(">")),
    "",
    ("", ""),
)


def _parts(path: Column, separator: str) -> Column:
    """The parts of a path, each with its kind before it: 'i' and nine digits for a place in a list, else 'n' and the name."""
    pieces = F.split(path, re.escape(separator))

    def cut(piece: Column) -> Column:
        name = F.regexp_extract(piece, rf"(?s)^(.*?)(?:{_INDEX})*$", 1)
        places = F.regexp_extract_all(F.substr(piece, F.length(name) + 1), F.lit(rf"{_INDEX}"), F.lit(0))
        return F.concat(F.array(F.concat(F.lit("n"), name)), F.transform(places, lambda x: F.concat(F.lit("i"), F.lpad(F.translate(x, "[]", ""), 9, "0"))))

    return F.flatten(F.transform(pieces, cut))


def entries(meta: Column, separator: str = ".") -> Column:
    """The row's values in the order of their paths: steps, f (all beginnings of the path), v.

    Where several texts are made of one map, this is a column of its own, so that it is found once for all of them.
    """

    def apart(rows: Column) -> Column:
        """A value that has members beside it becomes the member of the separator's name, which no part can have."""

        def one(e: Column, i: Column) -> Column:
            follows = F.get(rows, i + 1)["p"]
            above = F.coalesce(F.slice(follows, F.lit(1), F.size(e["p"])) == e["p"], F.lit(False))
            p = F.when(above, F.concat(e["p"], F.array(F.lit("n" + separator)))).otherwise(e["p"])
            return F.struct(p.alias("p"), e["v"].alias("v"))

        return F.transform(rows, one)

    def begun(e: Column) -> Column:
        f = F.transform(e["p"], lambda _, d: F.array_join(F.slice(e["p"], F.lit(1), d + 1), separator))
        return F.struct(e["p"].alias("p"), f.alias("f"), e["v"].alias("v"))

    def with_steps(rows: Column) -> Column:
        owners = lambda e: F.filter(F.transform(e["p"], lambda x, d: F.when((d > 0) & x.startswith("n"), F.get(e["f"], d - 1))), lambda o: o.isNotNull())
        objects = F.array_distinct(F.flatten(F.transform(rows, owners)))

        def steps(named: Column) -> Column:
            def step(e: Column) -> Callable[[Column, Column], Column]:
                def at(x: Column, d: Column) -> Column:
                    name = F.substr(x, F.lit(2))
                    shown = F.when(x.startswith("i"), name.try_cast("int").cast("string")).otherwise(name)
                    inside = (d > 0) & ~F.array_contains(named, F.coalesce(F.get(e["f"], d - 1), F.lit("")))
                    return F.struct(shown.alias("name"), inside.alias("in_list"), (~F.array_contains(named, F.get(e["f"], d))).alias("is_list"))

                return at

            return F.transform(rows, lambda e: F.struct(F.transform(e["p"], step(e)).alias("steps"), e["f"].alias("f"), e["v"].alias("v")))

        return _let(objects, steps)

    rows = F.transform(F.map_entries(meta), lambda e: F.struct(_parts(e["key"], separator).alias("p"), e["value"].alias("v")))
    return _let(F.array_sort(rows), lambda r: _let(F.transform(apart(r), begun), with_steps))


def nested(meta: Column, style: Style = JSON, separator: str = ".") -> Column:
    """The tree of a map of tag paths to values, as text.

    A part whose members are all places is a list, in the order of the places; numbers that are left out leave no gap. If a
    part has places and names, the places are names as well. A value on the way to others is a member that is called
    like the separator. So every value stays. Null values are written as null (in XML: empty), a null map gives null, an empty
    one an empty tree.
    """
    return F.when(meta.isNotNull(), written(entries(meta, separator), style))


def written(tree: Column, style: Style = JSON) -> Column:
    """``nested`` of the map whose ``entries`` these are; null for null."""

    def closed(e: Column, shared: Column) -> Column:
        still = F.slice(e["steps"], shared + 1, F.size(e["steps"]) - 1 - shared)
        return F.array_join(F.transform(F.reverse(still), style.close), "")

    def opened(e: Column, shared: Column) -> Column:
        new = F.slice(e["steps"], shared + 1, F.size(e["steps"]) - 1 - shared)
        return F.concat(F.array_join(F.transform(new, style.open), ""), style.leaf(F.element_at(e["steps"], -1), e["v"]))

    def write(rows: Column) -> Column:
        def line(e: Column, i: Column) -> Column:
            def after(before: Column) -> Column:
                return _let(F.size(F.array_intersect(before["f"], e["f"])), lambda n: F.concat(closed(before, n), F.lit(style.between), opened(e, n)))

            return F.when(i == 0, opened(e, F.lit(0))).otherwise(_let(F.get(rows, i - 1), after))

        text = F.array_join(F.transform(rows, line), "")
        return F.concat(F.lit(style.ends[0]), text, F.when(F.size(rows) > 0, closed(F.get(rows, F.size(rows) - 1), F.lit(0))).otherwise(F.lit("")), F.lit(style.ends[1]))

    return F.when(tree.isNotNull(), _let(tree, write))


def description(meta: Column, about: Column, separator: str = ".") -> Column:
    """An item as an XML description, its tags as nested elements; keys as 'Group:Tag' give prefixed names."""
    return described(nested(meta, XML, separator), about)


def described(elements: Column, about: Column) -> Column:
    """``description`` of an item whose elements are written."""
    return F.concat(F.lit("<rdf:Description rdf:about='"), F.coalesce(escaped(about), F.lit("")), F.lit("'>"), elements, F.lit("</rdf:Description>"))


def html_table(meta: Column) -> Column:
    """A table of tags and values, tags in order; null values are empty cells."""
    cell = lambda x: F.concat(F.lit("<td>"), F.coalesce(escaped(x), F.lit("")), F.lit("</td>"))
    rows = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(F.lit("<tr>"), cell(e["key"]), cell(e["value"]), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


def tab_table(meta: Column) -> Column:
    """Lines of tag, tab and value, tags in order; tabs and line ends within a value become spaces."""
    rows = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit("\t"), F.coalesce(F.translate(e["value"], "\t\r\n", "   "), F.lit(""))))
    return F.array_join(rows, "\n")
