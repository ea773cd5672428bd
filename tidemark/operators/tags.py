"""Queries over tag maps (a map of tag names to texts per item): select, filter, sort, spread, compare, format."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.dates import parse_time
from tidemark.operators import collisions
from tidemark.tables import Scratch

#: What counts as a number when values are sorted, and when they are written as JSON; fixed values.
FLOAT = r"^[+-]?(?=\d|\.\d)\d*(\.\d*)?([Ee]([+-]?\d+))?$"
JSON_NUMBER = r"(?i)^-?(\d|[1-9]\d{1,14})(\.\d{1,16})?(e[-+]?\d{1,3})?$"


def project(meta: Column, keep: list[str] | None = None, drop: list[str] | None = None) -> Column:
    """The tags that are named, without those that are excluded; names with or without a group, in any case."""

    def listed(key: Column, tags: list[str]) -> Column:
        bare = F.lower(F.substring_index(key, ":", -1))
        full, short = [t.lower() for t in tags if ":" in t], [t.lower() for t in tags if ":" not in t]
        hit = F.lit("*" in tags)
        return hit | F.lower(key).isin(*(full or [""])) | bare.isin(*(short or [""]))

    if keep:
        meta = F.map_filter(meta, lambda k, _: listed(k, keep))
    if drop:
        meta = F.map_filter(meta, lambda k, _: ~listed(k, drop))
    return meta


def with_group(meta: Column, group: Column) -> Column:
    """Keys as 'Group:Tag'."""
    return F.transform_keys(meta, lambda k, _: F.concat(group, F.lit(":"), k))


def natural_order(value: Column, descending: bool = False) -> list[Column]:
    """Sort columns of one tag: numbers by value before texts, digits in texts padded to 12 places, missing as '~'."""
    text = F.coalesce(value.cast("string"), F.lit("~"))
    number = text.rlike(FLOAT)
    keys = [(~number).cast("int"), F.when(number, text.try_cast("double")), F.when(~number, _pad(text))]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def _pad(text: Column) -> Column:
    """Every digit run of fewer than 12 digits with zeros before it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d{1,11}$"), F.lpad(r, 12, "0")).otherwise(r)), "")


def sort_by(items: DataFrame, meta: str, tags: list[str], name: str) -> DataFrame:
    """items sorted by tags ('-Tag' descending), ties by name."""
    keys: list[Column] = []
    for t in tags:
        keys += natural_order(F.col(meta)[t.removeprefix("-")], t.startswith("-"))
    return items.orderBy(*keys, F.col(name))


def spread(items: DataFrame, meta: str, name: str, tags: list[str]) -> DataFrame:
    """A wide table: SourceFile, then a column per tag, missing values empty. Given tags make it one projection, no pivot."""
    return items.select(F.col(name).cast("string").alias("SourceFile"), *(F.coalesce(F.col(meta)[t], F.lit("")).alias(t) for t in tags))


def all_tags(items: DataFrame, meta: str, most: int = 2000) -> list[str]:
    """The sorted union of tag names, by a partial aggregate of distinct names; an error if there are more than ``most``,
    which bounds what the driver gets and the columns of a table."""
    names_ = items.select(F.explode(F.map_keys(meta)).alias("k")).distinct()
    found = sorted(r[0] for r in names_.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} different tags; name the ones that are wanted")
    return found


def spread_all(items: DataFrame, meta: str, name: str, most: int = 2000) -> DataFrame:
    """``spread`` with a column for every tag that any row has: one pass for the names, one projection."""
    return spread(items, meta, name, all_tags(items, meta, most))


def sections(items: DataFrame, meta: str, order: str, body: str, head: str | None = None, sect: str | None = None, only: list[str] | None = None, ends: str | None = None, tail: str | None = None) -> DataFrame:
    """A report as rows: order, seq and line, to be read in their order.

    Templates are those of ``print_format``. ``head`` is written before the first item and ``tail`` after the last, with their
    values. ``sect`` is written where it differs from that of the item before, after the ``ends`` of that item, which is also
    written at the end. ``body`` is written for items that have all tags of ``only``.

    Items are cut in ranges of their order and written. What an item has to know of the one before it comes from the same
    range or, for the first of a range, from a table of one row per range; no task sees more than its range. Orders are
    unique; an empty table gives no line.
    """
    held = Scratch(items.sparkSession, "sections")
    show = lambda t: print_format(t, F.col("m")) if t is not None else F.lit(None).cast("string")
    met = F.lit(True)
    for t in only or []:
        met = met & F.col("m")[t].isNotNull()
    rows = items.select(F.col(order).alias("o"), F.col(meta).alias("m"))
    rows = rows.select("o", *(show(t).alias(n) for n, t in (("sect", sect), ("ends", ends), ("head", head), ("tail", tail))), F.when(F.coalesce(met, F.lit(False)), show(body)).alias("body"))
    cut = held.keep(rows.repartitionByRange("o").withColumn("part", F.spark_partition_id()), "ranges")
    last = cut.groupBy("part").agg(F.max_by(F.struct("o", "sect", "ends"), "o").alias("end"))
    before = Window.orderBy("part")  # a row per range
    joints = last.select("part", F.lag("end").over(before).alias("other"), F.lead("part").over(before).isNull().alias("closing"))
    own = Window.partitionBy("part").orderBy("o")
    placed = cut.withColumns({"prev": F.lag(F.struct("o", "sect", "ends")).over(own), "next": F.lead("o").over(own)}).join(F.broadcast(joints), "part")
    placed = placed.withColumn("prev", F.coalesce("prev", "other"))
    first, change = F.col("prev").isNull(), ~F.col("prev.sect").eqNullSafe(F.col("sect"))
    final = F.col("closing") & F.col("next").isNull()
    lines = F.array(F.when(first, F.col("head")), F.when(~first & change, F.col("prev.ends")), F.when(first | change, F.col("sect")), F.col("body"), F.when(final, F.col("ends")), F.when(final, F.col("tail")))
    told = placed.select(F.col("o").alias(order), F.posexplode(lines).alias("seq", "line"))
    return told.where("line is not null")


def attach(items: DataFrame, values: DataFrame, name: str, source: str = "SourceFile") -> DataFrame:
    """items with the imported columns of the row of the same name."""
    return items.join(values.withColumnRenamed(source, name), name, "left")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """tag, left_value, right_value where two (tag, value) tables differ; a side without the tag is null."""
    both = left.toDF("tag", "left_value").join(right.toDF("tag", "right_value"), "tag", "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def json_scalar(value: Column) -> Column:
    """A value as JSON text: plain numbers and true/false bare, all else quoted and escaped."""
    quoted = F.to_json(F.array(value))
    return F.when(value.rlike("(?i)^(true|false)$"), F.lower(value)).when(value.rlike(JSON_NUMBER), value).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def to_json_object(meta: Column) -> Column:
    """A tag map as a JSON object with such scalars, keys sorted."""
    pairs = F.array_sort(F.map_entries(meta))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), json_scalar(p["value"]))), ","), F.lit("}"))


def from_json_object(text: Column) -> Column:
    """A JSON object as a map whose values are all texts."""
    return F.from_json(text, "map<string,string>")


def print_format(template: str, meta: Column) -> Column:
    """The template with each $Tag or ${Tag} replaced by the tag's value, '-' where it is missing; $$ is a dollar."""
    parts = []
    for m in re.finditer(r"\$\$|\$\{([\w:-]+)\}|\$([\w:]+)|[^$]+|\$", template):
        tag = m[1] or m[2]
        parts.append(F.coalesce(meta[tag], F.lit("-")) if tag else F.lit("$" if m[0] == "$$" else m[0]))
    return F.concat(*parts) if parts else F.lit("")


def list_join(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)


def list_item(values: Column, index: int) -> Column:
    """One element of a list, from 0; negative from the end; null outside."""
    return F.try_element_at(values, F.lit(index + 1 if index >= 0 else index))


def exit_status(counts: DataFrame, *keys: str) -> DataFrame:
    """1 on any error, 2 if rows were asked for and all failed the condition, else 0; counts: keys, errors, passed, failed."""
    return counts.select(*keys, F.when(F.col("errors") > 0, 1).when((F.col("failed") > 0) & (F.col("passed") == 0), 2).otherwise(0).alias("status"))


def format_dates(meta: Column, pattern: str) -> Column:
    """Values that are dates ('YYYY:MM:DD HH:MM:SS') in another pattern; others stay."""
    return F.transform_values(meta, lambda _, v: F.coalesce(F.date_format(parse_time(v), pattern), v))


def sorted_lines(meta: Column, separator: str = "\t") -> Column:
    """A line of values in the alphabetical order of their tags, whatever its case."""
    pairs = F.array_sort(F.transform(F.map_entries(meta), lambda p: F.struct(F.lower(p["key"]).alias("k"), p["value"].alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator, "")


#: ``%[-][start][.width][lun]C``: the place of an item among all in their order, or with a dash among those of its folder,
#: counted from ``start`` (0 if there is none, with n one more), by numbers filled with zeros or letters filled with a.
SEQUENCE = re.compile(r"%([-+]?)(\d*)(\.?)(\d*)([lun]?)C")
_CODES = re.compile(rf"(?P<place>{SEQUENCE.pattern})|%[dfe%]|[^%]+|%")


def _place_text(code: re.Match, before: Column) -> Column:
    _, start, _, width, kind = SEQUENCE.match(code["place"]).groups()
    place = before + int(start or 0)
    if kind in ("l", "u"):
        body, fill = collisions.Numbering("", always=True, letters="upper" if kind == "u" else "lower").column(place), "A" if kind == "u" else "a"
    else:
        body, fill = (place + int(kind == "n")).cast("string"), "0"
    return F.lpad(body, F.greatest(F.length(body), F.lit(int(width or 0))), F.lit(fill))


def output_name(template: str, path: Column, places: dict[str, Column] | None = None) -> Column:
    """The template with %d, %f and %e replaced by folder (with its slash), stem and extension of the path; %% is a per cent.

    Places in an order (``SEQUENCE``) need a look at all items: ``sequence_names`` and ``unused_names`` give them.
    """
    name = names.file_name(path)
    folder = F.regexp_extract(names.slashed(path), r"^(.*/)?[^/]*$", 1)
    parts = {"%d": folder, "%f": names.stem(name), "%e": F.ltrim(names.suffix(name), F.lit(".")), "%%": F.lit("%")}
    out = [F.lit("")]
    for code in _CODES.finditer(template):
        if code["place"] and places is None:
            raise ValueError("places in an order are given by sequence_names or unused_names")
        out.append(_place_text(code, places["-" if code["place"][1] == "-" else ""]) if code["place"] else parts.get(code[0], F.lit(code[0])))
    return F.concat(*out)


def _named(items: DataFrame, template: str, path: str, ord_col: str) -> DataFrame:
    """ord and the template's name of each path. Places are running counts over ranges of the order, so neither all items nor
    those of one folder meet in a task."""
    if re.search(r"%[-+]?\d*:\d*[lun]?C", template):
        raise ValueError("a place in an order does not move on where a name is taken; add a copy number")
    kinds = {"-" if m[1] == "-" else "" for m in SEQUENCE.finditer(template)}
    rows, held = items.select(F.col(ord_col).alias("ord"), F.col(path).alias("path")), Scratch(items.sparkSession, "sequence")
    if "" in kinds:
        rows = collisions.running(rows, [], ["ord"], F.lit(1), held, "all").withColumnRenamed("before", "of_all")
    if "-" in kinds:
        rows = rows.withColumn("folder", F.coalesce(names.parent(F.col("path")), F.lit("")))
        rows = collisions.running(rows, ["folder"], ["ord"], F.lit(1), held, "folders").withColumnRenamed("before", "of_folder")
    return rows.select("ord", output_name(template, F.col("path"), {"": F.col("of_all"), "-": F.col("of_folder")}).alias("whole"))


def sequence_names(items: DataFrame, template: str, path: str = "path", ord_col: str = "ord") -> DataFrame:
    """items with ``name``: the template's name for each path, with its place in the order (see ``SEQUENCE``).

    Orders are unique. Items without a path take a place and get no name.
    """
    given = _named(items, template, path, ord_col).select(F.col("ord").alias(ord_col), F.col("whole").alias("name"))
    return items.drop("name").join(given, ord_col)


def unused_names(items: DataFrame, template: str, path: str = "path", ord_col: str = "ord", existing: DataFrame | None = None) -> DataFrame:
    """items with ``name``: the template's name for each path, with the first copy number that is neither taken by a file of
    ``existing`` (folder, name) nor by an item before it in order. The template has one ``%c`` (see ``collisions.COPY``), and
    before it any number of places in the order."""
    plain, how, split = collisions.numbering(template)
    rows = _named(items, plain, path, ord_col).select("ord", names.parent(F.col("whole")).alias("folder"), names.file_name(F.col("whole")).alias("name"))
    given = collisions.unique_names(rows, existing=existing, how=how, split=split).select(F.col("ord").alias(ord_col), F.concat("folder", F.lit("/"), "final_name").alias("name"))
    return items.drop("name").join(given, ord_col)
