"""Collision-free names within folders.

Names are given in order: the name itself if free, else the first free one of a sequence of copies, stem_1, stem_2 ... or
as ``Numbering`` says. Whether a name is free depends on those given before it, so rows that can want one name are a
sequence. Which ones can is told first, from the distinct names: a name *generates* copies if several rows want it or if
it is taken; a name that no generating one can reach by adding copy numbers stands by itself. So IMG_0001.jpg and
IMG_0002.jpg do not meet, while a.jpg, wanted twice, and a_1.jpg do: they are a family, named by its shortest generating name.

* A family of one row keeps its name.
* A family that wants one name, whatever is taken of its copies, is numbered in many tasks however large it is: the row at
  place m gets the m-th number that is missing among those taken. Both places and the taken numbers before a place are
  running counts, taken in ranges of the order and added up over the ranges.
* A family that wants several names is one task, which reads its rows as a stream and holds the names it has given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.tables import Scratch

#: Most letters of a copy by letters: enough for 26^7 copies.
LETTERS = 7


@dataclass(frozen=True)
class Numbering:
    """How the copies of a name are told apart. Copy 0 is the name itself, unless it too has a number (``always``).

    Numbers are the copy's plus ``shift``, filled with zeros up to ``width``; letters run a ... z, aa ... from copy 0 on, filled
    with a up to ``width``: aaa, aab ... zzz, aaaa. Where copy 0 has none, copies begin with b, and the text of a's alone, which
    aa filled up gives again, comes 26th.
    """

    separator: str = "_"
    width: int = 0
    shift: int = 0
    always: bool = False
    letters: str = ""  # "", "lower" or "upper"

    @property
    def _first(self) -> int:
        """The place of the first text of letters among a, b ... z, aa ..., from 1 on."""
        return sum(26**i for i in range(max(self.width, 1)))

    def text(self, copy: int) -> str:
        """What stands between stem and suffix."""
        if not copy and not self.always:
            return ""
        if not self.letters:
            return f"{self.separator}{copy + self.shift:0{self.width}d}"
        late = self.width > 1 and not self.always
        n, out = self._first + (copy if not late or copy < 26 else 0 if copy == 26 else copy - 1), ""
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(97 + digit) + out
        return self.separator + (out.upper() if self.letters == "upper" else out)

    def column(self, copy: Column) -> Column:
        """``text`` as an expression."""
        if self.letters:
            digit = lambda n: F.char(F.lit(97) + (n - 1) % 26)
            step = lambda a, _: F.when(a["n"] > 0, F.struct((F.floor((a["n"] - 1) / 26)).cast("bigint").alias("n"), F.concat(digit(a["n"]), a["s"]).alias("s"))).otherwise(a)
            place = F.when(copy < 26, copy).when(copy == 26, 0).otherwise(copy - 1) if self.width > 1 and not self.always else copy
            body = F.aggregate(F.sequence(F.lit(1), F.lit(LETTERS)), F.struct((place + self._first).cast("bigint").alias("n"), F.lit("").alias("s")), step, lambda a: a["s"])
            body = F.upper(body) if self.letters == "upper" else body
        else:
            body = (copy + self.shift).cast("string")
            body = F.lpad(body, F.greatest(F.length(body), F.lit(self.width)), F.lit("0")) if self.width else body
        shown = F.concat(F.lit(self.separator), body)
        return shown if self.always else F.when(copy == 0, "").otherwise(shown)

    def copy_of(self, middle: Column) -> Column:
        """The copy whose text this is; null if it is none's."""
        after = F.substr(middle, F.lit(len(self.separator) + 1))
        if self.letters:
            chars = F.split(F.lower(after), "")
            value = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: a * 26 + F.ascii(c) - 96) - self._first
            if self.width > 1 and not self.always:
                value = F.when(value == 0, 26).when(value < 26, value).otherwise(value + 1)
            fits = after.rlike(f"^[a-zA-Z]{{1,{LETTERS}}}$")
        else:
            value, fits = after.try_cast("bigint") - self.shift, after.rlike(r"^\d{1,18}$")
        copy = F.when(middle == "", F.lit(0).cast("bigint")).when(F.startswith(middle, F.lit(self.separator)) & fits, value)
        return F.when((copy >= 0) & (self.column(copy) == middle), copy)

    def shorter(self, stem: Column) -> Column:
        """All stems that this one is, or may be, a copy of a copy of: what is left when copy texts are taken off its end."""
        body = ("[A-Z]" if self.letters == "upper" else "[a-z]") if self.letters else r"\d"
        tail = F.regexp_extract(stem, f"((?:{re.escape(self.separator)}{body}+)+)$" if self.separator else f"({body}{{1,18}})$", 1)
        start = F.length(stem) - F.length(tail)
        cuts = F.when(tail == "", F.array().cast("array<int>")).otherwise(F.sequence(start, F.length(stem) - 1))
        at = lambda i: F.substr(stem, i + 1, F.lit(max(1, len(self.separator))))
        if self.separator:
            cuts = F.filter(cuts, lambda i: at(i) == self.separator)
        return F.transform(cuts, lambda i: F.substr(stem, F.lit(1), i))


#: ``%[-+][width][.][width][lun]c``: a dash or an underline before the copy, digits to fill up to, a dot if the first name has
#: one too, letters in lower or upper case, or numbers from 1 on (from 2 on if the first name has none).
COPY = re.compile(r"%([-+]?)(\d*)([.:]?)(\d*)([lun]?)c")

#: How a name is taken apart: what comes before a copy number, and what comes after it.
Split = Callable[[Column], tuple[Column, Column]]


def by_suffix(name: Column) -> tuple[Column, Column]:
    return names.stem(name), names.suffix(name)


def numbering(template: str) -> tuple[str, Numbering, Split]:
    """A name's template without its copy number, what that says, and how names are cut where it stands.

    After the copy number come fixed characters and perhaps ``.%e``: then every name can be cut in one way only.
    """
    found = COPY.search(template)
    if found is None or COPY.search(template, found.end()):
        raise ValueError("a template needs one copy number")
    rest = template[found.end() :]
    if not re.match(r"[^%/]*(\.%e)?\Z", rest):
        raise ValueError("after a copy number come fixed characters, then .%e if it is wanted")
    ending = re.escape(rest.removesuffix("%e")) + ("[^./]*" if rest.endswith("%e") else "")

    def cut(name: Column) -> tuple[Column, Column]:
        end = F.regexp_extract(name, f"(?s)({ending})\\z", 1)
        return F.substr(name, F.lit(1), F.length(name) - F.length(end)), end

    sign, width, dot, more, kind = found.groups()
    letters = {"l": "lower", "u": "upper"}.get(kind, "")
    places = max(int(width or 0), int(more or 0))
    if letters and places > LETTERS:
        raise ValueError(f"copies have {LETTERS} letters at most")
    return template[: found.start()] + rest, Numbering({"-": "-", "+": "_"}.get(sign, ""), places, int(kind == "n"), bool(dot), letters), cut


def running(df: DataFrame, keys: list[str], order: list[str], flag: Column, held: Scratch, name: str) -> DataFrame:
    """df with ``before``: how many flagged rows of the same keys come before a row in order, whatever their number.

    Rows are cut in ranges of keys and order and written, so that a task that is repeated finds the same ranges. A count is
    that within the range, and what the ranges before it hold: a row per range and key.
    """
    cut = held.keep(df.withColumn("flagged", flag.cast("bigint")).repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "part").agg(F.sum("flagged").alias("n")).withColumn("others", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = F.sum("flagged").over(Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("own", F.coalesce(own, F.lit(0))).join(sums, [*keys, "part"]).withColumn("before", F.col("own") + F.col("others")).drop("own", "others", "part", "flagged")


def _allocator(how: Numbering):
    def allocate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, last = None, set(), {}
        for frame in frames:
            out = []
            for fam, stem, suffix, given in zip(frame["family"], frame["stem"], frame["suffix"], frame["taken"], strict=True):
                if fam != family:
                    family, taken, last = fam, set(), {}
                if given:
                    taken.add(stem + suffix)
                    out.append(None)
                    continue
                k = last.get((stem, suffix), 0)
                while (free := f"{stem}{how.text(k)}{suffix}") in taken:
                    k += 1
                last[stem, suffix] = k + 1
                taken.add(free)
                out.append(free)
            yield frame.loc[~frame["taken"], ["o"]].assign(final_name=[x for x in out if x is not None])

    return allocate


def families(wanted: DataFrame, there: DataFrame, how: Numbering, held: Scratch | None = None) -> DataFrame:
    """dir, stem, suffix of each distinct name that is wanted or taken, with family (the shortest stem that generates it, or
    its own), n (rows that want it), taken, and of its family: many (names wanted), rows and holes (names taken).

    The distinct names are read several times over: they are put in ``held``, where one is given."""
    keys = ["dir", "stem", "suffix"]
    n = wanted.groupBy(*keys).agg(F.count("*").alias("n")).join(there.withColumn("taken", F.lit(True)), keys, "full")
    n = n.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("taken", F.lit(False)).alias("taken"))
    n = held.keep(n, "distinct") if held else n
    generating = (F.col("n") > 0) if how.always else (F.col("n") > 1) | ((F.col("n") > 0) & F.col("taken"))
    roots = n.where(generating).select("dir", F.col("stem").alias("root"), "suffix")
    reached = n.select(*keys, F.explode(how.shorter(F.col("stem"))).alias("root")).join(roots, ["dir", "root", "suffix"])
    shortest = reached.groupBy(*keys).agg(F.min_by("root", F.length("root")).alias("root"))
    named = n.join(shortest, keys, "left").withColumn("family", F.coalesce("root", "stem")).drop("root")
    sizes = named.groupBy("dir", "family", "suffix").agg(F.count_if(F.col("n") > 0).alias("many"), F.sum("n").alias("rows"), F.count_if("taken").alias("holes"))
    return named.join(sizes.where("rows > 0"), ["dir", "family", "suffix"])


def unique_names(moves: DataFrame, folder: str = "folder", name: str = "name", ord_col: str = "ord", existing: DataFrame | None = None, how: Numbering = Numbering(), split: Split = by_suffix) -> DataFrame:  # noqa: B008
    """moves with final_name; ``existing`` has the (folder, name) pairs that are already there. Copies are told apart where
    ``split`` cuts a name.

    Orders are unique. Rows without a folder or a name get none.
    """
    held = Scratch(moves.sparkSession, "names")
    parts = lambda n: [c.alias(a) for c, a in zip(split(F.col(n)), ("stem", "suffix"), strict=True)]
    rows = moves.select(F.col(ord_col).alias("o"), F.col(folder).alias("dir"), F.col(name).alias("name")).select("o", "dir", *parts("name"))
    # written before they are asked for: a condition on a name works it out anew, as often as the name occurs in it
    asked = held.keep(rows, "asked").where("dir is not null and stem is not null")
    if existing is None:
        there = moves.sparkSession.createDataFrame([], "dir string, stem string, suffix string")
    else:
        there = existing.select(F.col(folder).alias("dir"), F.col(name).alias("name")).select("dir", *parts("name")).distinct()
    keys = ["dir", "stem", "suffix"]
    known = held.keep(families(asked, there, how, held), "families")
    kind = F.when(F.col("many") > 1, "several").when((F.col("rows") > 1) | (F.col("holes") > 0) | F.lit(how.always), "numbered").otherwise("alone")
    of = known.where("n > 0").select(*keys, "family", kind.alias("kind"))
    rows = held.keep(asked.join(of, keys), "dealt")
    every = rows.where("kind = 'alone'").select("o", F.concat("stem", "suffix").alias("final_name"))
    # branches that nothing takes are left out of the plan
    met = known.agg(*(F.count_if(c) for c in (kind == "numbered", (F.col("many") == 1) & F.col("taken"), F.col("many") > 1))).head()
    group, order_type = ["dir", "family", "suffix"], rows.schema["o"].dataType

    if met[0]:
        placed = running(rows.where("kind = 'numbered'").select(*group, "o"), group, ["o"], F.lit(1), held, "places").withColumnRenamed("before", "v")
        copy = F.col("v")
        if met[1]:
            holes = known.where("taken and many = 1").select(*group, how.copy_of(F.expr("substr(stem, length(family) + 1)")).alias("v")).where("v is not null")
            # as many numbers are missing below the i-th taken one as it says, less i; a place comes after those with no more
            holes = running(holes, group, ["v"], F.lit(1), held, "holes").select(*group, (F.col("v") - F.col("before")).alias("v"), F.lit(0).alias("is_row"), F.lit(None).cast(order_type).alias("o"))
            both = placed.select(*group, "v", F.lit(1).alias("is_row"), "o").union(holes)
            placed = running(both, group, ["v", "is_row", "o"], F.col("is_row") == 0, held, "met").where("is_row = 1")
            copy = F.col("v") + F.col("before")
        every = every.union(placed.select("o", F.concat("family", how.column(copy), "suffix").alias("final_name")))

    if met[2]:
        takes = known.where("taken and many > 1").select(F.lit(None).cast(order_type).alias("o"), *keys, "family", F.lit(True).alias("taken"))
        stream = rows.where("kind = 'several'").select("o", *keys, "family", F.lit(False).alias("taken")).union(takes)
        stream = stream.withColumn("family", F.concat_ws("\u0000", *group)).repartition("family").sortWithinPartitions("family", F.desc("taken"), "o")
        given = stream.mapInPandas(_allocator(how), f"o {order_type.simpleString()}, final_name string")
        every = every.union(given)
    return moves.join(every.withColumnRenamed("o", ord_col), ord_col, "left")
