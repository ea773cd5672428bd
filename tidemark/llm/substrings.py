"""Exact removal of repeated word windows, found by level-wise doubling.

A window of ``window`` words holds window - base + 1 runs of ``base`` words; the
one with the smallest hash is its anchor, so equal windows have equal anchors at
equal places. Windows that lie side by side and have their anchor in common form
a group, about 2 / (window - base + 2) of all positions. Levels go base, 2 *
base, ... window; at each only what was repeated one level below is looked at:

* A first scan counts the anchors of groups, runs of ``base`` words.
* For each further length below ``window`` a scan looks at the groups whose shorter
  run recurs and gathers, for the run of this length that holds the anchor (to its
  right, or where the windows end too early, to its left), what surrounds it.
* The last scan gives a row per group that is left: its keys, a hash of all its
  words and, where its run was found in several surroundings, the hashes of its
  windows. Equal runs have equal anchors, so one shuffle, by anchor, brings together
  whatever may be equal. Groups are compared as a whole or window by window; all but
  the earliest occurrence are marked. Keys are up to 192 bits of all levels.

What recurs at a level goes to the next scan as a bitmap of bounded size. Its false
hits do no harm: where it fills up, at worst all groups come to the last shuffle with
all their windows, about 14 bytes a word of text, and the result stays the same.

Equal groups within a slice of text are resolved where they are read, so a key has
at most one such row per slice. Anchors that recur in very many slices are dealt
to ``SALTS`` tasks each: every task finds its earliest occurrences, and only those
meet in a second comparison.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap, words
from .shared import Scratch

SLICE = 1 << 21
#: An anchor in this many slices, and in more than the given share of all rows, is dealt to SALTS tasks. The share
#: bounds the number of such anchors, which are broadcast, by its inverse.
HOT, HOT_SHARE, SALTS = 20_000, 2.0**-18, 128
#: Keeps runs to the left of their anchor apart from those to the right.
_LEFT = np.uint64(0x5BD1E9955BD1E995)


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    """For each run of k entries, the place of its smallest (leftmost of equal ones)."""
    at, width = np.arange(len(h)), 1
    while width < k and len(h):
        step = min(width, k - width)
        right = h[step:] < h[: len(h) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        h = np.where(right, h[step:], h[: len(h) - step])
        width += step
    return at


def _levels(window: int) -> list[int]:
    out = [window]
    while out[0] % 2 == 0 and out[0] > 5:
        out.insert(0, out[0] // 2)
    return out


class _Groups:
    """The groups of windows of a slice: per group the first window and the number of them, and the keys of each level."""

    def __init__(self, w: words.Words, window: int, recurring: list):
        lens = _levels(window)
        base, self.h = lens[0], {1: w.hashes()}
        self.h[base] = words.ngrams(self.h[1], base)
        for n in lens[1:]:
            half = self.h[n // 2]
            self.h[n] = words.join(half[: len(half) - n // 2], half[n // 2 :]) if len(half) > n // 2 else half[:0]
        at = np.flatnonzero(w.room() >= window)
        anchor = _smallest(self.h[base], window - base + 1)[at] if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        below = lens[:-1] or lens
        for n in below:
            left = anchor - at > window - n
            new[1:] |= left[1:] != left[:-1]
        first = np.flatnonzero(new)
        self.size = np.diff(np.append(first, len(at)))
        self.at, anchor = at[first], anchor[first]
        self.keys = []
        for n in below:
            left = anchor - self.at > window - n
            self.keys.append(self.h[n][anchor - left * (n - base)] ^ (left * _LEFT))
        stays = np.ones(len(self.at), bool)
        for key, found in zip(self.keys, recurring, strict=False):
            stays &= bitmap.hit(found, key)
        self.at, self.size, self.keys = self.at[stays], self.size[stays], [k[stays] for k in self.keys]
        self.windows = self.h[window]

    def surroundings(self) -> np.ndarray:
        """A hash of all words of each group: its first and last window overlap or meet."""
        h = self.windows
        return words.mix(h[self.at] * words._ODD[21] + h[self.at + self.size - 1] * words._ODD[22] + self.size.astype(np.uint64))


def _counter(window: int, maps: list, last: bool):
    """text -> k, c, lo, hi: the runs of the level after those of maps, how often a slice holds them (twice at most),
    and on the last level the least and largest hash of their surroundings."""

    def count(batches):
        recurring = [m.value for m in maps]
        for batch in batches:
            for w in words.slices(batch.column(0), size=SLICE):
                g = _Groups(w, window, recurring)
                if not len(g.at):
                    continue
                key = g.keys[len(maps)]
                around = g.surroundings().view(np.int64) if last else np.zeros(len(key), np.int64)
                order = np.argsort(key, kind="stable")
                key, around = key[order], around[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                c = np.minimum(np.diff(np.append(at, len(key))), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at].view(np.int64), c, np.minimum.reduceat(around, at), np.maximum.reduceat(around, at))], ["k", "c", "lo", "hi"])

    return count


def _finder(window: int, maps: list, several, hot):
    """id, tag, text -> a row per group whose runs recur; rows with spans tell what is known to be later from the slice alone."""

    def find(batches):
        common, recurring = hot.value, [m.value for m in maps]
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for w in words.slices(batch.column(2), size=SLICE):
                g = _Groups(w, window, recurring)
                if not len(g.at):
                    continue
                around = g.surroundings()
                doc = np.searchsorted(w.bounds, g.at, "right") - 1
                ids, tag, start = known[w.first : w.last][doc], tags[w.first : w.last][doc], g.at - w.bounds[doc]
                order = np.lexsort((start, ids, around, *g.keys))
                same = np.zeros(len(order), bool)
                same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (around, *g.keys)])
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = np.empty(len(order), bool)
                later[order] = (ids[order] != ids[head]) | (start[order] != start[head])
                e = np.flatnonzero(~later)
                salt = np.where(np.isin(g.keys[0][e], common), 1 + words.mix(ids[e].astype(np.uint64)) % np.uint64(SALTS), np.uint64(0)).astype(np.int32)
                apart = bitmap.hit(several.value, g.keys[-1][e])
                size = np.where(apart, g.size[e], 0)
                ends = np.concatenate([[0], np.cumsum(size)])
                inner = np.repeat(g.at[e] - ends[:-1], size) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(g.windows[inner].view(np.int64)))
                yield _rows([k[e] for k in g.keys], salt, around[e], ids[e], tag[e], start[e], g.size[e], lists, None)
                d = np.flatnonzero(later)
                if len(d):
                    d = d[np.lexsort((start[d], doc[d]))]
                    b, z = start[d], start[d] + g.size[d] - 1 + window
                    first = np.flatnonzero(np.append(True, (doc[d][1:] != doc[d][:-1]) | (b[1:] > z[:-1])))
                    last = np.append(first[1:], len(d)) - 1
                    span = np.stack([b[first], z[last]], 1).astype(np.int32)
                    of, begin = np.unique(doc[d][first], return_index=True)
                    spans = pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)).astype(np.int32) * 2), pa.array(span.ravel()))
                    own, tag = known[w.first : w.last][of], tags[w.first : w.last][of]
                    zero = np.zeros(len(of), np.uint64)
                    # these only pass: they are dealt by document
                    yield _rows([words.mix(own.astype(np.uint64)), *[zero] * (len(g.keys) - 1)], zero.astype(np.int32), zero, own, tag, zero, zero, None, spans)

    return find


def _rows(keys, salt, around, ids, tag, at, size, windows, spans):
    n = len(ids)
    cols = [*(k.view(np.int64) for k in keys), salt, around.view(np.int64), ids.astype(np.int64), tag.astype(np.int16), at.astype(np.int32), size.astype(np.int32)]
    cols = [pa.array(c) for c in cols] + [windows if windows is not None else pa.nulls(n, pa.list_(pa.int64())), spans if spans is not None else pa.nulls(n, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, [*(f"k{i}" for i in range(len(keys))), "salt", "around", "id", "tag", "at", "size", "windows", "spans"])


def _later(groups: DataFrame, levels: int, salted: bool) -> DataFrame:
    """id, tag, at, size, spans of all but the earliest occurrences, and the rows that have spans as they are."""
    keys = [f"k{i}" for i in range(levels)]
    each = F.transform("windows", lambda h, i: F.struct(h.alias("h"), (F.col("at") + i).alias("at"), F.lit(1).alias("size")))
    unit = F.when(F.size("windows") > 0, each).otherwise(F.array(F.struct(F.col("around").alias("h"), "at", "size")))
    df = groups.repartition("k0", "salt").select(*keys, "salt", "id", "tag", "spans", F.explode(unit).alias("u")).select(*keys, "salt", "id", "tag", "spans", "u.*")
    df = df.withColumn("r", F.rank().over(Window.partitionBy("k0", "salt", *keys[1:], "h").orderBy("id", "at")))
    out = df.where("r > 1 or spans is not null")
    if salted:  # the earliest of each task meet once more
        met = df.where("r = 1 and salt > 0").withColumn("r", F.rank().over(Window.partitionBy(*keys, "h").orderBy("id", "at")))
        out = out.union(met.where("r > 1"))
    return out.select("id", "tag", "at", "size", "spans")


def _strip(window: int):
    def strip(text: pa.Array, starts: pa.Array, spans: pa.Array) -> pa.Array:
        total, gone, left = [], [], []
        for t, a, b in zip(text, starts, spans, strict=True):
            parts = (t.as_py() or "").encode().split()
            n = len(parts)
            a, b = a.values, b.values
            if a is not None and len(a) or b is not None and len(b):
                step = np.zeros(n + 1, np.int64)
                if a is not None and len(a):
                    a = a.to_numpy(zero_copy_only=False)
                    np.add.at(step, a >> 32, 1)
                    np.add.at(step, (a >> 32) + (a & 0xFFFFFFFF) - 1 + window, -1)
                for x in b if b is not None else ():
                    x = np.asarray(x.as_py(), np.int64)
                    np.add.at(step, x[::2], 1)
                    np.add.at(step, x[1::2], -1)
                stays = np.cumsum(step[:n]) <= 0
                parts = list(compress(parts, stays))
            total.append(n)
            gone.append(n - len(parts))
            left.append(b" ".join(parts).decode())
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["n_words", "n_removed", "kept_text"])

    return strip


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """The input rows as struct ``row``, with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it has the word sequence of a window that starts earlier:
    in a smaller id, or in the same document further left. Windows are judged on the input.

    Null, empty and blank texts have no words; texts shorter than a window lose nothing. Rows with a null id lose
    nothing and count as earlier for none. Rows repeated with one id stand at equal places, so neither is earlier than
    the other. An empty table gives an empty result; other columns stay untouched in ``row``.
    """
    all_rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.hash(F.col(text_col)).bitwiseAND(0x7FFF).cast("smallint").alias("tag"), F.col(text_col).cast("string").alias("text"))
    plain = all_rows.where("id is not null").select("id", "tag", "text")
    spark, held = docs.sparkSession, Scratch(docs.sparkSession, "repeats")
    levels, maps, several, hot = max(1, len(_levels(window)) - 1), [], None, []
    for n in range(levels):
        counted = plain.select("text").mapInArrow(_counter(window, maps, n == levels - 1), "k bigint, c int, lo bigint, hi bigint")
        again = counted.groupBy("k").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("c > 1")
        again = held.keep(again.select("k", "n", (F.col("lo") != F.col("hi")).alias("apart")), f"level-{n}")
        if not n:  # at most 1 / HOT_SHARE keys: each has that share of all rows
            total = again.agg(F.sum("n")).head()[0] or 0
            hot = [r["k"] for r in again.where(F.col("n") > max(HOT, int(total * HOT_SHARE))).select("k").toLocalIterator()]
        maps.append(bitmap.build(again, "k"))
        several = bitmap.build(again.where("apart"), "k")
        held.drop(f"level-{n}")
    common = spark.sparkContext.broadcast(np.array(sorted(hot), np.int64).view(np.uint64))
    schema = ", ".join(f"k{i} bigint" for i in range(levels)) + ", salt int, around bigint, id bigint, tag smallint, at int, size int, windows array<bigint>, spans array<int>"
    later = _later(plain.mapInArrow(_finder(window, maps, several, common), schema), levels, bool(hot))
    start = F.when(F.col("spans").isNull(), F.col("at").cast("bigint") * F.lit(1 << 32) + F.col("size"))
    own = later.groupBy("id", "tag").agg(F.collect_list(start).alias("starts"), F.collect_list("spans").alias("spans"))
    own = own.select(F.col("id").alias("own_id"), F.col("tag").alias("own_tag"), "starts", "spans")
    both = all_rows.join(own, (F.col("id") == F.col("own_id")) & (F.col("tag") == F.col("own_tag")), "left")
    # called nondeterministic only so that Spark does not run it again for a filter on its result
    strip = F.arrow_udf(_strip(window), "n_words bigint, n_removed bigint, kept_text string").asNondeterministic()
    return both.select("row", strip("text", "starts", "spans").alias("x")).select("row", "x.*")
