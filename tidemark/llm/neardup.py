"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

A table key is a pair of half keys, one of ``half`` left and one of ``half``
right collections of ``rows`` minhashes. So half * half tables of 2 * rows
hashes each need only 2 * half * rows minhashes, about the square root of what
independent tables would take. Both numbers follow from the least similarity, so
that a pair at just that shares no table with a probability of ``miss`` (2e-4)
at most: half = 10 and rows = 3 at 0.85, where a pair at 0.9 is missed with 4e-6.

Plan, each step over all rows and none with an unbounded group in a task:

1. One scan gives each text its set size, a 128-bit set id and its minhashes.
   Equal sets form a class; one row of a class goes on.
2. A half key that only one class has cannot take part in a shared table, so
   those go before the key pairs are formed.
3. A table bucket of up to ``SMALL`` classes gives all its pairs. A larger one
   gives a star: each class is paired with the bucket's pivot, the class that
   shares most half keys with others. Buckets with one pivot are one star, so
   from here on a class has a row per star instead of one per table.
4. Pairs whose minhashes agree far too seldom go; the rest are verified on full
   sets, which a second scan writes once, for the classes of stars and pairs.
   Links are closed into components by label propagation with pointer jumping.
   All of it stays on the executors.
5. Within stars that then still hold several components, members meet where they
   share one of their rarest shingles, as many of them as a linked pair must have
   in common, and those pairs are verified. A shingle that many begin with is no
   such place: its members form families (stars with a common member are one
   family), and every pair of a family's blocks counts the common shingles of all
   its pairs of different components. That is quadratic in those members alone,
   in blocks of bounded size.

So a pair that shares a table is compared, or its texts are in one component
already: nothing depends on how large a bucket is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import bitmap, words
from .shared import Scratch

#: Largest bucket that gives all its pairs.
SMALL = 8
#: Most sets that begin with a rare shingle and give their pairs at once.
FEW = 8
#: Pairs of one pivot that meet its set in a task.
FAN = 512
#: About the most classes, and shingles of all of them, in a block of a family.
BLOCK, BLOCK_SHINGLES = 1024, 400_000


def collections(percent: int, miss: float = 2e-4) -> tuple[int, int]:
    """(half, rows) for a least similarity: as few half keys as keep the chance to miss a pair there below ``miss``."""
    t = min(max(percent, 1), 99) / 100
    rows = 3 if t >= 0.75 else 2 if t >= 0.5 else 1
    return math.ceil(math.log(miss / 2) / math.log(1 - t**rows)), rows


def _shingles(w: words.Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    h = w.hashes()
    g, out, b = words.ngrams(h, n), [], w.bounds
    for k in range(w.last - w.first):
        a, z = b[k], b[k + 1]
        if z - a >= n:
            out.append(np.unique(g[a : z - n + 1]))
        elif z > a:
            out.append(words.ngrams(h[a:z], int(z - a)))
        else:
            out.append(h[:0])
    return out


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4711)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64), rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signer(n: int, half: int, rows: int):
    """mapInArrow function: id, text -> id, n, s1, s2, mh."""
    xor, odd = _seeds(2 * half * rows)

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in words.slices(batch.column(1), lower=True):
                sets = _shingles(w, n)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                s = np.zeros((2, len(sets)), np.int64)
                mh = np.zeros((len(some), len(xor)), np.int32)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some])
                    cuts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    for k in range(2):
                        s[k, some] = np.add.reduceat(words.mix(flat * odd[k] + xor[k]), cuts).view(np.int64)
                    for k in range(len(xor)):
                        mh[:, k] = (np.minimum.reduceat((flat ^ xor[k]) * odd[k], cuts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                full = size > 0
                at = np.concatenate([[0], np.cumsum(full) * mh.shape[1]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(mh.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, w.last - w.first), pa.array(size), pa.array(s[0], mask=~full), pa.array(s[1], mask=~full), lists],
                    ["id", "n", "s1", "s2", "mh"],
                )

    return sign


def set_maker(n: int, wanted):
    """mapInArrow function: id, text -> id, s: the shingle sets of the documents that the bitmap may hold."""

    def sets(batches):
        for batch in batches:
            keep = bitmap.hit(wanted.value, batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for w in words.slices(batch.column(1), lower=True):
                s = _shingles(w, n)
                at = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)
                flat = np.concatenate(s).view(np.int64) if s else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.last - w.first), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "s"])

    return sets


def components(links: DataFrame, held: Scratch, name: str = "labels") -> DataFrame:
    """id, component: the smallest id that each linked id reaches over links (a, b).

    Every round takes the smallest label among the neighbours, then the label of that label, so that chains shrink
    at least by half. Only the number of changed labels comes to the driver.
    """
    edges = f"{name}-edges"
    both = held.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), edges)
    labels, turn = held.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("id"), "c"), f"{name}-0"), 0
    while True:
        near = both.join(labels.select(F.col("id").alias("a"), "c"), "a").groupBy("b").agg(F.min("c").alias("m")).select(F.col("b").alias("id"), "m")
        step = labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("j"))
        step = step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("j", "c")).alias("c"))
        turn, seen = turn + 1, Observation()
        # two tables by turns: a round reads one and overwrites the other
        labels = held.keep(step.observe(seen, F.count_if(F.col("c") != F.col("old")).alias("changed")), f"{name}-{turn % 2}").select("id", "c")
        if not seen.get["changed"]:
            held.drop(edges, f"{name}-{(turn + 1) % 2}")
            return labels.select("id", F.col("c").alias("component"))


def _small_pairs(hits: DataFrame) -> DataFrame:
    """All pairs (pivot, rep) of the members of small buckets; hits: key, rep, size."""
    small = hits.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("r"))
    each = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + F.lit(2), F.lit(SMALL)), lambda y: F.struct(x.alias("pivot"), y.alias("rep")))))
    return small.select(F.explode(each).alias("x")).select("x.pivot", "x.rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 2e-4) -> DataFrame:
    """Per input row: id_col, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a text with fewer than ``shingle`` words has its whole sequence as one shingle.
    Two texts are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest id
    reachable over links and kept says whether that is the row's own.

    Null, empty and blank texts have no shingle and no link. A row with a null id is linked with nothing: its
    component_id is null and it is kept. Rows repeated with one id get equal values. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    half, rows = collections(percent, miss)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = Scratch(docs.sparkSession, "near-duplicates")
    sig = held.keep(docs.mapInArrow(signer(shingle, half, rows), "id bigint, n bigint, s1 bigint, s2 bigint, mh array<int>"), "minhash")
    classes = held.keep(sig.where("id is not null and n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "mh")).alias("r")).select("s1", "s2", "r.*"), "classes")

    halves = classes.select(F.col("id").alias("rep"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), lambda k: F.xxhash64(F.slice("mh", k * rows + 1, F.lit(rows))))).alias("pos", "val"))
    shared = halves.groupBy("pos", "val").agg(F.count("*").alias("c")).where("c > 1")
    own = halves.join(shared, ["pos", "val"]).groupBy("rep").agg(F.collect_list(F.struct("pos", "val")).alias("h"), F.sum("c").alias("pop"))
    tables = F.flatten(F.transform(F.filter("h", lambda x: x["pos"] < half), lambda x: F.transform(F.filter("h", lambda y: y["pos"] >= half), lambda y: F.xxhash64(x, y))))
    keys = own.select("rep", "pop", F.explode(tables).alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.max_by("rep", F.struct("pop", (-F.col("rep")).alias("o"))).alias("pivot")).where("size > 1")
    hits = held.keep(keys.select("key", "rep").join(buckets, "key"), "hits")
    stars = held.keep(hits.where((F.col("size") > SMALL) & (F.col("rep") != F.col("pivot"))).select("pivot", "rep").distinct(), "stars")

    mh = classes.select("id", "mh", "n")
    cand = stars.union(_small_pairs(hits)).distinct().join(mh.toDF("rep", "mh_r", "n_r"), "rep").join(mh.toDF("pivot", "mh_p", "n_p"), "pivot")
    alike = F.size(F.filter(F.zip_with("mh_r", "mh_p", lambda x, y: x == y), lambda z: z))
    agree = max(0, int(2 * half * rows * (percent / 100 - 0.22)))
    fits = 100 * F.least("n_r", "n_p") >= percent * F.greatest("n_r", "n_p")
    good = held.keep(cand.where(fits & (alike >= agree)).select("pivot", "rep"), "pairs")
    held.drop("hits")

    wanted = bitmap.build(stars.union(good).select(F.explode(F.array("pivot", "rep")).alias("v")).distinct(), "v")
    sets = held.keep(docs.where("id is not null").mapInArrow(set_maker(shingle, wanted), "id bigint, s array<bigint>"), "sets")
    links = held.keep(_verified(good, sets, percent), "links")
    labels = components(links, held)
    more = _rest(stars, labels, sets, percent, held)
    named = classes.select("s1", "s2", F.col("id").alias("rep")).join(labels.toDF("rep", "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("rep"))
    if more is not None:
        for end in "ab":  # links between components
            more = more.join(labels.toDF(end, f"c_{end}"), end, "left").withColumn(end, F.coalesce(f"c_{end}", end)).drop(f"c_{end}")
        named = named.join(components(more, held, "joined").toDF("rep", "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("rep"))
    held.drop("stars", "pairs", "sets", "links", "rest")

    out = sig.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _verified(good: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of good that hold on full sets, as links (a, b). A pivot's set goes to as many tasks as its pairs need."""
    fan = good.groupBy("pivot").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    turn = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("fan")).cast("int")
    left = good.join(fan, "pivot").withColumn("turn", turn).drop("fan").join(sets.toDF("rep", "s_r"), "rep")
    right = fan.join(sets.toDF("pivot", "s_p"), "pivot").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    shared = F.size(F.array_intersect("s_r", "s_p"))
    near = 100 * shared >= percent * (F.size("s_r") + F.size("s_p") - shared)
    # repeated ids give their pairs more than once, and with each of their texts
    return left.join(right, ["pivot", "turn"]).where(near).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b: frequent shingles by matrix products, rare ones pair by pair."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = np.concatenate(a + b)
    _, at = np.unique(flat, return_inverse=True)
    doc = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    left = doc < len(a)
    width = int(at.max(initial=-1)) + 1
    p, q = np.bincount(at[left], minlength=width), np.bincount(at[~left], minlength=width)
    dense = p * q > max(16, out.size // 256)
    rank = np.cumsum(dense) - 1
    for k in range(0, int(dense.sum()), 2048):
        here = dense[at] & (rank[at] >= k) & (rank[at] < k + 2048)
        m = np.zeros((len(a) + len(b), 2048), np.float32)
        m[doc[here], rank[at[here]] - k] = 1
        out += m[: len(a)] @ m[len(a) :].T
    thin = (p * q > 0) & ~dense
    order = np.argsort(at, kind="stable")
    order = order[thin[at[order]]]
    x, y = order[left[order]], order[~left[order]]
    first = np.cumsum(np.where(thin, q, 0)) - np.where(thin, q, 0)
    for k in range(0, len(x), 1 << 13):
        part = x[k : k + (1 << 13)]
        times = q[at[part]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = doc[y[np.repeat(first[at[part]], times) + nth]] - len(a)
        out += np.bincount(np.repeat(doc[part], times) * len(b) + other, minlength=out.size).reshape(out.shape)
    return out


def _block_links(percent: int):
    """applyInArrow function: the two blocks of one pair of blocks -> links (a, b) that join all components they link."""

    def find(root: dict, c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    def compare(key, table):
        one = key[1].as_py() == key[2].as_py()
        rep, comp, side = (table[c].to_numpy() for c in ("rep", "component", "side"))
        n = np.array(pc.list_value_length(table["s"]).to_numpy(), np.int64)
        sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in table["s"]]
        i = np.flatnonzero(side == key[1].as_py())
        j = i if one else np.flatnonzero(side == key[2].as_py())
        links = []
        if len(i) and len(j):
            shared = _common([sets[k] for k in i], [sets[k] for k in j]).astype(np.int64)
            near = (100 * shared >= percent * (n[i][:, None] + n[j][None, :] - shared)) & (comp[i][:, None] != comp[j][None, :])
            x, y = np.nonzero(near)
            ends = np.sort(np.stack([comp[i[x]], comp[j[y]]], 1), 1)
            root: dict[int, int] = {}
            for k in np.unique(ends, axis=0, return_index=True)[1] if len(ends) else ():
                u, v = find(root, int(ends[k, 0])), find(root, int(ends[k, 1]))
                if u != v:
                    root[u] = v
                    links.append(sorted((int(rep[i[x[k]]]), int(rep[j[y[k]]]))))
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    return compare


def _by_prefixes(rows: DataFrame, percent: int, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (pivot, rep) of different components among rows (u, rep, component, s), and the reps (rep) that
    also have to be compared in blocks.

    The shingles of a set are put in order, rare ones first. Of two linked sets, the larger one's first n - ceil(p n) + 1
    and the smaller one's first m - ceil(2 p m / (1 + p)) + 1 have one in common, so they meet where they share one of
    those. A shingle that up to ``FEW`` smaller sets begin with gives its pairs, at most ``FEW`` for each set that
    meets it there; the sets of any other are left to the blocks. The order of shingles changes nothing but the speed.
    """
    tokens = rows.select("u", "rep", "component", F.size("s").alias("n"), F.explode("s").alias("t"))
    counts = held.keep(tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "token-counts")
    share = (counts.agg(F.sum("c")).head()[0] or 0) >> 14
    often = tokens.join(F.broadcast(counts.where(F.col("c") > share)), "t", "left")  # fewer than 2^14 shingles have that share
    seldom = often.where("c is null").drop("c").join(counts.where(F.col("c") <= share), "t", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    placed = often.where("c is not null").unionByName(seldom)
    order = placed.groupBy("u", "rep").agg(*(F.first(c).alias(c) for c in ("component", "n")), F.array_sort(F.collect_set(F.struct("c", "t"))).alias("o"))
    longer, shorter = F.expr(f"n - ({percent} * n + 99) div 100 + 1"), F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    first = F.transform(F.slice("o", F.lit(1), longer.cast("int")), lambda x, i: F.struct(x["c"].alias("c"), x["t"].alias("t"), (i < shorter).alias("own")))
    begin = order.select("rep", "component", "n", F.explode(F.filter(first, lambda x: x["c"] > 1)).alias("x")).select("rep", "component", "n", "x.t", "x.own")
    begin = held.keep(begin, "prefixes")
    groups = begin.groupBy("t").agg(F.count_if("own").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("k > 0 and lo <> hi")
    met = held.keep(begin.join(groups.select("t", (F.col("k") > FEW).alias("many")), "t"), "prefix-hits")
    few = met.where("not many")
    x, y = few.select("t", *(F.col(c).alias(f"{c}_x") for c in ("rep", "component", "n"))), few.where("own").select("t", *(F.col(c).alias(f"{c}_y") for c in ("rep", "component", "n")))
    pairs = x.join(y, "t").where(f"component_x <> component_y and n_y <= n_x and 100 * n_y >= {percent} * n_x")
    pairs = held.keep(pairs.select(F.least("rep_x", "rep_y").alias("pivot"), F.greatest("rep_x", "rep_y").alias("rep")).distinct(), "prefix-pairs")
    return pairs, met.where("many").select("rep").distinct()


def _rest(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, held: Scratch) -> DataFrame | None:
    """Links that join all components that pairs within stars link; None if no star holds several."""
    named = labels.toDF("rep", "component")
    at_pivot = labels.toDF("pivot", "c")
    known = stars.join(named, "rep", "left").join(at_pivot, "pivot", "left").withColumns({"component": F.coalesce("component", "rep"), "c": F.coalesce("c", "pivot")})
    mixed = known.where("component != c").select("pivot").distinct()
    large = held.keep(known.join(mixed, "pivot", "left_semi"), "mixed")
    if not large.limit(1).count():
        held.drop("mixed")
        return None
    members = large.select("rep", "component").union(large.select("pivot", "c")).distinct()
    # repeated ids have a row for each of their texts
    rows = held.keep(members.join(sets.toDF("rep", "s"), "rep").withColumn("u", F.xxhash64("rep", "s")), "member-sets")
    pairs, many = _by_prefixes(rows, percent, held)
    many = held.keep(many, "many")
    out = _verified(pairs, rows.select("rep", "s"), percent)
    if many.limit(1).count():
        out = out.union(_in_blocks(large.join(many, "rep", "left_semi"), rows.join(many, "rep", "left_semi"), percent, held))
    out = held.keep(out.distinct(), "rest")
    held.drop("mixed", "member-sets", "token-counts", "prefixes", "prefix-hits", "prefix-pairs", "many", "families", "family-sets")
    return out


def _in_blocks(large: DataFrame, rows: DataFrame, percent: int, held: Scratch) -> DataFrame:
    """Links between the sets of rows that the stars of large bring together in families.

    A family's largest component needs no comparison with itself: its members lie in blocks of their own (0, 2, ...).
    """
    family = components(large.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), held, "families").toDF("rep", "family")
    rows = held.keep(rows.select("rep", "component", "s").join(family, "rep"), "family-sets")
    main = rows.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rows = rows.join(main, "family").withColumn("rest", (F.col("component") != F.col("main")).cast("int")).drop("main")
    sizes = rows.groupBy("family", "rest").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("s")) / BLOCK_SHINGLES)).cast("int").alias("k"))
    deal = sizes.groupBy("family").agg(*(F.coalesce(F.max(F.when(F.col("rest") == r, F.col("k"))), F.lit(0)).alias(f"k{r}") for r in (0, 1)))
    rows = rows.join(deal, "family")
    side = 2 * F.pmod(F.xxhash64("rep", F.lit(13)), F.when(F.col("rest") == 1, F.col("k1")).otherwise(F.col("k0"))).cast("int") + F.col("rest")
    blocks = lambda r: F.transform(F.slice(F.sequence(F.lit(0), F.col(f"k{r}")), F.lit(1), F.col(f"k{r}")), lambda x: (2 * x + r).cast("int"))
    others = F.when(F.col("rest") == 1, F.concat(blocks(0), blocks(1))).otherwise(blocks(1))
    pairs = rows.withColumn("side", side).withColumn("other", F.explode(others))
    pairs = pairs.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "component", "s")
    return pairs.groupBy("family", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint")
