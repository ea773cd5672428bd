"""Bradley-Terry quality scores from preference pairs.

A labelled good document is preferred to a labelled bad one. All pairs of them are learned by logistic loss on the
difference of their feature vectors, which makes a score per document; the threshold is the score quantile that leaves
the labelled share of bad documents below it, and the published score is the logistic of the distance to it.

The loss of a pair depends on two scores only. So a pass over the labelled documents sums their number and their features
by label and cell of the score, each document shared out between the two cells that it lies between; all pairs are then
pairs of cells, whose number does not grow with the input. Sums are of integers: no order of rows changes a bit of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Scratch, crc_mod

#: Cells of a unit of score, and the score up to which there are cells; weight of the squared weights in the loss.
CELLS, FARTHEST, RIDGE = 32, 256, 1e-3
#: Most passes, and the change of every weight below which they end.
PASSES, STILL = 30, 1e-6
#: Scores that the driver looks through at a time for the threshold.
NEARBY = 4096
#: The threshold lies in a gap between scores of labelled documents that is this wide at least.
GAP = 1e-6
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:?'\"()-", "!", " \t\r\x0b\x0c", "\n")


def _table() -> np.ndarray:
    kind = np.full(256, len(_KINDS), np.uint8)  # the rest: bytes of other characters
    for k, chars in enumerate(_KINDS):
        kind[[ord(c) for c in chars]] = k
    return kind


_KIND = _table()


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per document."""
    if not len(h):
        return np.zeros(n)
    key = np.unique(words.mix(h + doc.astype(np.uint64) * words._ODD[9]), return_index=True)[1]
    return np.bincount(doc[key], minlength=n).astype(float)


def features(w: words.Words) -> np.ndarray:
    """Features of each document of a slice: shares and lengths, each as it is and squared about its usual place by the learner."""
    n = w.last - w.first
    size = np.diff(w.offsets)
    kinds = np.zeros((n, len(_KINDS) + 1))
    kind = _KIND[w.data]
    for k in range(len(_KINDS) + 1):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        kinds[:, k] = total[w.offsets[1:]] - total[w.offsets[:-1]]
    count, doc, h = w.counts.astype(float), w.doc(), w.hashes()
    some = np.maximum(count, 1)
    solid = np.maximum(size - kinds[:, 6] - kinds[:, 7], 1)
    distinct = _distinct(doc, h, n) / some
    room = w.room()
    at = np.flatnonzero(room >= 3)
    tri = words.ngrams(h, 3)[at]
    grams = np.maximum(np.bincount(doc[at], minlength=n), 1)
    repeat = 1 - _distinct(doc[at], tri, n) / grams
    same = np.bincount(doc[:-1][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / some if len(h) > 1 else np.zeros(n)
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(doc, length, n) / some
    long = np.bincount(doc, length > 25, n) / some
    short = np.bincount(doc, length <= 1, n) / some
    shares = [kinds[:, k] / solid for k in (1, 2, 3, 4, 5, 8)]
    x = np.stack([np.log1p(count), mean, distinct, repeat, same, long, short, np.log1p(kinds[:, 7]), kinds[:, 7] / some, *shares, *(np.sqrt(s) for s in shares[:5])], 1)
    x[count == 0] = 0
    x[count == 0, -1] = 2  # far from any text, on the side that learning sees as bad
    return x


#: What a pass sums: rows of numbers by label and cell.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]
Part = Callable[[np.ndarray, np.ndarray], Sums]


def _summed(label: np.ndarray, cell: np.ndarray, rows: np.ndarray) -> Sums:
    """Sums of the rows of each label and cell, in their order."""
    order = np.lexsort((cell, label))
    label, cell, rows = label[order], cell[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(label) != 0) | (np.diff(cell) != 0)]))
    return label[first], cell[first], np.add.reduceat(rows, first, 0)


def _moments(middle: np.ndarray | None) -> Part:
    """Number, and sums of the features or of their squares about the middle, as whole numbers and parts of 2^36."""

    def part(x, y):
        v = x if middle is None else np.minimum((x - middle) ** 2, 2.0**44)
        whole = np.floor(v)
        rows = np.concatenate([np.ones((len(x), 1)), whole, np.rint((v - whole) * 2**36)], 1).astype(np.int64)
        return _summed(y, np.zeros(len(y), np.int64), rows)

    return part


def _products(model: dict) -> Part:
    """Sums of the products of expanded features, in parts of 2^24; a cell is a feature."""

    def part(x, y):
        z, some = np.rint(standard(model, x) * 2**12), np.unique(y)
        rows = np.concatenate([z[y == k].T @ z[y == k] for k in some]).astype(np.int64)
        return np.repeat(some, z.shape[1]), np.tile(np.arange(z.shape[1]), len(some)), rows

    return part


def _by_score(model: dict) -> Part:
    """Number and sums of the expanded features by cell of the score, in parts of 2^30."""

    def part(x, y):
        z = standard(model, x)
        at = np.clip(_score(z, model["w"]), -FARTHEST, FARTHEST) * CELLS
        cell = np.floor(at).astype(np.int64)
        z = np.concatenate([np.ones((len(z), 1)), z], 1)
        shares = [np.rint(z * s[:, None] * 2**30).astype(np.int64) for s in (cell + 1 - at, at - cell)]
        return _summed(np.concatenate([y, y]), np.concatenate([cell, cell + 1]), np.concatenate(shares))

    return part


def _slope(good: Sums, bad: Sums, products: dict, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, its gradient, and its curvature, for which features vary alike in all cells of a label."""
    (cg, ng, zg), (cb, nb, zb) = ((c / CELLS, r[:, 0] / 2**30, r[:, 1:] / 2**30) for _, c, r in (good, bad))
    loss, cross = 0.0, np.zeros((len(w), len(w)))
    pull = {"g": np.zeros(len(cg)), "b": np.zeros(len(cb))}
    bend = {"g": np.zeros(len(cg)), "b": np.zeros(len(cb))}
    for k in range(0, len(cg), 256):
        i = slice(k, k + 256)
        d = cg[i, None] - cb[None, :]
        p = 1 / (1 + np.exp(np.clip(d, -700, 700)))
        h = p * (1 - p)
        loss += ng[i] @ np.logaddexp(0, -d) @ nb
        pull["g"][i], bend["g"][i] = p @ nb, h @ nb
        pull["b"] += ng[i] @ p
        bend["b"] += ng[i] @ h
        cross += zg[i].T @ (h @ zb)
    pairs = ng.sum() * nb.sum()
    curve = -cross - cross.T
    for side, n, z, label in (("g", ng, zg, 1), ("b", nb, zb, 0)):
        some = n > 0
        between = (z[some] / n[some, None]).T
        within = (products[label] - between @ z[some]) / n.sum()
        curve += bend[side] @ n * within + (between * bend[side][some]) @ z[some]
    gradient = (pull["b"] @ zb - pull["g"] @ zg) / pairs + RIDGE * w
    return loss / pairs + RIDGE / 2 * (w @ w), gradient, curve / pairs + RIDGE * np.eye(len(w))


def weigh(total: Callable[[Part], Sums]) -> dict:
    """Scaling and weights by Newton's method, n (documents of each label); ``total`` sums a part over all of them."""
    sums = [total(_moments(None))]
    label, _, rows = sums[0]
    n = dict(zip(label.tolist(), rows[:, 0].tolist(), strict=True))
    whole = lambda rows: np.array([int(a) + int(b) / 2**36 for a, b in zip(*np.split(rows.sum(0)[1:], 2), strict=True)]) / rows[:, 0].sum()
    mean = whole(rows)
    model = {"mean": mean, "sd": np.sqrt(whole(total(_moments(mean))[2])) + 1e-6, "w": np.zeros(2 * len(mean)), "t": 0.0, "n": n}
    if len(n) < 2:
        return model
    label, _, rows = total(_products(model))
    products = {k: rows[label == k] / 2**24 for k in (0, 1)}
    w, least, step = model["w"], np.inf, model["w"]
    for _ in range(PASSES):
        label, cell, rows = total(_by_score(model))
        bad, good = ((label[label == k], cell[label == k], rows[label == k]) for k in (0, 1))
        loss, gradient, curve = _slope(good, bad, products, model["w"])
        if loss <= least + 1e-12:
            w, least, step = model["w"], loss, -np.linalg.solve(curve, gradient)
        else:  # too far
            step = step / 2
        if np.abs(step).max() < STILL:
            break
        model = model | {"w": w + step}
    return model | {"w": w}


def between(ranked: np.ndarray) -> float | None:
    """The middle of the last gap of ascending scores; None if there is none."""
    gaps = np.flatnonzero(np.diff(ranked) >= GAP)
    return float(ranked[gaps[-1]] + ranked[gaps[-1] + 1]) / 2 if len(gaps) else None


def learn(x: np.ndarray, y: np.ndarray, bad_share: float) -> dict:
    """Weights, scaling and threshold from features and labels of documents that are all at hand."""
    y = np.asarray(y, np.int64)
    model = weigh(lambda part: part(x, y))
    if len(model["n"]) < 2:
        return model
    s = _score(standard(model, x), model["w"])
    weight = np.where(y == 1, (1 - bad_share) / model["n"][1], bad_share / model["n"][0])
    order = np.argsort(s)
    ranked, below = s[order], np.cumsum(weight[order])
    upper = min(len(s) - 1, int(np.searchsorted(below, bad_share + 1e-9, "right")))
    # halfway in the nearest gap at or below the quantile, so that no learned text lies on the threshold
    t = between(ranked[: upper + 1])
    return model | {"t": ranked[0] - GAP if t is None else t}


def standard(model: dict, x: np.ndarray) -> np.ndarray:
    """Features about their usual place, and their squares."""
    return _expand((x - model["mean"]) / model["sd"])


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 3], 1)


def _score(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums, column by column: a row's sum does not depend on the rows beside it, as a matrix product's may."""
    s = np.zeros(len(z))
    for k in range(len(w)):
        s += z[:, k] * w[k]
    return s


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    s = _score(standard(model, x), model["w"]) - model["t"]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _featuring(batches):
    for batch in batches:
        for w in words.slices(batch.column(1)):
            x = features(w)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            rows = batch.slice(w.first, w.last - w.first)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).is_valid(), lists], ["id", "some", "x"])


def _scorer(model):
    def score(batches):
        m = model.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(standard(m, _vectors(batch.column(1))), m["w"]))], ["id", "s"])

    return score


def _total(known: DataFrame) -> Callable[[Part], Sums]:
    """Sums of a part over a table of labels and features: tasks sum their rows, Spark sums those of all tasks."""

    def total(part: Part) -> Sums:
        def run(batches):
            got = [part(_vectors(b.column(1)), b.column(0).to_numpy().astype(np.int64)) for b in batches if b.num_rows]
            if got:
                label, cell, rows = _summed(*(np.concatenate(c) for c in zip(*got, strict=True)))
                lists = [pa.array(rows[:, k]) for k in range(rows.shape[1])]
                lists += [pa.nulls(len(rows), pa.int64())] * (width - len(lists))
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(cell), *lists], ["label", "cell", *columns])

        rows = known.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("label", "cell", *columns)))
        every = rows.groupBy("label", "cell").agg(*(F.sum(c).alias(c) for c in columns)).toArrow().sort_by([("label", "ascending"), ("cell", "ascending")])
        label, cell, *sums = (c.to_numpy() for c in every.drop_columns([c for c in columns if every[c].null_count]).columns)
        return label, cell, np.stack(sums, 1) if len(label) else np.zeros((0, width), np.int64)

    width = 1 + 2 * features(next(words.slices(pa.array(["a"])))).shape[1]
    columns = [f"v{k}" for k in range(width)]
    return total


def _threshold(scores: DataFrame, place: int) -> float:
    """As ``learn`` has it: halfway in the last gap of the scores up to the one at this place, counted from 0."""
    low, high = scores.agg(F.min("s"), F.max("s")).head()
    before, count = 0, None  # scores below low, and those of low to high
    while low < high and (count is None or count > NEARBY):
        # cells of equal width, then the least and largest score of the one that holds the place
        cell = F.least(F.floor((F.col("s") - low) / (high - low) * NEARBY), F.lit(NEARBY - 1))
        cells = scores.where(F.col("s").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("z")).orderBy("cell").collect()
        for r in cells:
            if place < before + r.n:
                break
            before += r.n
        low, high, count = r.a, r.z, r.n
    if low < high:
        high = sorted(r.s for r in scores.where(F.col("s").between(low, high)).select("s").collect())[place - before]
    upto, seen = scores.select("s").distinct(), [high]
    while True:
        more = [r.s for r in upto.where(F.col("s") < seen[-1]).orderBy(F.desc("s")).limit(NEARBY).collect()]
        t = between(np.array([*reversed(more), seen[-1]]))
        if t is not None or not more:
            return (more or seen)[-1] - GAP if t is None else t
        seen = more


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 3, held: int = 1) -> DataFrame:
    """Per input row: id_col, held_out, score, predicted (1 if score >= 0.5).

    Learns from all labelled rows whose crc32(id) mod ``mod`` is not ``held`` and whose text is not null, of any number and
    length, and from all pairs of them. A score uses the text alone.

    Null, empty and blank texts get the features of no text. Without labels of both kinds all scores are 0.5. A null id
    is held out. Repeated rows get equal values; an empty table gives an empty result; other columns are ignored.
    """
    out = F.coalesce(crc_mod(id_col, mod) == held, F.lit(True))
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    every = scratch.keep(texts.mapInArrow(_featuring, f"id {kind}, some boolean, x array<double>"), "features")
    taught = labels.where(F.col(label_col).isin(0, 1) & ~out).select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label")).distinct()
    known = scratch.keep(every.where("some").join(taught, "id").select("label", "x"), "known")
    total = _total(known)
    model = weigh(total) if known.limit(1).count() else {"mean": 0.0, "sd": 1.0, "w": np.zeros(0), "t": 0.0, "n": {}}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    if len(model["n"]) == 2:
        scores = scratch.keep(known.select("label", "x").mapInArrow(_scorer(shared), "id bigint, s double").select("s"), "scores")
        model["t"] = _threshold(scores, min(sum(model["n"].values()) - 1, model["n"][0]))
    got = every.select("id", "x").mapInArrow(_scorer(shared), f"id {kind}, s double")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("s") - F.lit(model["t"])))))
    return got.select(F.col("id").alias(id_col), score.alias("score")).select(id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
