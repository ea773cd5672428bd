"""Exact top-k by inner product as a Voronoi kNN join.

Rows are grouped by their nearest pivot; there are about as many pivots as the root of the number of rows. Summaries of
the groups (size, radius, largest norm, widest angle to the pivot) bound the score that any of a group's rows can have
with a query. A first pass solves each query in its nearest groups that hold more than k rows, and its k-th best there is
a score that must be reached; a second pass sends the query to those other groups alone whose bound reaches it. Three
bounds are taken together: by the triangle inequality at the pivot, by the hyperplane between the group's pivot and the
query's nearest one, and by angles, which is the sharp one where vectors have about equal norms.

Groups and queries are dealt in blocks of bounded size, so a group that holds a third of all rows is many tasks; each
cell returns its k best per query, and the best of those are the result. On vectors without any structure in many
dimensions no bound prunes much, and the join compares nearly all blocks with all queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Most pivots: they and their groups' summaries are what is broadcast, 2 MB at 64 dimensions.
PIVOTS, BLOCK = 4096, 4096
#: Scores beyond 64 bits are held at these limits.
_LIMIT = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds no null and no non-finite component."""
    return ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _floor(x: Column) -> Column:
    """The floor as a double: beyond 2^52 doubles are whole numbers already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, the shorter ones filled with zeros."""
    width = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(width), int(width.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < width[:, None]] = flat
    return out


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, whatever type holds them: in floating point where no sum can leave its exact
    range, in 64 bits where none can leave those, and in Python's integers beyond, held at the limits of 64 bits."""
    a, b = _padded(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in m.tolist()] for m in (a, b)]
    return np.array([[max(-_LIMIT, min(_LIMIT, sum(x * y for x, y in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64)


@dataclass
class Cells:
    """Pivots and what is known of the rows in each one's group: largest and least norm, widest angle; size is 0 for a group without rows."""

    pivots: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    least: np.ndarray
    angle: np.ndarray


def _angles(products_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles from inner products and the norms of both sides; straight for a vector without a direction, which bounds nothing."""
    scale = a * b
    return np.where((scale > 0) & np.isfinite(scale), np.arccos(np.clip(products_ / np.where(scale > 0, scale, 1), -1, 1)), np.pi)


def assign(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row: its nearest pivot, the distance to it, the row's norm and its angle to the pivot."""
    x, c = (a.astype(float) for a in _padded(x, pivots))
    norms, out = np.sqrt((c * c).sum(1)), []
    step = max(1, (1 << 22) // max(1, len(c)))
    for k in range(0, max(1, len(x)), step):
        part = x[k : k + step]
        g = ((c * c).sum(1)[None, :] - 2 * part @ c.T).argmin(1)
        n = np.sqrt((part * part).sum(1))
        out.append((g.astype(np.int32), np.sqrt(((part - c[g]) ** 2).sum(1)), n, _angles((part * c[g]).sum(1), n, norms[g])))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def first_groups(cells: Cells, q: np.ndarray, k: int) -> np.ndarray:
    """Mask (query, group) of the nearest groups which together hold more than k rows."""
    q, c = (a.astype(float) for a in _padded(q, cells.pivots))
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    before = np.cumsum(cells.size[order], 1) - cells.size[order]
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, before <= k, 1)
    return out & (cells.size > 0)[None, :]


def further_groups(cells: Cells, q: np.ndarray, k: int, reach: np.ndarray) -> np.ndarray:
    """Mask (query, group) of the groups beside the first ones that may hold a row of score ``reach`` or more."""
    first = first_groups(cells, q, k)
    q, c = (a.astype(float) for a in _padded(q, cells.pivots))
    nq, nc, at_pivot = np.sqrt((q * q).sum(1))[:, None], np.sqrt((c * c).sum(1))[None, :], q @ c.T
    away = np.sqrt(np.maximum(nq**2 - 2 * at_pivot + nc**2, 0))
    nearest = away.argmin(1)
    between = np.sqrt(np.maximum(nc.T**2 - 2 * c @ c.T + nc**2, 0))[nearest]
    plane = (away**2 - away.min(1)[:, None] ** 2) / np.where(between > 1e-6 * (nc + 1), 2 * between, np.inf)
    near = np.maximum(0, np.maximum(away - cells.radius, plane))
    apart = np.maximum(0, _angles(at_pivot, nq, nc) - cells.angle)
    most = np.minimum(at_pivot + nq * cells.radius, (nq**2 + cells.norm**2 - near**2) / 2)
    # the row that turns away from the query costs least if it is short
    turned = np.cos(apart)
    most = np.minimum(most, nq * np.where(turned > 0, cells.norm, cells.least) * turned) + 1e-6 * (nq * (cells.norm + nc) + nq**2 + cells.norm**2 + 1)
    most = np.where(np.isnan(most), np.inf, most)
    return (most >= reach[:, None]) & ~first & (cells.size > 0)[None, :]


def _assigner(pivots):
    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, assign(matrix(batch.column(1)), pivots.value))], ["id", "v", "g", "d", "n", "a"])

    return deal


def _router(shared, k: int):
    """id, v, reach -> id, v, groups: the first ones where reach is null, else those beside them that may hold such a score."""

    def route(batches):
        cells = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, reach = matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).astype(float)
                need = np.where(np.isnan(reach)[:, None], first_groups(cells, q, k), further_groups(cells, q, k, np.nan_to_num(reach)))
                ends = np.concatenate([[0], np.cumsum(need.sum(1))]).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(need)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), groups], ["id", "v", "groups"])

    return route


def _best(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, vid = (t["id"].to_numpy() for t in (left, right))
        score = products(matrix(left["v"].combine_chunks()), matrix(right["v"].combine_chunks())) if len(qid) and len(vid) else np.zeros((len(qid), len(vid)), np.int64)
        out = []
        for q in range(len(qid)):
            other = np.flatnonzero(vid != qid[q])
            s = score[q, other]
            if len(s) > k:
                top = s >= np.partition(s, len(s) - k)[len(s) - k]
                other, s = other[top], s[top]
            o = np.lexsort((vid[other], -s))[:k]
            out.append((np.full(len(o), qid[q]), vid[other][o], s[o]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 3)]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], (pa.array(c.astype(np.int64)) for c in cols), strict=True)))

    return best


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest integer inner product for each row where ``queries`` holds.

    Components become floor(scale * x), of any size. Scores are exact; those beyond 64 bits are held at +-(2^63 - 1) and
    count as equal there. All rows but those with the query's own id are candidates; ties go to the smaller id.
    ``pivots`` is the root of the number of rows by default, ``PIVOTS`` at most.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; shorter
    vectors count as filled with zeros. Of rows repeated with one id each is a candidate, and one (the smallest vector)
    is the query. Fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored.
    """
    spark, held = vectors.sparkSession, Scratch(vectors.sparkSession, "top-k")
    whole = F.transform(F.col(vec_col), lambda x: _floor(x.cast("double") * scale))
    rows = vectors.where(finite(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"), queries.alias("is_query"))

    count = pivots or min(PIVOTS, math.isqrt(rows.count()) + 1)
    some = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(count).select("v").distinct().collect()  # a bounded number of rows
    if not some:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    centre = matrix(pa.array(sorted(r["v"] for r in some), pa.list_(pa.float64())))
    data = held.keep(rows.select("id", "v").mapInArrow(_assigner(spark.sparkContext.broadcast(centre)), "id bigint, v array<double>, g int, d double, n double, a double"), "groups")

    cells = Cells(centre, *(np.zeros(len(centre)) for _ in range(5)))
    for r in data.groupBy("g").agg(F.count("*").alias("size"), F.max("d"), F.max("n"), F.min("n"), F.max("a")).collect():  # a row per pivot
        cells.size[r[0]], cells.radius[r[0]], cells.norm[r[0]], cells.least[r[0]], cells.angle[r[0]] = r[1:]
    route = _router(spark.sparkContext.broadcast(cells), k)
    parts = spark.createDataFrame([(g, max(1, math.ceil(n / block))) for g, n in enumerate(cells.size.tolist())], "g int, parts int")

    asked = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    turns = max(1, math.ceil(asked.count() / block))
    right = data.select("id", "v", "g").join(F.broadcast(parts), "g").select("id", "v", "g", F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int").alias("b"))

    def solve(wanted: DataFrame, name: str) -> DataFrame:
        routed = held.keep(wanted.mapInArrow(route, "id bigint, v array<double>, groups array<int>").withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(turns)).cast("int")), name)
        blocks = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b")
        left = routed.select("id", "v", "c", F.explode("groups").alias("g")).join(F.broadcast(parts), "g").select("id", "v", "g", blocks, "c")
        # a row goes to the turns in which some query asks for its group, and to no other
        turns_of = held.keep(routed.select("c", F.explode("groups").alias("g")).groupBy("g").agg(F.collect_set("c").alias("c")), f"{name}-turns")
        asked_for = right.join(turns_of, "g").select("id", "v", "g", "b", F.explode("c").alias("c"))
        return left.groupBy("g", "b", "c").cogroup(asked_for.groupBy("g", "b", "c")).applyInArrow(_best(k), "query_id bigint, vec_id bigint, score bigint")

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = solve(asked.withColumn("reach", F.lit(None).cast("double")), "first").withColumn("rank", F.row_number().over(place))
    near = held.keep(near.where(F.col("rank") <= k), "near")
    # a query that found fewer than k rows, as its own id fills its first groups, goes to all others; so does one at the limit
    reach = F.when(F.col("score") > -_LIMIT, F.col("score").cast("double")).alias("reach")
    last = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), reach)
    found = near.drop("rank").union(solve(asked.join(last, "id", "left").select("id", "v", F.coalesce("reach", F.lit(-1e300)).alias("reach")), "second"))
    ranked = found.withColumn("rank", F.row_number().over(place))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
