"""Near-duplicates of 64-bit fingerprints in Hamming space, within a batch and against earlier runs.

Fingerprints that are equal are joined once, as one code; ``hamming`` finds the pairs of codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import distance
from tidemark.operators.hamming import code_pairs
from tidemark.tables import Scratch, fresh


def hamming_pairs(items: DataFrame, threshold: int, code: str = "code", ord_col: str = "ord") -> DataFrame:
    """Pairs of rows (ord_a < ord_b) within the threshold, with their distance."""
    held = Scratch(items.sparkSession, "pairs")
    items = items.where(F.col(code).isNotNull()).select(F.col(ord_col).alias("o"), F.col(code).alias("c"))
    distinct = held.keep(items.select(F.col("c").alias("code")).distinct(), "codes")
    pairs = held.keep(code_pairs(distinct, threshold, held), "pairs")
    held.drop("homes", "routes")
    every = pairs.union(pairs.select("b", "a", "distance")).union(distinct.select("code", "code", F.lit(0)))
    found = every.join(items.toDF("ord_a", "a"), "a").join(items.toDF("ord_b", "b"), "b")
    return found.where("ord_a < ord_b").select("ord_a", "ord_b", "distance")


def within(items: DataFrame, query: Column, threshold: int, code: str = "code", ord_col: str = "ord") -> DataFrame:
    """Rows within the threshold of one code, nearest first, then in order: (ord, distance)."""
    d = distance(F.col(code), query)
    return items.where(d <= threshold).select(F.col(ord_col), d.alias("distance")).orderBy("distance", ord_col)


class _Decision:
    """What a pass in order decides over the distinct codes of items."""

    def __init__(self, items: DataFrame, threshold: int, code: str, ord_col: str, known: DataFrame | None):
        self.held = held = Scratch(items.sparkSession, "leaders")
        self.first = held.keep(items.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(ord_col).alias("o")), "codes")
        self.pairs = held.keep(code_pairs(self.first.select("code"), threshold, held), "pairs")
        held.drop("homes", "routes")
        # every round adds the codes it drops to one table, of which each part is written once
        gone = held.keep(known.select(F.col("code")).distinct() if known is not None else self.first.select("code").limit(0), "gone/round=0")
        at = {e: self.first.toDF(e, f"o{e}") for e in "ab"}
        ranked = self.pairs.join(at["a"], "a").join(at["b"], "b")
        before = F.col("oa") < F.col("ob")  # u comes before v
        links = ranked.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("v"))
        links, left = held.counted(self._without(links, gone), "links-0")
        turn = 0
        while left:
            kept = links.select("u").distinct().join(links.select(F.col("v").alias("u")).distinct(), "u", "left_anti")  # no earlier neighbour is left
            turn += 1
            gone = held.keep(links.join(kept, "u", "left_semi").select(F.col("v").alias("code")).distinct(), f"gone/round={turn}")
            links, left = held.counted(self._without(links, gone).join(kept, "u", "left_anti"), f"links-{turn % 2}")
        self.dropped = items.sparkSession.read.schema("code bigint, round int").parquet(f"{held.root}/gone").select("code")
        self.lead = self.first.join(self.dropped, "code", "left_anti").select("code", F.col("o").alias("leader"))
        held.drop("links-0", "links-1")

    @staticmethod
    def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
        for end in "uv":
            links = links.join(gone.select(F.col("code").alias(end)), end, "left_anti")
        return links


def leaders(items: DataFrame, threshold: int, code: str = "code", ord_col: str = "ord", known: DataFrame | None = None) -> DataFrame:
    """items with is_leader: exactly what a pass in order decides that drops a row near an earlier kept one.

    Equal codes stand or fall with their first row, so rounds run over distinct codes. In each, a code is dropped once an
    earlier neighbour is kept, and kept once no earlier neighbour is undecided or kept. The links between codes that are
    still undecided shrink with every round; only their number comes to the driver. ``known`` are codes that are near a
    row kept before all of items, as an index of earlier runs finds them: they are dropped. Rows without a code are kept
    and lead none.
    """
    decided = _Decision(items, threshold, code, ord_col, known)
    lead = fresh("lead", items)
    marked = items.join(decided.lead.select(F.col("code").alias(code), F.col("leader").alias(lead)), code, "left")
    decided.held.drop("pairs")
    return marked.withColumn("is_leader", F.col(code).isNull() | F.coalesce(F.col(lead) == F.col(ord_col), F.lit(False))).select(*items.columns, "is_leader")


def nearest_leader(items: DataFrame, threshold: int, code: str = "code", ord_col: str = "ord") -> DataFrame:
    """For each row that is not a leader: the nearest earlier leader within the threshold, of equal ones the first.

    Distances are taken between distinct codes, once for both steps; rows meet only the leaders near their code.
    """
    decided = _Decision(items, threshold, code, ord_col, None)
    pairs, lead = decided.pairs, decided.lead
    every = pairs.union(pairs.select("b", "a", "distance")).union(lead.select("code", "code", F.lit(0)))
    near = every.join(lead.withColumnRenamed("code", "a"), "a").select(F.col("b").alias("code"), "distance", "leader")
    rows = items.where(F.col(code).isNotNull()).select(F.col(ord_col).alias("o"), F.col(code).alias("code"))
    best = rows.join(near, "code").where("leader < o").groupBy("o").agg(F.min(F.struct("distance", "leader")).alias("x"))
    return best.select(F.col("o").alias(ord_col), F.col("x.leader").alias("leader"), F.col("x.distance").alias("distance"))
