"""URL filtering by rules and, where no rule fits, by two character language models.

Rules name a host and the beginning of a path. The addresses they decide are the training data: a variable-order Markov
model of the accepted ones and one of the rejected. A character's probability mixes, by Witten-Bell smoothing, what
followed its contexts of up to ``ORDER`` - 1 characters; a context that was never met passes on to the shorter one, and
the shortest rests on an even chance of 256 characters. A verdict is the difference of the two log-likelihoods per
character against a threshold that is calibrated on a part of the decided addresses which the models do not learn from.

Everything is a DataFrame plan. Addresses are taken once each, with the number of their rows. One pass counts runs of
``ORDER`` characters in both classes; the shorter runs are their ends, so everything else works on the table of distinct
runs, which grows with the input and is never cut or collected. Each run gets its log ratio as an integer (millionths),
so sums do not depend on their order. Scores are a join of the addresses' runs with that table, which is written first,
so that Spark knows its size and broadcasts it only if it is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Characters of a run: the last one and its longest context.
ORDER = 6
#: One in so many decided addresses calibrates the threshold.
FOLDS = 5
#: What stands before and behind an address.
START, END = "\u0002", "\u0003"
#: Ratios are integers of this many parts of a nat; scores are calibrated in bins of this many such parts.
PARTS, BIN = 1_000_000, 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict for a host with its subdomains, and the paths that begin like ``path``."""

    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty for a null address and one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct<rule, verdict>, of equal ones the first; null if none does. Rules travel in the plan."""
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    found = [F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: -len(r.host + r.path))]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _spelled(url: Column) -> Column:
    """What the models read: the address without its scheme, A-Z in lower case, between its marks."""
    at = F.instr(url, "://")
    return F.concat(F.lit(START), F.translate(F.when(at > 0, F.substr(url, at + 3)).otherwise(url), _UPPER, _LOWER), F.lit(END))


def _runs(text: Column, order: int) -> Column:
    """For each character but the first: it and up to order - 1 characters before it."""
    chars = F.split(text, "")
    return F.transform(F.sequence(F.lit(2), F.length(text)), lambda i: F.array_join(F.slice(chars, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))), ""))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """run, ratio: millionths of the log of a run's probability among accepted over that among rejected ones.

    ``counts`` has run, a and b: how often each run of up to ``order`` characters was met in the two classes.
    """
    ends = counts.select("run", "a", "b", F.explode(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(order)))).alias("k"))
    ends = ends.select("run", "a", "b", F.expr("right(run, k)").alias("end"))
    met = ends.groupBy("end").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("context", F.expr("left(end, length(end) - 1)"))
    of = [f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]
    known = met.join(met.groupBy("context").agg(*of), "context").select("end", F.struct(F.length("end").alias("k"), "a", "b", "n_a", "t_a", "n_b", "t_b").alias("x"))
    steps = ends.select("run", "end").join(known, "end").groupBy("run").agg(F.array_sort(F.collect_list("x")).alias("steps"))  # ``order`` of them at most

    def mixed(shorter: Column, x: Column, c: str) -> Column:
        smoothed = (x[c] + x[f"t_{c}"] * shorter) / (x[f"n_{c}"] + x[f"t_{c}"])
        return F.when(x[f"n_{c}"] > 0, smoothed).otherwise(shorter)

    even = F.lit(1 / 256)
    log = F.aggregate("steps", F.struct(even.alias("a"), even.alias("b")), lambda p, x: F.struct(mixed(p["a"], x, "a").alias("a"), mixed(p["b"], x, "b").alias("b")), lambda p: F.ln(p["a"]) - F.ln(p["b"]))
    return steps.select("run", F.floor(log * PARTS + 0.5).cast("bigint").alias("ratio"))


def threshold(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Where the shares of accepted addresses below and rejected ones above come to least, among the places between bins
    that hold some and the one below all; of equal ones the one nearest to 0, then the lower. 0 if a class is empty."""
    if not good.sum() or not bad.sum():
        return 0.0
    order = np.argsort(bins)
    bins, good, bad = bins[order].astype(float), good[order].astype(float), bad[order].astype(float)
    places = np.append(bins[0], (bins[1:] + bins[:-1] + 1) / 2) * BIN
    lost = (np.cumsum(good) - good) * bad.sum() + (bad.sum() - np.cumsum(bad) + bad) * good.sum()
    best = np.flatnonzero(lost == lost.min())
    return float(min(places[best], key=lambda t: (abs(t), t)))


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", order: int = ORDER) -> DataFrame:
    """The input rows as struct ``row``, with host, path, rule, verdict (allow or block) and score.

    A rule's verdict stands. For other rows score is the difference of log-likelihoods per character, in nats, above the
    calibrated threshold, and the verdict is allow from 0 on; it is null where a rule decided.

    Null, empty and very long addresses are judged like others, as what they spell (null as empty); those without '://'
    have empty host and path and are read whole. Copies of an address count as often as they occur and get equal values.
    Where no rule decides any row, or all go one way, the threshold is 0 (and all is allowed if there is no evidence).
    An empty table gives an empty result; other columns stay in ``row``, whatever their names.
    """
    held = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    parted = lambda df: df.withColumns({"host": host, "path": path}).withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    each = parted(pages.select(F.col(url_col).cast("string").alias("url")).groupBy("url").agg(F.count("*").alias("n")))
    fold = F.conv(F.substr(F.md5(F.coalesce("url", F.lit("")).cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("bigint") % FOLDS == 0
    each = each.select("url", "n", F.col("r.verdict").alias("label"), fold.alias("fold"), _spelled(F.coalesce("url", F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("id"))
    each = held.keep(each, "addresses")  # written, so that the ids stay what they are

    learn = ~F.col("fold")
    taught = lambda v: F.when((F.col("label") == v) & learn, F.col("n")).otherwise(0)
    runs = each.select(F.explode(_runs(F.col("text"), order)).alias("run"), taught("allow").alias("a"), taught("block").alias("b"))
    counts = held.keep(runs.groupBy("run").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "runs")
    ratios = held.keep(log_ratios(counts, order), "ratios")

    asked = each.where("label is null or fold").select("id", F.explode(_runs(F.col("text"), order)).alias("run"))
    sums = asked.join(ratios, "run").groupBy("id").agg((F.sum("ratio") / F.count("*")).alias("mean"))
    scores = held.keep(each.select("id", "url", "n", "label").join(sums, "id").select("url", "n", "label", "mean"), "scores")
    # scores lie within some 40 nats of 0, so there are at most some 80,000 bins
    binned = scores.where("label is not null").groupBy(F.floor(F.col("mean") / BIN).alias("bin")).agg(*(F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block"))).toArrow()
    cut = threshold(*(binned[c].to_numpy() for c in ("bin", "allow", "block")))
    held.drop("addresses", "runs", "ratios")

    rows = parted(pages.select(F.struct("*").alias("row"), F.col(url_col).cast("string").alias("url")))
    ruled = rows.where("r is not null").select("row", "host", "path", "r.rule", "r.verdict", F.lit(None).cast("double").alias("score"))
    score = ((F.col("mean") - cut) / PARTS).alias("score")
    own = scores.where("label is null").select(F.col("url").alias("own"), score)
    rest = rows.where("r is null").join(own, F.col("url").eqNullSafe(F.col("own")))
    return ruled.union(rest.select("row", "host", "path", "r.rule", F.when(F.col("score") >= 0, "allow").otherwise("block").alias("verdict"), "score"))
