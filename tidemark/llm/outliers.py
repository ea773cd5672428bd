"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions alone.

Each text gives counts (words, symbols, repeated lines, repeated 5-word windows). Four transformed statistics of them
form a vector. Per language and source, the estimate is the mean and covariance of the share ``core`` of the rows whose
covariance has the least determinant. It is sought as usual, by concentration steps (the rows nearest to an estimate give
the next one) from several starts: medians and quartiles, the same with correlations of squashed values, and random
subsets of about ``SUBSET`` rows. After two steps the two starts of least determinant go on until nothing changes. A text
is rejected if its squared Mahalanobis distance passes ``cutoff``. Variances are at their floors at least, in every step,
so the determinant is that of the floored matrix.

Statistics are held as whole thousandths, so sums are exact integers and results do not depend on how rows are dealt.
A step is one aggregate: sums per group, start and distance, distances on a scale of a few thousand whole numbers, so a
hot group is pre-aggregated where its rows are. Estimates (a row per group and start) are joined under a salt, for the
case that they are too many for a broadcast that Spark sizes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

SPACES = " \t\n\x0b\f\r"
DIMS = 4
#: Least standard deviation of each statistic, in thousandths: word count, word length, symbols, repeated lines.
FLOORS = (700, 120, 300, 300)
#: The 0.999 quantile of the chi-square distribution with 4 degrees of freedom.
CUTOFF = 18.467
#: Median of the chi-square distribution with 4 degrees of freedom.
CHI_MEDIAN = 3.3567
SALTS = 16
#: Random starts, and about how many rows each is made from.
RANDOM, SUBSET = 3, 20
#: Most concentration steps; they mostly end after five to eight.
STEPS = 15


def text_counts(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    solid = F.btrim(text, F.lit(SPACES))
    df = docs.withColumns({
        "_w": F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, "[\\x20\\x09-\\x0D]+")),
        "_l": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
    })
    gram = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(window)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_lines": F.size("_l").cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "_g": F.when(F.size("_w") >= window, F.transform(F.sequence(F.lit(0), F.size("_w") - window), gram)).otherwise(F.array().cast("array<bigint>")),
    }).drop("_w", "_l")
    # only texts with a repeated window go on to sorting
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_g")
    equal = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_s", lambda x, k: F.when(k > 0, equal(x, k - 1)).otherwise(F.lit(False)) | equal(x, k + 1))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_s")
    step = F.transform("_p", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_p", k + 1) - p, F.lit(window))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")).drop("_p")


def _statistics() -> list[Column]:
    n, chars, lines = (F.greatest(F.lit(1), F.col(c)) for c in ("n_words", "word_chars", "n_lines"))
    values = (F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.log(0.02 + F.col("n_symbols") / chars), F.log(0.1 + F.col("n_dup_lines") / lines))
    return [F.greatest(F.lit(-20000), F.least(F.lit(20000), F.round(1000 * v))).cast("bigint").alias(f"z{k}") for k, v in enumerate(values)]


_SUMS = ["n", *(f"s{i}" for i in range(DIMS)), *(f"p{i}{j}" for i in range(DIMS) for j in range(i + 1))]


def _sums(rows: DataFrame, keys: list[str], name: str = "z") -> DataFrame:
    """Number of rows, sums and sums of products of whole-number columns."""
    sums = [F.sum(f"{name}{i}").alias(f"s{i}") for i in range(DIMS)]
    prods = [F.sum(F.col(f"{name}{i}") * F.col(f"{name}{j}")).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *prods)


def _raw(i: int, j: int) -> Column:
    """Covariance from sums."""
    return F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))


def _spread(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m0.. and covariance c00.. of each group, variances at their floors at least."""
    mean = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)]
    cov = [(F.greatest(_raw(i, j), F.lit(float(FLOORS[i] ** 2))) if i == j else _raw(i, j)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return sums.select(*keys, *mean, *cov)


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    """The lower factor l00.. of the covariance c00.., and the logarithm of its determinant."""
    for j in range(DIMS):
        head = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(head, F.lit(1.0))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)})
    det = sum((2 * F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0))
    return df.select(*keys, *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)), det.alias("logdet"))


def _starts(sound: DataFrame, keys: list[str], held: Scratch) -> DataFrame:
    """Estimates to start from: a row per group and start."""
    mid = held.keep(sound.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.percentile(f"z{i}", F.lit(0.5)).alias(f"m{i}") for i in range(DIMS)), *(F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i in range(DIMS))), "quartiles")
    var = [F.greatest((F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) ** 2 / 1.349**2, F.lit(float(FLOORS[i] ** 2))) for i in range(DIMS)]
    mid = mid.select(*keys, "rows", *(f"m{i}" for i in range(DIMS)), *(v.alias(f"v{i}") for i, v in enumerate(var)))
    plain = mid.select(*keys, F.lit(0).alias("start"), *(f"m{i}" for i in range(DIMS)), *((F.col(f"v{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)))

    near = sound.join(_salted(mid), [*keys, "salt"])
    squashed = near.select(*keys, *(F.round(1000 * F.tanh((F.col(f"z{i}") - F.col(f"m{i}")) / F.sqrt(f"v{i}"))).cast("bigint").alias(f"t{i}") for i in range(DIMS)))
    r = lambda i, j: F.coalesce(_raw(i, j) / F.sqrt(F.nullif(_raw(i, i) * _raw(j, j), F.lit(0.0))), F.lit(0.0))
    both = _sums(squashed, keys, "t").join(mid, keys)
    tied = both.select(*keys, F.lit(1).alias("start"), *(f"m{i}" for i in range(DIMS)), *((F.col(f"v{i}") if i == j else r(i, j) * F.sqrt(F.col(f"v{i}") * F.col(f"v{j}"))).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)))

    # a row takes part in a start if its hash falls so; the subsets of different starts are disjoint
    turn = F.pmod(F.xxhash64("id", *(f"z{i}" for i in range(DIMS)), F.lit(17)), F.ceil(F.col("rows") / SUBSET)).cast("int")
    few = _spread(_sums(near.withColumn("start", turn + 2).where(F.col("start") < 2 + RANDOM), [*keys, "start"]), [*keys, "start"])
    return held.keep(_cholesky(plain.union(tied).union(few), [*keys, "start"]), "starts")


def _step(sound: DataFrame, fit: DataFrame, keys: list[str], core: float) -> DataFrame:
    """The estimates from the share ``core`` of each group's rows that are nearest to the present ones."""
    by = [*keys, "start"]
    bins = _sums(_distance(sound, fit, keys).withColumn("q", _quantised()), [*by, "q"])
    order = Window.partitionBy(*by)
    bins = bins.withColumns({"before": F.sum("n").over(order.orderBy("q")) - F.col("n"), "all": F.sum("n").over(order)})
    near = bins.where(F.col("before") < core * F.col("all"))
    return _cholesky(_spread(near.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _SUMS)), by), by)


def _least(fit: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each group's estimates the ``most`` of least determinant."""
    order = Window.partitionBy(*keys).orderBy("logdet", "start")
    return fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distance(rows: DataFrame, fit: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's estimate, by forward substitution."""
    df = rows.join(_salted(fit), [*keys, "salt"], how)
    for i in range(DIMS):
        rest = F.col(f"z{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    df = df.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(DIMS)), F.lit(0.0)))
    return df.drop(*(c for c in df.columns if c[0] in "mly" and c[1:].isdigit()))


def _quantised(d2: str = "d2") -> Column:
    """The distance on a logarithmic scale of whole numbers, at most a few thousand of them."""
    return F.round(200 * F.log1p(d2)).cast("bigint")


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, core: float = 0.75, steps: int = STEPS, least: int = 200) -> DataFrame:
    """Per input row: id_col, the counts of ``text_counts``, base_failed, distance, kept.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows. kept is false for these
    and for rows whose distance passes ``cutoff``. Estimates are made per language and source from rows that pass the
    base rules; sources with fewer than ``least`` such rows are estimated together, per language.

    A null text counts as empty and so fails; null languages or sources form groups of their own; a null id is kept as
    it is, and repeated rows get equal values. Where no row of a group passes the base rules, none is judged further
    (distance null). An empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("g"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"))
    counts = text_counts(named).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = counts.withColumn("base_failed", failed).select("*", *_statistics(), F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt"))
    held = Scratch(docs.sparkSession, "outliers")
    rows = held.keep(rows, "counts")

    sizes = rows.where("not base_failed").groupBy("g", "s").agg(F.count("*").alias("c")).select("g", "s", F.when(F.col("c") >= least, F.col("s")).otherwise("*").alias("t"))
    rows = rows.join(_salted(held.keep(sizes, "sizes")), ["g", "s", "salt"], "left").withColumn("s", F.coalesce("t", F.lit("*"))).drop("t")
    keys = ["g", "s"]
    sound = rows.where("not base_failed").select(*keys, "salt", "id", *(f"z{i}" for i in range(DIMS)))

    fit = _starts(sound, keys, held)
    for turn in range(steps):
        new = _step(sound, fit, keys, core)
        new = held.keep(_least(new, keys, 2) if turn == 1 else new, f"step-{turn % 2}")
        moved = new.join(fit.select(*keys, "start", F.col("logdet").alias("old")), [*keys, "start"]).where(F.abs(F.col("logdet") - F.col("old")) > 1e-9)
        done = turn > 1 and not moved.limit(1).count()
        fit = new
        if done:
            break
    fit = held.keep(_least(fit, keys, 1), "estimate")
    far = _distance(sound, fit, keys).withColumn("q", _quantised())
    scale = far.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.expm1(F.percentile("q", F.lit(0.5)) / 200) / CHI_MEDIAN).alias("scale"))
    fit = held.keep(fit.join(scale, keys), "scaled")

    out = _distance(rows, fit, keys, "left").withColumn("distance", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))

