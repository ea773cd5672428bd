"""URL models, vector codes and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, urls, vector_codes

from .common import addresses, empty_documents, odd_documents, odd_rows

# --- fill in the middle -----------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_truth(doc_id, text, seed=42):
    text = text or ""
    u = UNIT.findall(text)
    h = [int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(5)
    pieces = ["a", "word", "é", "日本", "😀", " ", "  ", "\n", "\t\r\n", "\x1c", "\x85", "\u2028", "<", "<P", "S>", "<M", "\x00"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return out + ["x <P> y", "x<S>", "<M>", "<<P>", " ", "\n\n  ", "a" * 50_000, " " * 50_000, "a " * 50_000, "\n\n" + "b\n\n" * 999]


@pytest.mark.parametrize("stretch", [1, 7, 1 << 18])
def test_units(stretch, monkeypatch):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    monkeypatch.setattr(fim, "STRETCH", stretch)
    split = Split(Regex(fim.UNIT), behavior="isolated")
    for text in fim_texts()[: 150 if stretch < 100 else None]:
        assert fim.unit_ends(text, split).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_fill_in_middle(spark):
    rows = [(k, t) for k, t in enumerate(fim_texts())] + [(None, "one two three"), (7, None), (3, "again")]
    out = fim.fill_in_middle(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, form string, n int"))
    got = Counter((r.row.doc_id, r.row.text, r.row.form, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((i, t, "x", *fim_truth(i, t)) for i, t in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    back = out.select(F.coalesce("row.text", F.lit("")).alias("text"), fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_fill_in_middle_odd(spark):
    got = fim.fill_in_middle(odd_documents(spark)).collect()
    assert Counter((r.row.doc_id, r.output) for r in got) == Counter((r[0], fim_truth(r[0], r[1])[4]) for r in odd_rows())
    assert fim.fill_in_middle(empty_documents(spark)).collect() == []
    rates = fim.fill_in_middle(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text")), rate=90, spm=10)
    share = {r.form: r["count"] / 2000 for r in rates.groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.09) < 0.03


# --- vector codes -----------------------------------------------------------------------------------------------------


def codes_truth(rows, parts, entries, rounds):
    """In Python's integers: codebooks, and code and error per kept row."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=1) // parts)
    kept = [(i, v + [0] * (parts * width - len(v))) for i, v in kept]
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p] for _, v in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v in cut:
                of[near(v[p], books[p])[1]].append(v[p])
            for k, xs in of.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v in cut:
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return books, Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, code string, error int").repartition(5)


@pytest.mark.parametrize("entries, rounds", [(16, 4), (4, 1), (256, 2)])
def test_codebooks(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    centre = rng.normal(size=(6, 12))
    rows = [(int(k), [float(x) for x in centre[rng.integers(6)] + 0.3 * rng.normal(size=12)]) for k in rng.permutation(200)]
    rows += [(500 + k, [0.25] * 12) for k in range(90)]  # one very common vector, so ties and unused entries
    rows += [(0, [-0.001] * 12), (None, [1.0] * 12), (None, [-1.0] * 12), (900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] * 12), (904, []), (905, [0.5] * 7)]
    df = vectors(spark, rows)
    books = vector_codes.learn(df, entries=entries, rounds=rounds)
    want, coded = codes_truth(rows, 4, entries, rounds)
    assert books.entries.tolist() == want
    assert books.digest() == hashlib.sha256(",".join(str(x) for p in want for e in p for x in e).encode()).hexdigest()
    out = vector_codes.encode(df, books)
    assert Counter((r.row.vec_id, r.code, r.error) for r in out.collect()) == coded
    for r in out.select("code", "error", vector_codes.decode(F.col("code"), books).alias("v"), F.col("row.embedding").alias("e")).collect():
        whole = [math.floor(1024 * x) for x in r.e] + [0] * (12 - len(r.e))
        assert sum((a - 1024 * b) ** 2 for a, b in zip(whole, r.v, strict=True)) == r.error


def test_codebooks_of_large_components(spark):
    rows = [(k, [float((-1) ** k * 2**17 * (1 + k % 5) / 5.1)] * 32) for k in range(40)]
    df = vectors(spark, rows)
    want, coded = codes_truth(rows, 4, 8, 2)
    books = vector_codes.learn(df, entries=8, rounds=2)
    assert books.entries.tolist() == want
    assert Counter((r.row.vec_id, r.code, r.error) for r in vector_codes.encode(df, books).collect()) == coded
    for far in (float(2**18), -1e300):
        with pytest.raises(ValueError, match="exact"):
            vector_codes.learn(vectors(spark, [*rows, (99, [far] * 32)]))


def test_codebooks_of_nothing(spark):
    for rows in ([], [(1, None)]):
        df = vectors(spark, rows)
        books = vector_codes.learn(df)
        assert books.entries.shape[:2] == (4, 0) and vector_codes.encode(df, books).collect() == []


# --- URLs -------------------------------------------------------------------------------------------------------------

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def judge_truth(rows):
    """Counts by dictionary, probabilities by recursion, the threshold by trying every place between bins."""
    spell = lambda u: "\x02" + lower(u.split("://", 1)[1] if u and "://" in u else u or "") + "\x03"
    fold = lambda u: int(hashlib.md5((u or "").encode()).hexdigest()[:7], 16) % urls.FOLDS == 0
    follow = {v: defaultdict(Counter) for v in ("allow", "block")}
    label = {u: (rule_of(*split_url(u)) or (None,))[0] for u in rows}
    for u in rows:
        if label[u] and not fold(u):
            t = spell(u)
            for i in range(1, len(t)):
                for k in range(min(i, urls.ORDER - 1) + 1):
                    follow[label[u]][t[i - k : i]][t[i]] += 1

    def p(v, context, c):
        shorter = p(v, context[1:], c) if context else 1 / 256
        seen = follow[v].get(context)
        return (seen[c] + len(seen) * shorter) / (sum(seen.values()) + len(seen)) if seen else shorter

    def mean(u):
        t, total = spell(u), 0
        for i in range(1, len(t)):
            context = t[max(0, i - urls.ORDER + 1) : i]
            total += math.floor((math.log(p("allow", context, t[i])) - math.log(p("block", context, t[i]))) * urls.PARTS + 0.5)
        return total / (len(t) - 1)

    means = {u: mean(u) for u in label if label[u] is None or fold(u)}
    seen = [(math.floor(means[u] / urls.BIN), label[u]) for u in rows if label[u] and fold(u)]
    good, bad = ([b for b, v in seen if v == w] for w in ("allow", "block"))
    cut = 0.0
    if good and bad:
        held = sorted({b for b, _ in seen})
        places = [held[0] * urls.BIN] + [(a + b + 1) / 2 * urls.BIN for a, b in zip(held, held[1:], strict=False)]
        lost = lambda t: sum(b * urls.BIN < t for b in good) * len(bad) + sum(b * urls.BIN >= t for b in bad) * len(good)
        cut = min(places, key=lambda t: (lost(t), abs(t), t))
    out = []
    for u in rows:
        host, path = split_url(u)
        r = rule_of(host, path)
        score = None if r else (means[u] - cut) / urls.PARTS
        out.append((u, host, path, r and r.host + r.path, r.verdict if r else "allow" if score >= 0 else "block", score))
    return out


def key(rows):
    return Counter((*r[:5], None if r[5] is None else round(r[5], 9)) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_judge(spark, seed):
    rows = addresses(seed, 200)
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(rows)], "page_id bigint, url string, host string, verdict string").repartition(5)
    got = urls.judge(df, RULES).collect()
    assert key([(r.row.url, r.host, r.path, r.rule, r.verdict, r.score) for r in got]) == key(judge_truth(rows))
    assert len({r.verdict for r in got if r.rule is None}) == 2


@pytest.mark.parametrize("only", ["com/de/", "net/es/", "org/", None])
def test_judge_without_one_of_the_classes(spark, only):
    rows = [u for u in addresses(4, 300) if u and only and only in u] + ["http://a.org/b", None]
    got = urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), RULES).collect()
    assert key([(r.row.url, r.host, r.path, r.rule, r.verdict, r.score) for r in got]) == key(judge_truth(rows))
    assert urls.judge(spark.createDataFrame([], "url string"), RULES).collect() == []
    if only is None:
        assert {r.verdict for r in urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), []).collect()} == {"allow"}


def test_models_tell_unruled_addresses_apart(spark):
    """Sites of two kinds, half of each under a rule: the others are judged as their kind."""
    rng = random.Random(6)
    kinds = (["cheap-pills", "casino-win", "free-bets"], ["garden-club", "city-news", "maths-notes"])
    rows = [(k, f"http://{rng.choice(kinds[k % 2])}{rng.randint(1, 99)}.{'org' if k % 4 < 2 else ('good', 'bad')[1 - k % 2]}/{rng.randint(1, 9999)}") for k in range(1200)]
    rules = [urls.Rule("block", "bad", ""), urls.Rule("allow", "good", "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule is null").collect()
    right = [(r.verdict == "allow") == (r.row.page_id % 2 == 1) for r in got]
    assert len(right) == 600 and np.mean(right) > 0.97
