"""Fixtures that every operator must bear: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["ba", "ko", "mi", "ter", "un", "sha", "lo", "ve", "dri", "po", "éa", "ß"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base, long = prose(rng, 120), prose(rng, 30000)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n\x0b ", "one", "one two", base, base, " ".join(near), base.upper(), base + " tail", prose(rng, 200) + " " + base, long, long, "x" * 200000, "same " * 3000, "a\x1cb\x85c d e", "日本語" * 300, "line one here\nline one here\n\nline one here", "😀 a<|endoftext|>b"]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None])) for k, t in enumerate(texts)]
    rows += [(None, base, "en", "s0"), (5, base, "en", "s0")]  # a null id, and a repeated row
    return [(*r, "clash", 7, True, 0.5) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, kept_text string, n_words bigint, kept boolean, score double"


def odd_documents(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed: int, n: int = 150) -> list[tuple[int, str]]:
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    out: list[str] = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.5 and out:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            out.append(" ".join(words))
        elif kind < 0.7:
            out.append(prose(rng, rng.randint(5, 100)) + " " + passage + "\n" + prose(rng, rng.randint(1, 40)))
        else:
            out.append(prose(rng, rng.randint(1, 250)))
    ids = rng.sample(range(1000), n)
    return list(zip(ids, out, strict=True))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def addresses(seed: int, n: int) -> list[str | None]:
    """Addresses of several domains and languages, copies, and odd ones."""
    rng = random.Random(seed)
    out: list[str | None] = []
    for _ in range(n):
        host = rng.choice(["", "www.", "m.", "blog."]) + rng.choice(["thing", "pills", "spam", "garden", "news"]) + rng.choice(["er", "ly", "on"]) + ".example." + rng.choice(["com", "net", "org", "com", "net"])
        out.append(rng.choice(["http", "https"]) + "://" + host + "/" + rng.choice(["en", "de", "es", "fr"]) + f"/{rng.randint(1, 999)}" + rng.choice(["", "/", ".html", "?page=2", "#top"]))
    odd = [None, "", "no scheme/en/", "http://", "http://EXAMPLE.com", "HTTP://Www.Example.COM/EN/", "ftp://x.net/es", "ftp://x.net/es/é日本😀", "a://b://c/d?e#f", "http://com/", "http://notcom/", "x" * 3000, "http://example.com/en/" + "y" * 3000, "http://host?q=/en/", "http://a\nb.net/fr/\n"]
    return out + odd + out[:5] * 3
