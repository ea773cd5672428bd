"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text that people write takes few tokens of a vocabulary learned from such text; random strings take many. A run of
base64-like characters that has letters and comes to fewer than ``ratio`` characters a token is reported as
``random``, unless it is a digest (hex of a usual length) or a UUID. A run without digits, or of the shape of an
identifier, is reported only below ``STRICT`` of that ratio: clean words and identifiers take more characters a token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words
from .bpe import PATTERN

KINDS = ("assign", "access", "hex", "random")
#: What the three base patterns are, and the least length of what they must catch.
_KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Share of the ratio below which runs of letters alone, and runs that look like identifiers, count as random.
STRICT = 0.875
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGESTS = frozenset((32, 40, 48, 56, 64, 96, 128))
_HEX_ANY = re.compile("[0-9a-fA-F]+")
_UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDY = re.compile("(?:[A-Z]{2,}|[A-Z]?[a-z]{2,})(?:[_/=+-]?(?:[A-Z]{2,}|[A-Z]?[a-z]{2,}))*[_=-]?[0-9]{0,6}")
_NUMERIC = re.compile("[0-9+/_=-]+")

_OF_RUN = np.zeros(256, bool)
_OF_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, ends exclusive, in no particular order."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= _LEAST["hex"]]
    return out


def known(run: str) -> bool:
    """Whether a run is a digest, UUID or number rather than a random string."""
    if _HEX_ANY.fullmatch(run) and len(run) in _DIGESTS:
        return True
    return bool(_UUID.fullmatch(run) or _NUMERIC.fullmatch(run))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _text_runs(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a slice's texts, each cut where its text ends."""
    a, z = _runs(_OF_RUN[w.data])
    inner = w.offsets[(w.offsets > 0) & (w.offsets < len(w.data))]
    # only texts' ends inside a run cut it
    inner = np.unique(inner[_OF_RUN[w.data[inner]] & _OF_RUN[w.data[inner - 1]]])
    return np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([z, inner]))


_made: dict[str, object] = {}


def _encoding(path: str):
    if path not in _made:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def random_spans(text: str, taken: list[tuple[str, int, int]], encoding, ratio: float) -> list[tuple[str, int, int]]:
    """Runs with too few characters a token that the taken spans do not cover whole."""
    out, covered = [], []
    for a, z in sorted((a, z) for _, a, z in taken):  # what touches or overlaps counts as one
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], z)
        else:
            covered.append([a, z])
    k = 0
    for m in _RUN.finditer(text):
        run = m[0]
        while k < len(covered) and covered[k][1] < m.end():
            k += 1
        if known(run) or k < len(covered) and covered[k][0] <= m.start():
            continue
        n = len(encoding.encode_ordinary(run))
        wordy = not re.search("[0-9]", run) or _WORDY.fullmatch(run)
        if len(run) < (STRICT if wordy else 1) * ratio * n:
            out.append(("random", m.start(), m.end()))
    return out


def _scanner(vocabulary: str, ratio: float):
    def scan(column: pa.Array) -> pa.Array:
        encoding = _encoding(vocabulary)
        at, kind, start, end = [0], [], [], []
        for w in words.slices(column):
            n = w.last - w.first
            odd = np.zeros(n, bool)
            a, z = _text_runs(w)
            long = z - a >= 16
            a, z = a[long], z[long]
            if len(a):
                letters = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
                a, z = a[letters[z] > letters[a]], z[letters[z] > letters[a]]
                odd |= np.diff(np.searchsorted(a, w.offsets)) > 0
            for k in range(n):
                value = column[w.first + k].as_py() or ""
                found = base_spans(value)
                if odd[k]:
                    found += random_spans(value, found, encoding, ratio)
                found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                for s in found:
                    kind.append(s[0])
                    start.append(s[1])
                    end.append(s[2])
                at.append(len(kind))
        spans = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)

    return scan


def secret_spans(text: Column, vocabulary: str, ratio: float = 2.0) -> Column:
    """Column of spans: array<struct<kind, start, end>> in code points, ends exclusive, by start, then by kind as listed.

    ``vocabulary`` is the path of a tiktoken rank file. Null and empty texts give an empty array. It is computed per row,
    so ids, other columns and repeated rows do not matter.
    """
    return F.arrow_udf(_scanner(vocabulary, ratio), "array<struct<kind:string,start:int,end:int>>")(text)


def _cover(text: str | None, spans: list[dict], mask: str) -> str | None:
    """The text with every span replaced; overlapping spans are replaced together."""
    if text is None or not spans:
        return text
    done, parts = 0, []
    for x in spans:
        if x["start"] >= done:
            parts += [text[done : x["start"]], mask]
        done = max(done, x["end"])
    return "".join(parts) + text[done:]


def redact(text: Column, vocabulary: str, ratio: float = 2.0, mask: str = "[secret]") -> Column:
    """The text with every span of ``secret_spans`` replaced by ``mask``; null stays null. One Python step finds and replaces."""
    scan = _scanner(vocabulary, ratio)

    def cover(column: pa.Array) -> pa.Array:
        spans = scan(column)
        hit = np.diff(spans.offsets.to_numpy()) > 0
        if not hit.any():
            return column
        changed = [_cover(column[k].as_py(), spans[k].as_py(), mask) for k in np.flatnonzero(hit)]
        return pc.replace_with_mask(column, pa.array(hit), pa.array(changed, column.type))

    return F.arrow_udf(cover, "string")(text)
