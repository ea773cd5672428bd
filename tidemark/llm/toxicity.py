"""Toxic spans by a linear-chain conditional random field.

Labelled tokens come from labelled documents: in a toxic one, tokens with a word or word-beginning that toxic documents
hold far more often than clean ones are positive, all other tokens negative. A two-state chain with these words and
beginnings as features is trained on them by forward-backward. Marginals give the offending tokens' offsets; their sum,
largest value and share make the document's score through a small logistic model, fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .sampling import sample, texts
from .shared import crc_mod

PER_CLASS, FEATURES = 3000, 20_000
#: Sampled texts of each label whose tokens train the chain's weights; features and the document model use the whole sample.
CHAIN = 600
#: Word beginnings, in bytes, that serve as features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature marks a token if its documents are toxic this much (log) more often, and so many at least.
LIFT, SUPPORT = 1.0, 3
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


class Tokens:
    """Words of a slice without punctuation at their edges, with the keys of their features."""

    def __init__(self, w: words.Words):
        self.w, self.doc = w, w.doc()
        self.starts, self.ends = w.starts.copy(), w.ends.copy()
        live = np.arange(len(self.starts))
        while len(live):
            live = live[(self.starts[live] < self.ends[live]) & _EDGE[w.data[np.minimum(self.starts[live], len(w.data) - 1)]]]
            self.starts[live] += 1
        live = np.arange(len(self.ends))
        while len(live):
            live = live[(self.starts[live] < self.ends[live]) & _EDGE[w.data[self.ends[live] - 1]]]
            self.ends[live] -= 1
        pad = np.concatenate([w.data, np.zeros(8, np.uint8)])
        self.view = np.ndarray((len(w.data) + 1,), "<u8", pad.data, 0, (1,))
        self.lens = self.ends - self.starts

    def gate(self) -> np.ndarray:
        """A 16-bit key of the first four bytes, which every feature of the token shares."""
        head = self.view[self.starts] & words._TAIL[np.minimum(self.lens, 4)]
        return (words.mix(head) >> np.uint64(48)).astype(np.int64)

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        """For each kind of feature, the keys of the tokens at ``at``; 0 where a token is too short to have it."""
        part = words.Words(0, 0, self.w.data, self.starts[at], self.ends[at], self.w.bounds, self.w.offsets)
        lens, head = self.lens[at], self.view[self.starts[at]]
        out = [np.where(lens > 0, part.hashes(), np.uint64(0))]
        for n in BEGINNINGS:
            out.append(np.where(lens > n, words.mix((head & words._TAIL[n]) ^ words._ODD[n]), np.uint64(0)))
        return out


def _tokens(column: pa.Array):
    for w in words.slices(column, lower=True, size=words.SLICE // 2):
        yield Tokens(w)


def marginals(e: np.ndarray, first: np.ndarray, model: dict) -> tuple[np.ndarray, tuple]:
    """P(state 1) at each position, and what ``_pair_counts`` needs, for chains that begin where first is true.

    e holds the log-odds that each position's features add to state 1. Chains lie end to end: a position that begins one
    forgets what was before. The positions are cut in blocks of about the square root of their number; step k of all
    blocks is done at once. Products of the 2 x 2 steps are made per block, carried over the blocks, and applied within.
    Numbers are scaled back often enough that none leaves the range.
    """
    n = len(e)
    if not n:
        return np.zeros(0), ()
    psi, start, move = np.exp(np.clip(e, -30, 30)), model["start"], model["move"]
    m = [[np.where(first, start[t], move[s, t]) * (psi if t else 1.0) for t in (0, 1)] for s in (0, 1)]
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    fill = np.full(rows * width - n, 0.5)
    (p, q), (r, s) = [[np.ascontiguousarray(np.concatenate([x, fill]).reshape(rows, width).T) for x in row] for row in m]

    a, b, c, d = p[0], q[0], r[0], s[0]
    for k in range(1, width):
        a, b, c, d = a * p[k] + b * r[k], a * q[k] + b * s[k], c * p[k] + d * r[k], c * q[k] + d * s[k]
        if k % 8 == 0 or k == width - 1:
            t = a + b + c + d
            a, b, c, d = a / t, b / t, c / t, d / t
    into, back = np.empty((2, rows)), np.empty((2, rows))
    u, v = 0.5, 0.5
    for k in range(rows):
        into[:, k] = u, v
        u, v = u * a[k] + v * c[k], u * b[k] + v * d[k]
        u, v = u / (u + v), v / (u + v)
    u, v = 1.0, 1.0
    for k in range(rows - 1, -1, -1):
        back[:, k] = u, v
        u, v = a[k] * u + b[k] * v, c[k] * u + d[k] * v
        u, v = u / (u + v), v / (u + v)
    alpha, beta = np.empty((2, width, rows)), np.empty((2, width, rows))
    u, v = into
    for k in range(width):
        u, v = u * p[k] + v * r[k], u * q[k] + v * s[k]
        if k % 8 == 0:
            t = u + v
            u, v = u / t, v / t
        alpha[0, k], alpha[1, k] = u, v
    u, v = back
    for k in range(width - 1, -1, -1):
        beta[0, k], beta[1, k] = u, v
        u, v = p[k] * u + q[k] * v, r[k] * u + s[k] * v
        if k % 8 == 0:
            t = u + v
            u, v = u / t, v / t
    alpha, beta = (x.transpose(0, 2, 1).reshape(2, -1)[:, :n] for x in (alpha, beta))
    w = alpha * beta
    return w[1] / (w[0] + w[1]), (alpha, m, beta)


def _pair_counts(chain: tuple, first: np.ndarray) -> np.ndarray:
    """Expected number of each pair of states at neighbouring positions."""
    alpha, m, beta = chain
    inner = np.flatnonzero(~first)
    both = [alpha[s, inner - 1] * m[s][t][inner] * beta[t, inner] for s in (0, 1) for t in (0, 1)]
    total = sum(both)
    return np.array([(x / total).sum() for x in both]).reshape(2, 2)


def _lifted(column: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the features that mark toxic documents, with their lifts."""
    keys, counts = [], []
    for t in _tokens(column):  # a document lies in one slice, so each slice counts its own
        for k in t.keys(np.arange(len(t.starts))):
            some = np.flatnonzero(k)
            once = some[np.unique(words.mix(k[some] + t.doc[some].astype(np.uint64) * words._ODD[9]), return_index=True)[1]]
            key, inv = np.unique(k[once], return_inverse=True)
            bad = y[t.w.first : t.w.last][t.doc[once]] == 1
            keys.append(key)
            counts.append(np.stack([np.bincount(inv, bad, len(key)), np.bincount(inv, ~bad, len(key))], 1).astype(np.int32))
    label = y == 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    key, inv = np.unique(np.concatenate(keys), return_inverse=True)
    pos, neg = (np.bincount(inv, np.concatenate([c[:, j] for c in counts]), len(key)) for j in (0, 1))
    lift = np.log((pos + 0.5) / (label.sum() + 1)) - np.log((neg + 0.5) / ((~label).sum() + 1))
    # a standard error below, the lift must still stand out: among many rare features some are lifted by chance
    good = (pos >= SUPPORT) & (lift - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) >= LIFT)
    if good.sum() > FEATURES:
        good &= lift * np.sqrt(pos) >= np.sort((lift * np.sqrt(pos))[good])[-FEATURES]
    return key[good], lift[good]


def _feature_ids(t: Tokens, vocab: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, feature) pairs; only tokens whose first bytes open the gate are looked up."""
    at = np.flatnonzero(gate[t.gate()]) if len(t.starts) else np.zeros(0, np.int64)
    who, what = [], []
    for k in t.keys(at):
        f = np.minimum(np.searchsorted(vocab, k), max(0, len(vocab) - 1))
        ok = vocab[f] == k if len(vocab) else np.zeros(len(k), bool)
        who.append(at[ok])
        what.append(f[ok])
    return np.concatenate(who), np.concatenate(what)


def _flat(tokens: list[Tokens], vocab: np.ndarray, gate: np.ndarray) -> tuple:
    """(token, feature) pairs, document of each token, and where documents begin, over all slices."""
    who, what, doc, base, docs = [], [], [], 0, 0
    for t in tokens:
        a, f = _feature_ids(t, vocab, gate)
        who.append(a + base)
        what.append(f)
        doc.append(t.doc + docs)
        base, docs = base + len(t.starts), docs + t.w.last - t.w.first
    doc = np.concatenate(doc)
    return np.concatenate(who), np.concatenate(what), doc, np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)


def _evidence(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: what its marginals sum to, their largest, and their share."""
    total, most = np.bincount(doc, p, n), np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.log1p(total), np.minimum(total, 3), most, np.sqrt(total / np.maximum(1, np.bincount(doc, minlength=n)))], 1)


def train(column: pa.Array, y: np.ndarray, bad_share: float, chain_docs: int = CHAIN) -> dict:
    """The chain's weights, from ``chain_docs`` texts of each label, and the document model, from all sampled ones."""
    model = {"vocab": np.zeros(0, np.uint64), "w": np.zeros(0), "b": -6.0, "start": np.array([0.5, 0.5]), "move": np.full((2, 2), 0.5), "gate": np.zeros(1 << 16, bool), "doc": (np.zeros(4), np.ones(4), np.zeros(4), -3.0)}
    if not (y == 1).any() or not (y == 0).any():
        return model
    # tokens are made anew for each use, a slice at a time: held, they would take many times the texts' room
    vocab, lift = _lifted(column, y)
    if not len(vocab):
        return model
    for t in _tokens(column):  # the first bytes of every token that has a feature open the gate
        at = np.arange(len(t.starts))
        open_ = np.zeros(len(at), bool)
        for k in t.keys(at):
            f = np.minimum(np.searchsorted(vocab, k), len(vocab) - 1)
            open_ |= vocab[f] == k
        model["gate"][t.gate()[open_]] = True

    few = np.sort(np.concatenate([np.flatnonzero(y == k)[:chain_docs] for k in (0, 1)]))
    who, what, doc, first = _flat(list(_tokens(column.take(pa.array(few)))), vocab, model["gate"])
    base = len(doc)
    marked = np.zeros(base, bool)
    marked[who] = True
    target = marked & (y[few][doc] == 1)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pairs, (target[inner - 1].astype(int), target[inner].astype(int)), 1)

    w, b, log_move, log_start = np.clip(lift, 0, 4) / 2, -3.0, np.zeros((2, 2)), np.zeros(2)
    size = len(w)
    m, v = np.zeros(size + 7), np.zeros(size + 7)
    gold = np.concatenate([np.bincount(what, target[who], size), [target.sum()], pairs.ravel(), [(~target[first]).sum(), target[first].sum()]])
    scale = 1 / max(1, target.sum())
    for k in range(1, 61):
        model |= {"start": np.exp(log_start), "move": np.exp(log_move)}
        e = np.bincount(who, w[what], base) + b
        p, chain = marginals(e, first, model)
        got = np.concatenate([np.bincount(what, p[who], size), [p.sum()], _pair_counts(chain, first).ravel(), [(1 - p[first]).sum(), p[first].sum()]])
        g = (got - gold) * scale + 1e-3 * np.concatenate([w, [0], log_move.ravel(), log_start])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:size], b - move[size]
        log_move, log_start = log_move - move[size + 1 : size + 5].reshape(2, 2), log_start - move[size + 5 :]
    model |= {"vocab": vocab, "w": w, "b": float(b), "start": np.exp(log_start), "move": np.exp(log_move)}

    parts = []
    for t in _tokens(column):
        who, what, doc, first = _flat([t], vocab, model["gate"])
        p, _ = marginals(np.bincount(who, w[what], len(doc)) + b, first, model)
        parts.append(_evidence(p, doc, t.w.last - t.w.first))
    x = np.concatenate(parts)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / sd
    weight = np.where(y == 1, bad_share / (y == 1).sum(), (1 - bad_share) / (y == 0).sum())
    u, c = np.zeros(4), 0.0
    for _ in range(400):  # iteratively reweighted least squares would do; plain steps are enough for four weights
        q = 1 / (1 + np.exp(-(z @ u + c)))
        r = weight * (q - y)
        u, c = u - 2 * (z.T @ r + 1e-4 * u), c - 2 * r.sum()
    model["doc"] = (mean, sd, u, float(c))
    return model


def _document_scores(model: dict, x: np.ndarray) -> np.ndarray:
    mean, sd, u, c = model["doc"]
    return 1 / (1 + np.exp(-np.clip((x - mean) / sd @ u + c, -30, 30)))


_SCHEMA = "score double, spans array<struct<start:int,end:int,p:double>>"


def _tagger(shared):
    def tag(column: pa.Array) -> pa.Array:
        model, scores, spans, sizes = shared.value, [], [], [np.zeros(1, np.int64)]
        for t in _tokens(column):
            w, n = t.w, t.w.last - t.w.first
            who, what = _feature_ids(t, model["vocab"], model["gate"])
            e = np.bincount(who, model["w"][what], len(t.starts)) + model["b"]
            first = np.concatenate([[True], t.doc[1:] != t.doc[:-1]]) if len(t.doc) else np.zeros(0, bool)
            p, _ = marginals(e, first, model)
            scores.append(_document_scores(model, _evidence(p, t.doc, n)))
            hit = np.flatnonzero(p >= 0.5)
            before = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            zero = before[w.offsets[t.doc[hit]]]
            spans.append((before[t.starts[hit]] - zero, before[t.ends[hit]] - zero, p[hit]))
            sizes.append(np.bincount(t.doc[hit], minlength=n))
        start, end, p = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0),) * 3
        inner = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(p.astype(float))], ["start", "end", "p"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), inner)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), lists], ["score", "spans"])

    return tag


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 4, held: int = 2, per_class: int = PER_CLASS, chain_docs: int = CHAIN) -> Callable[[Column], Column]:
    """Learn from the labelled rows that are not held out; the result maps a text column to struct<score, spans>."""
    out = F.coalesce(crc_mod(id_col, mod) == held, F.lit(True))
    ids = sample(labels.where(F.col(label_col).isin(0, 1)).select(id_col, label_col).distinct(), id_col, label_col, per_class, out)
    rows = texts(docs, ids, id_col, text_col, per_class)
    n = {int(r["label"]): r["n"] for r in rows}
    column, y = pa.array([r["text"] for r in rows], pa.string()), np.array([r["label"] for r in rows], int)
    del rows
    model = train(column, y, n.get(1, 0) / max(1, sum(n.values())), chain_docs)
    del column
    words.settle()
    # called nondeterministic only so that Spark does not run it again for a filter on its result
    tag = F.arrow_udf(_tagger(docs.sparkSession.sparkContext.broadcast(model)), _SCHEMA).asNondeterministic()
    return lambda text: tag(text.cast("string"))


def tag_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 4, held: int = 2, per_class: int = PER_CLASS, chain_docs: int = CHAIN, threshold: float = 0.3) -> DataFrame:
    """Per input row: id_col, held_out, score, predicted (1 if score >= threshold), spans (start, end in code points, p).

    Learns from labelled rows whose crc32(id) mod ``mod`` is not ``held``: about ``per_class`` of each label, of
    any length, while they come to 4 MB a label at most; the chain's weights are trained on the tokens of the first
    ``chain_docs`` of each, features and the document model on all. A score uses the text alone.

    Null, empty and blank texts have no token, no span and the score of no evidence. Without labels of both kinds all
    texts score alike, near 0. A null id is held out. Repeated rows get equal values; an empty table gives an empty
    result; other columns are ignored.
    """
    tag = fit(docs, labels, id_col, text_col, label_col, mod, held, per_class, chain_docs)
    got = docs.select(F.col(id_col), tag(F.col(text_col)).alias("_x"))
    out = F.coalesce(crc_mod(id_col, mod) == held, F.lit(True))
    return got.select(id_col, out.alias("held_out"), "_x.score", (F.col("_x.score") >= threshold).cast("int").alias("predicted"), "_x.spans")
