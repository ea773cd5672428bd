"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

The cost of a run of n tokens is linear + quadratic: n * (1 + n / capacity). Within a block of documents, runs in
descending cost go to the lowest-cost sequence that has room for them; where none has, the lowest-cost sequence with
any room takes what fits and the rest queues again. A block opens only as many sequences as its tokens fill, and hands
what is over to the next block, so only the end of a partition leaves a partial sequence. Its tokens go to sequences of
power-of-two lengths, which need no padding. Nothing is shuffled: blocks lie within partitions, ids of sequences are
made of partition and count, and a lost task is repeated with the same result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .bpe import byte_chars

BLOCK = 1 << 19
#: Word encodings that a worker keeps; beyond it, all are dropped and made anew when met.
CACHE = 150_000


#: Words of these characters are lower-cased and split alike by Python and by the tokenizer; others are left to the latter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split of a word, for such characters in lower case; a fixed value.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_END = b"\xff"  # stands for a word's end; it occurs in no UTF-8 text


class _WordIds(dict):
    """Ids of each word, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and splits at it, so a text's ids are those of its words in turn. Its
    merges are numbered as its ids are, which makes the ids ranks of a byte-pair encoding over bytes and an end mark;
    tiktoken's core applies that several times as fast to common words. Where the file is made otherwise, or a word has
    other characters or a special token's text, the tokenizer itself is asked.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.core = self._core(json.loads(self.tokenizer.to_str()))

    def _core(self, spec: dict):
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        if spec["model"].get("end_of_word_suffix") != "</w>" or any(vocab[a + b] != 512 + k for k, (a, b) in enumerate(merges)):
            return None
        byte = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(byte[c] for c in s.removesuffix("</w>")) + _END * s.endswith("</w>"): i for s, i in vocab.items() if s not in self.special}
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.core and _PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            ids = array("I")
            for part in _PART.findall(text.lower()):
                ids.extend(self.core(part.encode() + _END))
            ids = ids.tobytes()
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


_made: dict[str, _WordIds] = {}


def _word_ids(path: str) -> _WordIds:
    if path not in _made:
        _made[path] = _WordIds(path)
    return _made[path]


def assign(lengths: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(run, start within it, length, sequence) for runs whose lengths sum to the capacities' sum at most."""
    room = np.array(capacities, np.int64)
    unit = float(max(capacities, default=1))
    cost = np.zeros(len(room))
    queue = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, k, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        to = int(fits.argmin())
        if room[to] < n:
            to = int(np.where(room > 0, cost, np.inf).argmin())
        put = min(n, int(room[to]))
        out.append((k, start, put, to))
        room[to] -= put
        cost[to] += put * (1 + put / unit)
        if put < n:
            heapq.heappush(queue, (put - n, k, start + put))
    return out


def _powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


_SCHEMA = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(path: str, capacity: int, end_id: int, block: int):
    end = array("I", [end_id]).tobytes()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def pack(batches):
        cache, base, count = _word_ids(path), TaskContext.get().partitionId() << 40, 0
        runs: list[tuple] = []  # id, ids, start in the document, end, tokens of the document
        held = 0

        def rows(pieces):
            cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

        def flush(last: bool):
            nonlocal runs, held, count
            short, whole = [], []
            for i, ids, a, z, n in runs:
                while z - a >= capacity:  # a run of full length costs most and fills a sequence by itself
                    whole.append((i, a, capacity, ids[4 * a : 4 * (a + capacity)], n, base + count, 0))
                    a, count = a + capacity, count + 1
                if z > a:
                    short.append((i, ids, a, z, n))
            total = sum(z - a for _, _, a, z, _ in short)
            over, runs = total % capacity, []
            if not last:
                while over:
                    i, ids, a, z, n = short.pop()
                    take = min(over, z - a)
                    runs.append((i, ids, z - take, z, n))
                    over -= take
                    if z - take > a:
                        short.append((i, ids, a, z - take, n))
            held = sum(z - a for _, _, a, z, _ in runs)
            room = [capacity] * (total // capacity) + _powers(over)
            used = [0] * len(room)
            for k, start, length, to in assign([z - a for _, _, a, z, _ in short], room):
                i, ids, a, _, n = short[k]
                a += start
                whole.append((i, a, length, ids[4 * a : 4 * (a + length)], n, base + count + to, used[to]))
                used[to] += length
            count += len(room)
            return rows(whole)

        for batch in batches:
            known = batch.column(0).to_pylist()
            raw, offsets = words.texts(batch.column(1))
            for k, i in enumerate(known):
                ids = b"".join(map(cache.__getitem__, raw[offsets[k] : offsets[k + 1]].tobytes().split())) + end
                n = len(ids) // 4
                runs.append((i, ids, 0, n, n))
                held += n
                if held >= block:
                    yield flush(False)
                if len(cache) > CACHE:
                    cache.clear()
            words.settle()
        yield flush(True)

    return pack


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file whose pre-tokenizer drops white space. Each text's ids are followed
    by ``end_id``; a null, empty or blank text is that id alone. Pieces of a sequence lie gapless from offset 0 and each
    id lies in one piece. Null and repeated ids are kept as they are; every row is a document of its own. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_packer(tokenizer, capacity, end_id, block), _SCHEMA)
    return out.withColumnRenamed("id", id_col)
