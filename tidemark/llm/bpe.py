"""Byte-level BPE with content-defined chunk reuse.

A text is cut where a rolling hash of the last 16 bytes says so, at places between a word and the white space behind
it. Chunks are therefore the same in every document that holds a passage, and each distinct chunk is encoded and decoded
once per worker as long as its bounded store holds it. Joins are then repaired: the words at both sides are encoded
together, and where that differs from the parts, the two chunks are merged and encoded again, until all joins agree.

Chunks of common Latin characters are encoded by tiktoken with the same vocabulary, others, and those that hold a
special token's text, by the tokenizers library, whose ids define the result.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Pre-tokenisation of the vocabulary; a fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Mean chunk of about this many cut places (words).
EVERY = 64
#: Chunks, of CACHE_LONGEST bytes at most, that a worker keeps.
CACHE, CACHE_LONGEST = 40_000, 8192
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ſ‐-‧‰-⁞]*")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where texts may be cut by content: before white space that follows a word, if the hash of the 16 bytes before falls right."""
    if len(data) < 18:
        return np.zeros(0, np.int64)
    space = words._SPACE[data]
    at = np.flatnonzero(space[17:] & ~space[16:-1]) + 17
    view = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    h = words.mix(view[at - 8] * words._ODD[5] + view[at - 16] * words._ODD[6])
    return at[h % np.uint64(EVERY) == 0]


class Codec:
    """Encodes chunks and joins them; holds the worker's store of chunks."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        spec = json.loads(self.exact.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        byte = {c: b for b, c in byte_chars().items()}
        self.bytes = {i: bytes(byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.bytes |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.kept: dict[bytes, tuple] = {}

    def ids(self, text: str) -> list[int]:
        if (text.isascii() or _PLAIN.fullmatch(text)) and not any(x in text for x in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def chunk(self, raw: bytes) -> tuple[array, bytes, str, list[int], str, list[int]]:
        """Ids and decoded bytes of a chunk, and its first and last word with their ids."""
        got = self.kept.get(raw)
        if got is None:
            text = raw.decode()
            ids = self.ids(text)
            words_ = text.split()
            head = text[: text.find(words_[0]) + len(words_[0])] if words_ else text
            tail = text[text.rfind(words_[-1]) - 1 :] if len(words_) > 1 else text
            got = array("i", ids), b"".join(map(self.bytes.__getitem__, ids)), head, self.ids(head), tail, self.ids(tail)
            if len(raw) <= CACHE_LONGEST:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[raw] = got
        return got

    def encode(self, raw: bytes, at: list[int]) -> tuple[array, bytes]:
        """Ids and decoded bytes of a text that is cut at the given places."""
        ends = [*at, len(raw)]
        parts: list[tuple[int, int, tuple]] = []
        a = 0
        for z in ends:
            got = self.chunk(raw[a:z])
            while parts:
                left = parts[-1][2]
                if self.ids(left[4] + got[2]) == left[5] + got[3]:
                    break
                a = parts.pop()[0]  # the join does not agree: merge, encode again, look at the next join to the left
                got = self.chunk(raw[a:z])
            parts.append((a, z, got))
            a = z
        if len(parts) == 1:
            return parts[0][2][0], parts[0][2][1]
        ids = array("i")
        for p in parts:
            ids += p[2][0]
        return ids, b"".join(p[2][1] for p in parts)


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_made: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def _coder(path: str):
    def code(batches):
        codec = _codec(path)
        for batch in batches:
            for w in words.slices(batch.column(1)):
                raw, where = w.data.tobytes(), cuts(w.data)
                span = np.searchsorted(where, w.offsets)
                # a cut needs its 16 bytes and the word before it within the text
                ids, texts, sizes = array("i"), [], [0]
                for k in range(w.last - w.first):
                    a, z = int(w.offsets[k]), int(w.offsets[k + 1])
                    own = where[span[k] : span[k + 1]] - a
                    got, back = codec.encode(raw[a:z], own[own >= 16].tolist()) if z > a else (array("i"), b"")
                    ids += got
                    sizes.append(len(ids))
                    texts.append(back.decode(errors="replace"))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(ids, np.int32)) if len(ids) else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.last - w.first), lists, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return code


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id_col, ids (array<int>), decoded (the text that the ids stand for).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library. Null, empty texts have no ids and
    decode to the empty text. Null and repeated ids of rows are kept as they are. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coder(tokenizer), "id bigint, ids array<int>, decoded string").withColumnRenamed("id", id_col)
