"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw content: whole training texts, one after the other, up to a bound. A text is compressed
in pieces of about ``PIECE`` bytes with each dictionary; the language with the smallest total wins. Pieces keep a long
text from being predicted by itself rather than by the dictionary.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import texts
from .shared import crc_mod

PIECE, LEVEL = 1024, 6
DICTIONARY = 110_000
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; number forms such as a half or a superscript are none."""
    return any(c.isalpha() for run in _WORD.finditer(text) for c in run.group())


def dictionaries(rows: list, size: int = DICTIONARY) -> dict[str, bytes]:
    """Raw contents per language from sampled (text, language) rows, in their order.

    Texts of up to a sixteenth of the size come first, so that no single one fills a dictionary; longer ones are cut to
    the room that these leave.
    """
    out: dict[str, bytes] = {}
    for long in (False, True):
        for row in rows:
            new = row["text"].lower().encode() + b"\n"
            if (len(new) > size // 16) == long:
                held = out.get(row["label"], b"")
                if long:
                    new = new[: size - len(held)].decode(errors="ignore").encode()
                if len(held) + len(new) <= size:
                    out[row["label"]] = held + new
    return out


def _pieces(raw: bytes, size: int) -> list[bytes]:
    out, a = [], 0
    while a < len(raw):
        z = min(len(raw), a + size)
        if z < len(raw):
            z = max(raw.rfind(b" ", a + 1, z), raw.rfind(b"\n", a + 1, z)) + 1 or z
        out.append(raw[a:z])
        a = z
    return out


def _compressors(contents: dict[str, bytes]) -> list:
    import zstandard

    made = []
    for lang in sorted(contents):
        data = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False))
    return made


def _classifier(model):
    def classify(batches):
        contents = model.value
        langs, tools = sorted(contents), _compressors(contents)
        for batch in batches:
            pred, score, narrow = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                if not text or not langs or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    narrow.append(True)
                    continue
                raw = text.lower().encode()
                parts = _pieces(raw, PIECE)
                sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in tools], float)
                if (sizes == sizes.min()).sum() > 1:  # a tie in whole bytes: each word by itself tells more
                    sizes += np.array([sum(len(c.compress(p)) for p in raw.split()) for c in tools]) * 1e-3
                best = int(sizes.argmin())
                gaps = sizes - sizes[best]
                pred.append(langs[best])
                score.append(float(1 / np.exp(-np.minimum(gaps, 50)).sum()))
                narrow.append(bool(len(gaps) > 1 and np.partition(gaps, 1)[1] < 0.01 * sizes[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return classify


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held: int = 2, per_lang: int = 400) -> DataFrame:
    """Per input row: id_col, held_out, lang_pred, score, rejected.

    Learns from rows with a language whose crc32(id) mod ``mod`` is not ``held``: about ``per_lang`` texts of each
    language, while they come to 880,000 bytes at most, fill dictionaries of 110,000 bytes. Prediction uses
    the text alone. ``rejected`` is true where the runner-up is less than 1 % larger, and for ``und``.

    A text that is null or without a letter is ``und`` with score 0, as is all if nothing could be learned. A null id is
    held out. Repeated rows get equal values; an empty table gives an empty result; other columns are ignored.
    """
    from .sampling import sample

    out = F.coalesce(crc_mod(id_col, mod) == held, F.lit(True))
    ids = sample(docs, id_col, lang_col, per_lang, out)
    model = docs.sparkSession.sparkContext.broadcast(dictionaries(texts(docs, ids, id_col, text_col, per_lang, 8 * DICTIONARY)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(_classifier(model), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
    return got.select(id_col, out.alias("held_out"), "lang_pred", "score", "rejected")
