"""Fill-in-the-middle transformation of whole texts.

A text is cut in units (white space and the word after it; white space at the end is one by itself) by the Split
pre-tokenizer of the tokenizers library, whose isolated matches come with code-point offsets; nothing is trained. The
number of offsets is n. Two draws from a digest of the id rank two of the n + 1 places between units; what lies before,
between and behind them is prefix, middle and suffix. Python sees the text and returns three numbers; the pieces are
cut and put together by expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that the pre-tokenizer sees at once. A text is cut before white space, where a unit always ends, so the
#: units are those of the whole text, and the list of one call stays small however long the text is.
STRETCH = 1 << 18
_SEAM = re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")


def unit_ends(text: str, split) -> np.ndarray:
    """Code-point offsets at which the units of a text end."""
    out, a = [np.zeros(0, np.int64)], 0
    while a < len(text):
        seam = _SEAM.search(text, a + STRETCH) if len(text) - a > STRETCH else None
        z = seam.start() if seam else len(text)
        found = split.pre_tokenize_str(text[a:z] if a or z < len(text) else text)
        out.append(np.fromiter((end for _, (_, end) in found), np.int64, len(found)) + a)
        a = z
    return np.concatenate(out)


def _places(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """n, and the code-point offsets at which prefix and middle end."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split, out = Split(Regex(UNIT), behavior="isolated"), np.zeros((3, len(text)), np.int64)
    for k, (t, a, b) in enumerate(zip(text, first, second, strict=True)):
        ends = unit_ends(t.as_py() or "", split)
        n = len(ends)
        low, high = sorted(((a.as_py() or 0) % (n + 1), (b.as_py() or 0) % (n + 1)))
        out[:, k] = n, ends[low - 1] if low else 0, ends[high - 1] if high else 0
    return pa.StructArray.from_arrays([pa.array(c) for c in out], ["n", "a", "b"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The input rows as struct ``row``, with n (units), form, prefix_chars, middle_chars (code points) and output.

    The draws are the first four groups of eight hex digits of sha256("seed:id"). ``rate`` per cent of the texts are
    transformed, ``spm`` per cent of those with the suffix first (form spm), the others with the prefix first (psm).

    Form is plain, the output the text itself and both counts null, for an empty or null text (null counts as empty), a
    text that holds one of the marks, and a row with a null id. A text of white space is one unit. The result depends on
    id and text alone, so repeated rows get equal values; an empty table gives an empty result; other columns stay in
    ``row``, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("h"))
    draw = lambda k: F.conv(F.substr("h", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint")
    # called nondeterministic only so that Spark does not run it once per use of its result
    places = F.arrow_udf(_places, "n bigint, a bigint, b bigint").asNondeterministic()
    rows = rows.select("row", "text", draw(2).alias("h3"), draw(3).alias("h4"), places("text", draw(0), draw(1)).alias("x"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | F.coalesce(F.col("h3") % 100 >= rate, F.lit(True))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "text", "x.*", form.alias("form"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    cut = F.col("form") != "plain"
    return rows.select("row", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that a form's output was made of. A transformed text holds no mark, so the first one of each kind is the one put there."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    at = lambda parts, k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(psm, 0), at(psm, 2), at(psm, 1))).when(form == "spm", F.concat(at(spm, 1), at(spm, 2), at(spm, 0))).otherwise(output)
