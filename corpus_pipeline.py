"""The corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``. ``run`` writes what a stage returns as Parquet to the shared folder and rereads it for the next one,
so no stage repeats the work of those before it, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, secret_scan, substrings, toxicity
from tidemark.llm.entries import tokenizer_path
from tidemark.llm.shared import cut

#: Documents of this toxicity score or more go.
TOXIC = 0.3

#: SQL cannot express a trained model's verdict; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC``; the model is learned from the labelled ones among docs.

    Null, empty and blank texts show nothing toxic and stay; rows with a null id teach nothing and are judged like others;
    repeated rows get one verdict. Without labels of both kinds nothing goes; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.fit(docs, labels)(F.col("text"))["score"]
    return docs.select(F.struct("*").alias("row"), score.alias("score")).where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group at a similarity of 0.8 over shingles of five words.

    Rows without words, and rows with a null id, are linked with nothing and stay. Rows repeated with one id stay or go
    together. Of equal texts the smallest id stays; an empty table stays empty.
    """
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows that occur earlier; a text that is left with no word goes.

    Null, empty and blank texts lose nothing and stay, as do rows with a null id. Rows repeated with one id stand at equal
    places and lose the same words. Texts without a repeat stay as they are, in their own white space; an empty table
    stays empty.
    """
    out = substrings.remove_repeats(docs, window=20).where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    return _with_text(out.select("row", text.alias("text")), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret and random string replaced by a mask; no document goes.

    A null text stays null, an empty one empty. The result depends on the text alone, so ids, ties and repeated rows do
    not matter; an empty table stays empty.
    """
    masked = secret_scan.redact(F.col("text"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return _with_text(docs.select(F.struct("*").alias("row"), masked.alias("text")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 2048 tokens.

    A null text counts as empty and gives one piece, its end. Null and repeated ids are kept as they are, each row as a
    document of its own; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of struct ``row`` with ``text`` as text and n_chars of it."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return docs.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
