"""The queries of this subpackage, each over its whole table, by the names the driver's entry file registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rank_quality

    return rank_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import tag_toxic

    out = tag_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("offsets"))


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_spans

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", secret_spans(F.col("text"), tokenizer_path("byte_bpe_50k.tiktoken")).alias("s"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("s", lambda s: s["kind"] != "random")
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), _sha256(listed(base)).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), window=20)
    return out.select("row.doc_id", "n_words", "n_removed", _sha256(F.col("kept_text")).alias("kept_sha256"))


def op9_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import robust_outliers

    return robust_outliers(_table(spark, sf_dir, "documents"))


#: (verdict, host, path) of the rules of the query; fixed values.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op11_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import Rule, judge

    out = judge(_table(spark, sf_dir, "pages").select("page_id", "url"), [Rule(*r) for r in URL_RULES])
    return out.select("row.page_id", "host", "path", "rule", "verdict")


def op12_codebook_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import cut
    from .vector_codes import encode, learn

    vectors = _table(spark, sf_dir, "embeddings")
    books = learn(vectors)
    coded = cut(encode(vectors, books).select("row.vec_id", "row.label", "code", "error"), "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("own")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restore

    out = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_bpe_chunks,
        op3_bradley_terry_quality,
        op4_near_duplicates,
        op5_toxic_spans,
        op6_secret_spans,
        op7_compression_language,
        op8_substring_dedup,
        op9_voronoi_top_k,
        op10_quality_outliers,
        op11_url_models,
        op12_codebook_compression,
        op13_fill_in_middle,
    )
}
