"""The queries opN_<name> of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .sql import SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The path of a vocabulary file; they are no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without later occurrences of repeated sentences, in runs of 30 words or more: n_removed spans, the spans, the text."""
    from .substring import PASSAGES, dedup_substrings

    out = dedup_substrings(read_table(spark, sf_dir, "documents"), **PASSAGES)
    spans = F.array_join(F.transform("_removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), spans.alias("removed"), "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link_embeddings

    return link_embeddings(read_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(read_table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *names, "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import listed, scan

    out = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytepair import encode_digests

    return encode_digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "kept")


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import grades_of, severity, train

    docs = read_table(spark, sf_dir, "documents")
    out = severity(docs, train(docs, grades_of(read_table(spark, sf_dir, "labels"))))
    return out.withColumn("kept", ~F.col("toxic"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_best_fit_packing, op3_embedding_near_dedup, op4_token_counts, op5_quality_rules, op6_secret_scans, op7_byte_bpe, op8_jaccard_join, op9_token_id_files, op10_toxicity)
}
