"""The corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents, with n_chars following the text; the last returns the packed pieces. Rows with a null text pass
through to the packing, where they count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, stored
from tessera.llm.jaccard import drop_near_duplicates
from tessera.llm.packing import packed_documents
from tessera.llm.queries import vocabulary
from tessera.llm.secrets import redacted, scan
from tessera.llm.substring import PASSAGES, dedup_substrings
from tessera.llm.toxicity import drop_toxic, grades_of, train


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars as the text now is."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on labels, does not reject."""
    return drop_toxic(docs, train(docs, grades_of(read_table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated passages; one that loses all its text stays, with an empty one."""
    # a column of the input by the name _removed stays as it is
    found = dedup_substrings(docs.withColumnRenamed("_removed", "__kept_removed"), **PASSAGES)
    return _counted(found.drop("_removed").withColumnRenamed("__kept_removed", "_removed"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    found = scan(docs)
    return _counted(found.withColumn("text", redacted(F.col("text"), "_spans")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packed_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: MinHash candidates, the fitted model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
