"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``, and pass
on further columns of any name.  No stage needs ids to be unique or there: rows are told apart
by id and text.  An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, line_dedup, mixing, near_dup, quality
from leafmill.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts, repetitive ones, and those far from their language's histograms.

    Very long texts are judged whole; rows equal in id and text stay or go together; a null language is one of its own.
    """
    return quality.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the one of the largest doc_id; ``n_chars`` follows the text.

    A null text stays null; rows without an id lose such lines, but don't count as documents; repeated rows are treated alike.
    """
    return line_dedup.drop_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id (null last; ties: of the smallest content key).

    Texts without words are no one's duplicates, but rows equal in id and text stay once.  Very long texts are compared whole.
    """
    return near_dup.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document taken twice is there twice.

    A null source is a source; texts without words are never taken; rows equal in id and text are taken alike.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and a digest of the text that they decode to; a null or empty text has none."""
    coded = bpe.encode_and_decode(docs)
    return coded.select("doc_id", "n_tokens", F.col("ids").alias("token_ids"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("near-duplicates", near_duplicates),
    ("source mixing", source_mix),
    ("byte-level BPE", tokens),
]

#: Sampling by consistent weights and byte-pair merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, box.put(stage(spark, docs, sf_dir))
        box.drop(before)
    return docs
