"""Stages that turn raw documents into packed training sequences. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, near_duplicates, packing, pii, quality
from factloom.llm._runtime import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of what the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; columns beyond those of documents too.

    Null and empty texts score the labels' mean (0.5 without labels) and stay or go by it; rows that repeat are judged each; an empty table stays empty.
    """
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null texts and those without words are like nothing and stay; of rows that share an id one stays, and all without an id; an empty table stays empty.
    """
    return near_duplicates.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others.

    Null and empty texts have no words and stay as they are, as does all where the benchmark is empty; rows that repeat are judged each; n_chars is counted anew (null where the text is).
    """
    return _recounted(decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    Null texts stay null and empty ones empty; rows that repeat are treated each; texts may be of any length; n_chars is counted anew.
    """
    return _recounted(pii.redact_pii(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 4,096; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096)


STAGES = [("quality", good_quality), ("near_duplicates", unique), ("decontamination", uncontaminated), ("pii", without_pii), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written and read back. Other columns of documents are not carried along."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs


#: Byte-pair encoding and learnt classifiers are not SQL. The operators of the stages are tested against brute force, the stages on odd tables.
ORACLE_SQL = None
