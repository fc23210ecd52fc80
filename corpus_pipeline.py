"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
the documents; what a stage rejects or repeats, the later stages see.

In every stage a null text counts as empty, texts of any length are read whole, and an
empty table gives an empty one.  Columns besides doc_id, text and source may have any name
and type; they pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revloom.llm.common import fresh_folder, read_table
from revloom.llm.exact_dedup import keep_one
from revloom.llm.mixing import mixed_documents
from revloom.llm.near_dedup import near_keep_one
from revloom.llm.packing import packed_documents
from revloom.llm.quality import quality_filtered


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules find good.

    Null, empty and short texts are rejected by the base conditions; repeated rows are judged
    alike, and so stay or go together.
    """
    return quality_filtered(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the smallest id; a null id counts as the largest.

    Null texts, empty ones and those of white space only are one or two texts; of rows that
    repeat id and text one stays.
    """
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest id.

    Texts without a word are one class; those under five words are alike only if their words
    are equal.  Rows that repeat the first one's id and text stay with it.
    """
    return near_keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times.

    A null source is a source of its own; a text without words is taken as often as its
    source has complete epochs; rows that repeat id and text are taken alike.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in which sequence.

    A text without tokens is its end token alone; repeated rows are packed as often as they
    come.
    """
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Label models, signatures and tokenizers have no SQL form; a test compares each stage's
#: rows with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
