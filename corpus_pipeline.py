"""From raw documents to packed training sequences, in five stages; each takes what the one before kept."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.llm import line_dedup, mixing, packing, quality_model, simhash  # noqa: E402
from palimpsest.llm.common import materialise, table  # noqa: E402
from palimpsest.scratch import ship  # noqa: E402


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the text now has them."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model accepts, at a score of 0.3; rejected ones, and null texts and those without words, go.

    Rows without an id and repeated rows are judged like any other, ties at 0.3 stay, extra columns pass through, and an
    empty table gives an empty one.
    """
    ship(spark)
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines with 50 words or more that an earlier document or line has.

    Null texts stay null; rows without an id come last in the order; rows with equal id and text count as one document and
    stay alike; a text may be left empty. Very long texts are taken whole; extra columns pass through, but for n_chars.
    """
    return _counted(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group whose SimHash fingerprints link at 4 bits or fewer.

    That is far closer than a similarity of 0.8 on five-word shingles; README says what it misses. Null and empty texts are
    one group. Rows that share an id are told apart by their texts; repeated rows are one group, of which one stays; rows
    without an id stay only where no row of the group has one. Extra columns pass through.
    """
    ship(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the shards draw them, shard by shard, so that sources come to their targets in words.

    Null and empty texts take nothing and go; rows without a source are one source; repeated rows, and rows without an id,
    are drawn each for itself. Extra columns pass through, but for n_chars.
    """
    ship(spark)
    return _counted(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the sequence of 4096 tokens and the offset where each goes.

    Null and empty texts are their end token; repeated rows and rows without an id are packed each for itself; an empty
    table gives no piece. Only doc_id and text are read.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: A learned model, winnowing over hashes, components and a tokenizer aren't SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
