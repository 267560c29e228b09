"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages are written as Parquet between steps where the caller does so; run() chains them through the shared folder.

Defined results of every stage. Null or empty text: fails the quality rules, so it goes in the first stage; a stage
called on its own takes it for a text without words, which is no near copy but of another such text, has no passages and
packs as its end token. Null id: the row stays, is neither near copy nor reference, and is packed like others. Very long
texts count whole. Ties: of near copies and of repeated passages the smallest id stays. Repeated rows: rows of one id
stay or go together and are packed each by itself. Empty table: no rows. Extra columns, whatever their names, are kept
but in the last stage. doc_id is an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm import packing, quality, simhash, substring
from stemmata.llm.components import saved

PASSAGE = 50  # words of a passage that is cut where it repeats


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts."""
    return quality.keep_good(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has too; n_chars follows the text."""
    out = substring.remove_repeats(docs, window=PASSAGE)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, in byte-level BPE tokens, and the bins they are packed in."""
    return packing.pack_texts(docs)


STAGES = [("quality", good_quality), ("simhash", no_near_copies), ("substring", no_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs


ORACLE_SQL = None  # SimHash linking and best-fit packing are tested against brute force
