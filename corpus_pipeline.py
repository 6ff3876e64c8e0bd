"""Corpus pipeline: toxicity, near-dedup, PII, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever further columns there are. Stages judge rows, not
ids: rows without id, and rows of one id with different texts, are documents of their own.

Edge cases: null texts are scored for toxicity like empty ones, are one group of blank texts for near-dedup, hold no
personal data, and have no words for the mix, which drops documents without words. Equal rows are near copies, so one
stays. Very long texts are taken whole in every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import mixing, pii, sentencepiece_codec, simhash, toxicity
from tracelab.llm.common import settle, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC_FROM; each row is scored where it stands, without a join."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_under(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, which are linked by a Jaccard similarity of 0.8 or more over five-word
    shingles: that of the smallest doc_id, null last."""
    return simhash.survivors(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last lap rounded: between 0 and 3 times."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return sentencepiece_codec.encode(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]

#: Models, 64-bit hashes and Viterbi can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
