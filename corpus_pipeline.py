"""The training-data pipeline: each stage takes what its predecessor kept, through one operator of ``cohortium.llm``.

Every stage takes nulls in any column, repeated rows, empty tables and further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortium.llm import exact_dedup, packing, secrets, simhash, toxicity
from cohortium.llm.catalog import TOXIC, table, vocabulary
from cohortium.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, whole and unchanged.

    A null text counts as empty and gets the bias alone; rows of equal text share a fate; without positive labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id, whole and unchanged.

    Null and empty texts are equal, a null id is smaller than any other, and of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, whole and unchanged.

    Texts without words, null ones too, are near duplicates of each other.
    """
    return simhash.drop_near_duplicates(docs, shingle=4, limit=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text. Null and empty texts stay as they are."""
    masked = secrets.without_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. A null or empty text is one piece of its end."""
    made = packing.pieces(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), keep_ids=False)
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_equal), ("simhash_near_dedup", drop_near),
          ("secret_scan", mask_secrets), ("best_fit_packing", pack)]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
