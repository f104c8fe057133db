"""The corpus pipeline: STAGES in order, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result to the shared folder and rereads it, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import Shelf
from corvane.llm.exact_dedup import drop_exact_duplicates
from corvane.llm.mixing import mixed_documents
from corvane.llm.packing import pack_documents
from corvane.llm.simhash import drop_near_duplicates
from corvane.llm.toxicity import drop_toxic, query_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among docs."""
    return drop_toxic(docs, query_model(spark, sf_dir, docs.select("doc_id", "text")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 or more of their five-word shingles one stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = set(Shelf.opened)
        docs = shelf.keep(stage(spark, docs, sf_dir), f"{i}-{name.replace(' ', '-')}")
        for own in set(Shelf.opened) - before:  # the stage's own tables: its result is written
            own.clear()
    return docs
