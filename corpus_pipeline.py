"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchlake.llm.common import materialize, table
from watchlake.llm.decontaminate import decontaminate
from watchlake.llm.mixing import mixed_documents
from watchlake.llm.quality import keep_quality
from watchlake.llm.simhash import drop_near_duplicates
from watchlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts score as texts without words and stay like others; rows of null or repeated ids are judged by
    their own texts. An empty table stays empty, and further columns may have any names.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; nulls, repeats, empty tables and names as in ``toxicity``."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least id, then the least text hash.

    Null and empty texts are copies of each other. Rows without an id are held against each other alone. Rows that
    repeat id and text are one document. An empty table stays empty, and further columns may have any names.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain nothing, and null or empty items are contained nowhere. Rows are judged by their own
    texts, whatever their ids. Empty tables on either side change nothing, and further columns may have any names.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken.

    Null and empty texts take no words, a null source is a source, and every row is decided by itself. An empty table
    stays empty. Own columns that are called like new ones stay, and the new ones get an underscore.
    """
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the fitted classifiers nor the rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table's documents, each written to the shared folder and read again.

    What rows with nulls, ties and repeats become is said at the stages; without documents there are no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
