"""The document pipeline: quality, language, near duplicates, leaks, packing.

Each stage works on all rows its predecessor kept; all but the last return the
columns of documents. Results are written to the shared folder and read again.
SQL has no tokenizer and no alignment, so there is no SQL for the whole; each
stage is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontam, jaccard, langid, packing, quality
from scriptorium.llm.common import table, written
from scriptorium.llm.queries import tokenizer_path


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the quality rules."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language cannot be told."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each near-duplicate class."""
    return jaccard.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that hold a passage of a benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_texts),
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
