"""Corpus pipeline: quality classifier, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospectra.llm import decontaminate, packing, quality_classifier, secrets, simhash
from prospectra.llm.common import clear, marked, ship_package, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship_package(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for each secret."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secret scans", redacted),
    ("packing", packed),
]

#: SimHash fingerprints, boosted trees and token ids cannot be expressed in DuckDB.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written and read again by the next. What a
    stage wrote in between is removed once its rows are written."""
    docs, since = table(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        clear(spark, since, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
