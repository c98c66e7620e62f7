"""The corpus pipeline: classify, deduplicate, redact secrets, mix sources, encode.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but
the last return the columns of documents. Results are written as Parquet and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import minhash, mixing, pieces, quality_classifier, secrets
from brindle.llm.common import materialize, table


#: Near copies: five-word shingle sets that are similar to so many per cent.
SIMILAR = 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 7)."""
    return quality_classifier.learned(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 9)."""
    return minhash.deduplicate(docs, percent=SIMILAR)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and n_chars counted anew (operator 2)."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many whole copies as the mix of sources takes (operator 6)."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document (operator 5)."""
    return pieces.encode(docs)


STAGES = [("classify", classify), ("deduplicate", deduplicate), ("redact", redact), ("mix", mix), ("encode", encode)]

#: The classifier is trained, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
