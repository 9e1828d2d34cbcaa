"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next one.

Every stage takes any rows with the columns of documents: null, empty and very long texts, repeated rows and ids, null
ids and an empty table are defined in its docstring; further columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyte.llm import exact_dedup, jaccard, packing, pii, quality
from panelyte.llm.shared import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.5 or more). A null or empty text has the score of the bias
    alone; repeated rows stay or go together; without labels all stay. Empty table: no rows."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), carry=[c for c in COLUMNS if c != "doc_id"])
    return scored.filter("predicted = 1").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts: the smallest id, a null id last, of equal ids the first by
    place. Null and empty texts are one group. Empty table: no rows."""
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words at a similarity of 0.8. The smallest id stays, a
    null id last; texts without words all stay; rows that repeat id and text stay or go together. Empty table: no rows."""
    return jaccard.drop_near_copies(docs, num=80, words=5).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text with personal data and revealing terms replaced; n_chars follows. A null text becomes an
    empty one; repeated rows are cleaned alike. Empty table: no rows."""
    clean = pii.find_personal_data(docs, carry=[c for c in COLUMNS if c not in ("doc_id", "text")])
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null or empty text is its end token alone; repeated rows are packed each. Empty
    table: no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The classifier's weights can't be expressed in SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
