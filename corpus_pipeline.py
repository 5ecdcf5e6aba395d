"""A training-data pipeline over documents, as stages that read what the one before has written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages go by rows, so rows of one doc_id (or none) are documents of their own. Null texts are texts without words. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import fmindex, minhash, packing, quality, winnow
from quillstone.llm.common import shared_dir, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's thresholds reject go: null, empty and short texts among them.

    Repeated rows count each in their group's quartiles and are judged alike; null lang and source are groups.
    """
    return quality.judged(docs, f"{shared_dir(spark)}/counts", *COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id: five-word shingles, similarity 0.8 or more.

    Where doc_ids are null or occur again, rows are numbered in the order of doc_id (nulls last), lang, source and text, and the
    least number of a group stays; so one of equal rows stays. Texts without words are no duplicates of each other and stay.
    """
    if minhash.has_repeats(docs) or docs.where("doc_id is null").limit(1).count():
        order = [F.col("doc_id").asc_nulls_last(), "lang", "source", "text"]
        rows = staged(docs.select(*COLUMNS).orderBy(*order).withColumn("row_", F.monotonically_increasing_id()), f"{shared_dir(spark)}/rows")
        kept = minhash.near_duplicates(rows.select(F.col("row_").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("row_"))
        return rows.join(kept, "row_", "left_semi").select(*COLUMNS)
    return docs.join(minhash.near_duplicates(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go (n_chars is counted anew); texts without such words stay as they are, null ones too.

    Rows with a null doc_id stay as they are. Rows of one doc_id are the same place, of which none is earlier; where their texts differ, each
    loses words at places found in another's only where it has them.
    """
    rows = fmindex.without_repeats(docs, with_text=True, keep=("lang", "source", "n_chars"))
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go, however long they are.

    A document of which a passage is cut already holds no window and stays. Null texts and null doc_ids are judged as others.
    """
    return winnow.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where("n_hit = 0").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 4096 tokens; every row is packed, a null text as the end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", packed),
]
#: The packing has no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
