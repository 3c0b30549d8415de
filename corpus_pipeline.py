"""The corpus pipeline: whole documents through quality rules, quality classifier, near-duplicate removal, substring removal and packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm._frames import written
from docloom.llm.near_duplicates import keep_one
from docloom.llm.ordinal_classifier import fit_on, graded, keep_graded
from docloom.llm.packing import pack_documents
from docloom.llm.quality_rules import quality_filter
from docloom.llm.queries import table, tokenizer_file
from docloom.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely of the best grade than not."""
    labels = table(spark, sf_dir, "labels")
    return keep_graded(docs, fit_on(docs, labels, graded(labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return keep_one(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document of smaller key has."""
    return remove_repeats(docs, window=50, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]
#: The classifier and the packing plan are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
