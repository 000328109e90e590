"""Corpus pipeline: quality filter, exact dedup, near dedup, source mixture, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns
of docs, whatever other columns there are and however they are named; the last one returns the packed pieces. docs is a table as read
from files: three stages name its rows by file and place in it, so repeated rows and null ids are decided one by one
and a second read finds the same row. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm import exact_dedup, mixing, packing, quality, shingle_join
from jobmarket.llm.common import crc_mod, file_rows, free_name, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on labelled documents of the unfiltered table."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    score = quality.fit(docs, labels)
    return docs.where(score("text") >= quality.ACCEPT)


def _kept(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs that decide(rows, row=...) marks as kept."""
    name = free_name(docs, "_row")
    rows = file_rows(docs, name)
    kept = decide(rows, row=name).where("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _kept(docs, exact_dedup.exact_dedup)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return _kept(docs, shingle_join.near_duplicates)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a document appears as often as the mixture takes it, in order of position."""
    name = free_name(docs, "_row")
    rows = file_rows(docs, name)
    plan = mixing.curriculum(rows.select(F.col(name).alias("row"), "doc_id", "source", mixing.word_count().alias("size")))
    return mixing.mixed_documents(rows, name, plan)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("n-gram Jaccard join", near_deduplication),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are part of it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
