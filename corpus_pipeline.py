"""A corpus from raw documents to piece ids, in five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return the documents that stay, with the columns of ``documents``; the last one
returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewell.llm import mixing, ngram_join, pieces, quality, secret_scan
from basewell.llm.common import materialize, table
from basewell.llm.queries import GOOD_FROM

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among them, scores below GOOD_FROM.

    Nulls and empty texts are scored as empty ones; repeated rows are judged alike. Without labels nothing goes.
    Of the labels, those without an id or a value don't count, and several of one id count by their majority, a tie as 1.
    As in every stage, columns that documents don't have are dropped, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, out_col="quality_score").where(F.col("quality_score") >= GOOD_FROM).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, of the smallest id. Documents without words are a group each."""
    return ngram_join.first_of_each(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; all rows stay, a null text stays null and an empty one empty."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix, in training order: a document once for each copy that the mix takes words of.

    The copy at which a source reaches its target is cut after the last word taken, so the mix holds the words planned
    and no more. Documents without words (null or empty texts) don't enter; rows that share an id, or have none, are
    documents of their own.
    """
    ordered = mixing.training_order(mixing.mix(docs.select(*COLUMNS), keep=True).where("taken > 0"))
    took = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    cut = took < F.col("size")
    text = F.when(cut, mixing.first_words(F.col("whole.text"), took)).otherwise(F.col("whole.text"))
    rows = ordered.withColumn("cut_text", text)
    made = {"text": F.col("cut_text"), "n_chars": F.when(cut, F.length("cut_text")).otherwise(F.col("whole.n_chars"))}
    return rows.select(*[made.get(c, F.col(f"whole.{c}")).alias(c) for c in COLUMNS])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, row by row; a null or empty text has none."""
    return pieces.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pieces", encoded),
]

#: The trained classifier and the pieces' Viterbi paths have no SQL; tests/llm/test_pipeline_stages.py and test_llm_queries.py hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
