"""Labelled rows for classifiers: a bounded sample that no score may look beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import id_remainder

FOLDS, HELD_OUT = 3, 1


def held_out(name: str = "doc_id"):
    return id_remainder(FOLDS, name) == HELD_OUT


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) outside the held-out fold. Of several labels of a document the largest counts; null labels and ids don't."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def rows_of(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id, text and y of the documents in ``taken`` (doc_id, y; bounded, so broadcast), one row for each id.

    Of several rows of one id that with the least hash of its text counts, so the number of rows is bounded too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``limit`` labelled documents outside the held-out fold, by a hash of the id."""
    return rows_of(docs, known_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and y (-1) of at most ``limit`` documents without a label, outside the held-out fold, by a hash of the id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out())
    rest = ids.join(known_labels(labels, label), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return rows_of(docs, rest.distinct().withColumn("y", F.lit(-1)))
