"""The corpus pipeline: from ``documents`` to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. Rows are told apart by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import decontam, linededup, packing, shingles, simhash, toxicity
from emberlake.llm.common import stored, table

#: The share of a source's documents from which a line is boilerplate, chosen by the gap that README gives.
LINE_RATIO = 0.005
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on them and ``labels``, rejects go."""
    docs = docs.select(*COLUMNS)
    return toxicity.not_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate within their source go; a text of nothing else is a copy and stays for the next stage."""
    cleaned = linededup.drop_boilerplate(docs.select(*COLUMNS, F.col("source").alias("host")), LINE_RATIO, keep_emptied=True)
    return cleaned.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class (SimHash variants, then the exact search; five-word shingles, similarity 0.8 or more) the document of smallest id stays."""
    docs = docs.select(*COLUMNS)
    return simhash.one_of_each(docs, found=stored(shingles.near_duplicates(docs), "near-duplicates"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go."""
    return decontam.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages hold a trained classifier, fingerprints and token ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
