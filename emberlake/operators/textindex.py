"""Ranked search over weighted text fields, through an inverted index that is stored once.

A posting holds what its document gets for its term, BM25 over the fields' weighted counts, so a query adds up postings.
Postings lie in buckets of terms, in order of term and level within them; a level is a quarter of a power of two below the
term's best score, so levels need no ranking, and a common term's postings are dealt out like any others. A query reads the
buckets of its terms only, first the best levels, and of the others those from which a document could still come among the best.
"""

from __future__ import annotations

import contextlib
import dataclasses
import itertools
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.functions import text
from emberlake.operators.graph import shared_folder

#: What a field's words weigh. Fixed values.
FIELDS = {"summary": 2.0, "keywords": 1.5}
BUCKETS = 64
K1, B = 1.2, 0.75
#: Scores are compared to so many places.
PLACES = 5
#: Postings of a slice of a bucket, and of a task that deals them out, about; so many parts of the buckets are dealt out one after the other.
SLICE, TASK = 250_000, 500_000
ROUNDS = 3
#: Characters of text whose words one task counts, about.
TEXT = 8 << 20
#: Spark's setting that deletes a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclasses.dataclass(frozen=True)
class TextIndex:
    """A stored index: postings (bucket, term, level, id, session, score) and levels (bucket, term, level, n, best)."""

    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/scored")

    def levels(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/levels")


def bucket(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job has shuffled is deleted at its end, so that jobs one after the other don't add up on disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def counted_words(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, session, dl, term, tf): the weighted words of ``docs``, and for each document a row of the term "" that tells how many rows it has.

    Texts are dealt out by id, which is less than their words are, so that the rows of an id are counted where they lie.
    """
    words = {f: text.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    chars = docs.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long"))).first()[0] or 0  # one row
    sized = docs.select("id", "session", *fields).repartition(max(1, -(-chars // TEXT)), "id").select("id", "session", *[w.alias(f) for f, w in words.items()])
    ends = list(itertools.accumulate(F.size(f) for f in fields))
    weight = F.lit(1.0)
    for k, w in reversed(list(enumerate(fields.values()))):
        weight = F.when(F.col("pos") < F.col(f"end{k}"), w).otherwise(weight)
    each = sized.select("id", "session", ends[-1].alias("dl"), *[e.alias(f"end{k}") for k, e in enumerate(ends)], F.posexplode(F.concat(*fields, F.array(F.lit("")))).alias("pos", "term"))
    return each.groupBy("id", "session", "dl", "term").agg(F.sum(weight).alias("tf"))


def build(docs: DataFrame, fields: dict[str, float] = FIELDS, path: str | None = None, buckets: int = BUCKETS) -> TextIndex:
    """Stores the index of ``docs`` (id, session, and a column for each field); a null field is empty, a document without words has no postings.

    Postings are shuffled once, some buckets at a time. A bucket is dealt out in slices: by term, and for terms of many documents by id. A term's figures
    come from its own slice, those of terms in several slices from a table that has a bounded number of rows for each slice.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        counted_words(docs, fields).write.option("compression", "zstd").parquet(f"{path}/counts")
        counted = spark.read.parquet(f"{path}/counts")
        n, words = counted.where("term = ''").agg(F.sum("tf"), F.sum(F.col("tf") * F.col("dl"))).first()  # one row
        counted = counted.where("term != ''")
        total, avgdl = counted.count(), words / n if n else None
        slices = max(1, -(-total // (buckets * SLICE)))
        damped = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl).cast("double"))
        value = F.col("tf") * (K1 + 1) / damped
        most = total // (buckets * slices * 8) + 1
        often = counted.groupBy("term").agg(F.count("*").alias("many"), F.max(value).alias("top")).where(F.col("many") > most)
        often.select("*", F.ceil(F.col("many") / most).alias("shares")).write.parquet(f"{path}/often")
        often = F.broadcast(spark.read.parquet(f"{path}/often"))  # at most eight terms for each slice
        part = F.when(F.col("shares").isNull(), F.pmod(F.hash("term"), F.lit(slices))).otherwise(slices + F.pmod(F.xxhash64("id"), "shares")).cast("int")
        placed = counted.withColumn("bucket", bucket("term", buckets)).join(often.select("term", "shares"), "term", "left").withColumn("slice", part).drop("shares")
        rounds = max(1, min(ROUNDS, total // TASK))
        tasks = max(1, -(-total // (rounds * TASK)))
        own = Window.partitionBy("bucket", "slice", "term").orderBy(F.col("value").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for turn in range(rounds):
            dealt = placed.where(F.col("bucket") % rounds == turn).repartition(tasks, "bucket", "slice")
            told = dealt.withColumn("value", value).select("*", F.count("*").over(own).alias("here"), F.max("value").over(own).alias("best_here")).join(often, "term", "left")
            df, top = F.coalesce("many", "here"), F.coalesce("top", "best_here")
            idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
            scored = told.select("bucket", "term", "id", "session", (idf * F.col("tf") * (K1 + 1) / damped).alias("score"), (idf * top).alias("best"))
            level = F.greatest(F.lit(0), F.floor(F.log2(F.col("best") / F.col("score")) * 4).cast("int"))  # the best itself may be off by a rounding
            ranked = scored.select("term", level.alias("level"), "id", "session", "score", "bucket")  # in order of bucket, slice, term and level, by the window
            ranked.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/scored")
        told = spark.read.parquet(f"{path}/scored").groupBy("bucket", "term", "level").agg(F.count("*").alias("n"), F.max("score").alias("best"))
        told.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "level").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/levels")
    return TextIndex(path)


def terms_of(query: str) -> list[str]:
    """The distinct search terms of a query."""
    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def search(spark: SparkSession, index: TextIndex, query: str, k: int = 50, session: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, score) of the ``k`` best documents for a query, of one session if given; ids decide between equal scores. No terms, no rows.

    Levels tell which postings matter: a document outside the levels read for term t has at most that level's best score there, and the terms' best elsewhere.
    """
    terms = terms_of(query)
    own = index.postings(spark)
    if not terms:
        return own.select("id", "score").limit(0)
    at = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket("term", buckets)).distinct().collect()]  # at most one for each term
    asked = own.where(F.col("bucket").isin(at) & F.col("term").isin(terms))
    if session is not None:
        found = asked.where(F.col("session") == session)
    else:
        levels: dict[str, list] = {}
        for r in index.levels(spark).where(F.col("bucket").isin(at) & F.col("term").isin(terms)).orderBy("term", "level").collect():  # some hundred rows a term at most
            levels.setdefault(r.term, []).append(r)
        found = asked.join(wanted_ids(asked, levels, k), "id", "left_semi") if levels else asked
    top = found.groupBy("id").agg(F.round(F.sum("score"), PLACES).alias("score"))
    return top.orderBy(F.col("score").desc(), "id").limit(k)


def upto(depth: dict[str, int]):
    """A condition: levels up to a depth for each term."""
    out = F.lit(False)
    for term, level in depth.items():
        out = out | ((F.col("term") == term) & (F.col("level") <= level))
    return out


def wanted_ids(asked: DataFrame, levels: dict[str, list], k: int) -> DataFrame:
    """The ids that can be among the ``k`` best."""
    first = {}
    for term, rows in levels.items():  # the best levels that hold k documents
        held = 0
        for r in rows:
            held, first[term] = held + r.n, r.level
            if held >= k:
                break
    seen = asked.where(upto(first)).groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.col("score").desc()).limit(k)
    bar = seen.agg(F.when(F.count("*") >= k, F.min("score"))).first()[0]  # one row
    total = sum(rows[0].best for rows in levels.values())
    if bar is None:
        return asked.select("id").distinct()
    needed = {}
    for term, rows in levels.items():
        others = total - rows[0].best
        for r in rows:
            if r.best + others >= bar - 10**-PLACES:
                needed[term] = r.level
    return asked.where(upto(needed)).select("id").distinct()
