"""What the training-data operators share: table access, shared storage, small column helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the result contracts.
SPACE = r"\x20\x09-\x0D"
#: Most bytes of a batch that a job of :func:`stored` sends to Python; a row of more is one batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. A local session has one
    machine, so there a temporary folder is made and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='emberlake-')}"
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, batches that jobs send to Python hold at most BATCH_BYTES, so that ten thousand long texts aren't one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage and keeps each task's later work off the expensive input;
    the files survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/").split(":")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root not in folder:
            raise ValueError(f"{folder} isn't in the shared folder")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(mod: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text, which tells rows of one id apart. Rows equal in both are one document."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_rows(docs: DataFrame, rows: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows named in ``rows`` (doc_id, row_key; distinct).

    Up to ``bound`` rows (16 MB) are broadcast, so no text is shuffled; more meet the documents in a shuffled join.
    """
    gone = stored(rows.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")), "rows")
    same = (row_key(docs) == gone["gone_key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"])
    return docs.join(F.broadcast(gone) if gone.count() <= bound else gone, same, "left_anti")
