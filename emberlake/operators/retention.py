"""Forgetting: tiers, pruning, trimming, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.model import Retention

HOUR_US = 3_600_000_000


def age_hours(now_us: int) -> Column:
    return (F.lit(now_us) - F.col("occurred_us")) / float(HOUR_US)


def tier(now_us: int, r: Retention = Retention()) -> Column:
    """hot, warm, cold or archive by age; each bin includes its lower end."""
    h = age_hours(now_us)
    return F.when(h < r.hot, "hot").when(h < r.warm, "warm").when(h < r.cold, "cold").otherwise("archive")


def prune_warm(similarity: Column, r: Retention = Retention()) -> Column:
    return F.coalesce(similarity, F.lit(1.0)) < r.warm_similarity


def prune_cold(importance: Column, access: Column, r: Retention = Retention()) -> Column:
    return (F.coalesce(importance, F.lit(0)) < r.cold_importance) & (F.coalesce(access, F.lit(0)) < r.cold_access)


def actions(nodes: DataFrame, now_us: int, r: Retention = Retention()) -> DataFrame:
    """``nodes`` with tier and action: drop_edges, delete, archive or keep."""
    t = F.col("tier")
    action = F.when((t == "warm") & prune_warm(F.col("similarity"), r), "drop_edges").when((t == "cold") & prune_cold(F.col("importance_hint"), F.col("access_count"), r), "delete").when(t == "archive", "archive").otherwise("keep")
    return nodes.withColumn("tier", tier(now_us, r)).withColumn("action", action)


def cold_survivors(nodes: DataFrame, now_us: int, r: Retention = Retention()) -> DataFrame:
    """What stays when everything past the warm tier that is neither important nor used goes; archive-age rows included."""
    return nodes.where(~((age_hours(now_us) >= r.warm) & prune_cold(F.col("importance_hint"), F.col("access_count"), r)))


def similar_edges_kept(edges: DataFrame, sources: DataFrame, now_us: int, hours: float, least: float) -> DataFrame:
    """SIMILAR_TO edges but those under ``least`` from events older than ``hours``."""
    joined = edges.join(sources.select(F.col("event_id").alias("src"), "occurred_us"), "src")
    return joined.where(~((F.col("similarity") < least) & (age_hours(now_us) > hours))).drop("occurred_us")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) without any edge."""
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(touched, "id", "left_anti")


def prunable(nodes: DataFrame, now_us: int, r: Retention = Retention()) -> DataFrame:
    """``nodes`` with their tier that its rule gives up: warm ones of low importance that nobody has read, cold ones of low importance and few reads, all of archive age."""
    t, low = F.col("tier"), F.coalesce("importance_hint", F.lit(0)) < r.cold_importance
    reads = F.coalesce("access_count", F.lit(0))
    rule = F.when(t == "warm", low & (reads == 0)).when(t == "cold", low & (reads < r.cold_access)).otherwise(t == "archive")
    return nodes.withColumn("tier", tier(now_us, r)).where(rule)


#: Labels whose nodes go when no edge is left; profiles and summaries stay.
ORPHAN_LABELS = ["Entity", "Preference", "Skill", "Workflow", "BehavioralPattern"]


def orphan_sweep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of nodes of the five sweepable labels without any edge."""
    return orphans(nodes.where(F.col("label").isin(ORPHAN_LABELS)), edges)


def forget(events: DataFrame, edges: DataFrame, now_us: int, r: Retention = Retention()) -> tuple[DataFrame, DataFrame]:
    """A forgetting run: events without cold ones of low importance and few reads and without those of archive age, and edges
    (src, dst, edge_type, similarity) without weak SIMILAR_TO edges of events past the hot tier and without loose ends."""
    kept = actions(events.withColumn("similarity", F.lit(None).cast("double")), now_us, r).where("action NOT IN ('delete', 'archive')").select(*events.columns)
    gone = events.join(kept.select("event_id"), "event_id", "left_anti").select("event_id")
    old = events.where(age_hours(now_us) > r.hot).select(F.col("event_id").alias("src"), F.lit(True).alias("old"))
    weak = (F.col("edge_type") == "SIMILAR_TO") & (F.col("similarity") < r.warm_similarity) & F.col("old")
    left = edges.join(old, "src", "left").where(~F.coalesce(weak, F.lit(False))).select(*edges.columns)
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("event_id", end), end, "left_anti")
    return kept, left.select(*edges.columns)


def trim_point(progress: DataFrame, cutoff_ms: int) -> DataFrame:
    """One row (ms, seq): the earlier of the age cutoff and the slowest group's stream id; ``progress``: group, stream_id."""
    parts = progress.select(F.split_part("stream_id", F.lit("-"), F.lit(1)).cast("long").alias("ms"), F.split_part("stream_id", F.lit("-"), F.lit(2)).cast("long").alias("seq"))
    slowest = parts.agg(F.min(F.struct("ms", "seq")).alias("p"))
    return slowest.select(F.least("p", F.struct(F.lit(cutoff_ms).cast("long").alias("ms"), F.lit(0).cast("long").alias("seq"))).alias("p")).select("p.ms", "p.seq")


def expired(ledger: DataFrame, now_us: int, days: float) -> DataFrame:
    return ledger.where(F.floor(F.col("occurred_us") / 1000) < (now_us - days * 24 * HOUR_US) // 1000)


def idle_sessions(ledger: DataFrame, now_us: int, hours: float = 168.0) -> DataFrame:
    """Sessions without any event within some hours."""
    return ledger.groupBy("session_id").agg(F.max("occurred_us").alias("last_us")).where(F.col("last_us") < now_us - int(hours * HOUR_US))


def archive_days(ledger: DataFrame, now_us: int, days: float, path: str) -> None:
    """Archives expired events day by day: under ``path`` events hold each day's rows, and manifest a row (day, n, mark) for each day that has arrived whole.

    A day is written over its own folder, read back, and committed if number and mark of ids agree; a run that broke off goes on with the days that aren't committed,
    and days whose events have changed since (late ones, say) are written anew.
    """
    from emberlake.sources.ledger import archive

    spark = ledger.sparkSession
    old = expired(ledger, now_us, days).withColumn("day", F.to_date("occurred_at"))
    told = lambda df: df.groupBy("day").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("event_id")).alias("mark"))
    todo = told(old).join(committed(spark, path), ["day", "n", "mark"], "left_anti")
    batches = sorted(r.day for r in todo.collect())  # at most one row for each day
    if not batches:
        return
    archive(old.where(F.col("day").isin(batches)).drop("day"), f"{path}/events", overwrite=True)
    arrived = told(spark.read.schema("event_id string, occurred_at timestamp_ntz").json(f"{path}/events").withColumn("day", F.to_date("occurred_at")))
    whole = arrived.join(todo, ["day", "n", "mark"], "left_semi")
    whole.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def committed(spark, path: str) -> DataFrame:
    """The manifest (day, n, mark) of an archive; empty where there is none yet."""
    schema, at = "day date, n long, mark long", spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(f"{path}/manifest").distinct() if there else spark.createDataFrame([], schema)


def archive_then_delete(ledger: DataFrame, now_us: int, days: float, path: str) -> DataFrame:
    """Archives expired events to ``path`` and returns the ledger without those of committed days; days that haven't arrived whole stay."""
    archive_days(ledger, now_us, days, path)
    told = expired(ledger, now_us, days).withColumn("day", F.to_date("occurred_at"))
    gone = told.groupBy("day").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("event_id")).alias("mark")).join(committed(ledger.sparkSession, path), ["day", "n", "mark"], "left_semi").select("day")
    dated = ledger.withColumn("day", F.to_date("occurred_at"))
    out_of_date = F.floor(F.col("occurred_us") / 1000) < (now_us - days * 24 * HOUR_US) // 1000
    return dated.join(gone.withColumn("archived", F.lit(True)), "day", "left").where(~(out_of_date & F.coalesce("archived", F.lit(False)))).select(*ledger.columns)
