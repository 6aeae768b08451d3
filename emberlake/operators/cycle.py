"""The batch jobs that run over the whole graph: the consolidation cycle and the trimming of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.model import Retention
from emberlake.operators import consolidation, graph, retention


def scoped_summaries(ledger: DataFrame, threshold: int = 150) -> DataFrame:
    """Summaries (scope, scope_id, ...) of the sessions that reach the reflection threshold: of each episode, each session, and each agent over such sessions.

    A session belongs to the agent of its first event.
    """
    chosen = ledger.join(consolidation.qualifying(ledger, threshold).select("session_id"), "session_id", "left_semi")
    parts = consolidation.episodes(chosen).withColumn("scope_id", F.concat("session_id", F.lit("-ep"), F.col("episode").cast("string")))
    first = F.first("agent_id").over(Window.partitionBy("session_id").orderBy("occurred_us", "position"))
    out = consolidation.summaries(parts, "episode", ["scope_id"])
    out = out.unionByName(consolidation.summaries(chosen.withColumn("scope_id", F.col("session_id")), "session", ["scope_id"]))
    return out.unionByName(consolidation.summaries(chosen.withColumn("scope_id", first), "agent", ["scope_id"], bounded=False))


def with_centrality(ledger: DataFrame, edges: DataFrame) -> DataFrame:
    """The ledger with the importance of events that edges lead to, from their number."""
    scored = graph.centrality_importance(ledger.select(F.col("event_id").alias("id"), F.col("importance_hint").alias("importance_score")), edges)
    new = scored.select(F.col("id").alias("event_id"), F.col("importance_score").cast("int").alias("scored"))
    return ledger.join(new, "event_id", "left").withColumn("importance_hint", F.coalesce("scored", "importance_hint")).select(*ledger.columns)


def consolidated(ledger: DataFrame, edges: DataFrame, now_us: int, threshold: int = 150, r: Retention = Retention()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A consolidation cycle: the summaries, then the events with their importance from centrality that forgetting keeps, and the edges
    (src, dst, edge_type, similarity) that it keeps."""
    events, left = retention.forget(with_centrality(ledger, edges), edges, now_us, r)
    return scoped_summaries(ledger, threshold), events, left


def dedup_trimmed(seen: DataFrame, cutoff_ms: int) -> DataFrame:
    """The de-duplication set (event_id, ms) without ids older than the cutoff."""
    return seen.where(F.col("ms") >= cutoff_ms)


def trimmed(ledger: DataFrame, progress: DataFrame, seen: DataFrame, now_us: int, hot_days: float = 7, ceiling_days: float = 90, idle_hours: float = 168, path: str | None = None) -> dict[str, DataFrame]:
    """What trimming leaves: ``stream`` (the events of the hot window and whatever the slowest group, see :func:`retention.trim_point`, hasn't read),
    ``documents`` (without expired ones, which go to the archive ``path`` first where one is given), ``seen`` and ``sessions`` (those still active)."""
    day_ms = 24 * 3_600_000
    point = retention.trim_point(progress, int(now_us // 1000 - hot_days * day_ms))  # one row
    stream = ledger.join(F.broadcast(point)).where(F.floor(F.col("occurred_us") / 1000) >= F.col("ms")).drop("ms", "seq")
    if path is None:
        gone = retention.expired(ledger, now_us, ceiling_days).select("event_id")
        documents = ledger.join(gone, "event_id", "left_anti")
    else:
        documents = retention.archive_then_delete(ledger, now_us, ceiling_days, path)
    sessions = ledger.select("session_id").distinct().join(retention.idle_sessions(ledger, now_us, idle_hours), "session_id", "left_anti")
    return {"stream": stream, "documents": documents, "seen": dedup_trimmed(seen, int(now_us // 1000 - ceiling_days * day_ms)), "sessions": sessions}
