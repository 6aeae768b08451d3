"""From events to graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.model import EDGE_ENDS
from emberlake.operators.ordering import with_previous


def nodes(ledger: DataFrame) -> DataFrame:
    """Event nodes; an event without position is an error."""
    position = F.when(F.col("position").isNull(), F.raise_error(F.lit("an event has no position")).cast("long")).otherwise(F.col("position"))
    return ledger.select("event_id", "event_type", "session_id", "agent_id", "trace_id", "occurred_us", "tool_name", F.col("importance_hint").alias("importance_score"), position.alias("global_position"))


def follows(ledger: DataFrame) -> DataFrame:
    """FOLLOWS edges: each event to the one before it in its session, with the milliseconds between."""
    named = ledger.select("event_id", "session_id", "occurred_us", "position")
    told = with_previous(named, ["event_id", "occurred_us"]).where("before IS NOT NULL")
    gap = (F.col("occurred_us") - F.col("before.occurred_us")) / 1000
    return told.select(F.col("event_id").alias("src"), F.col("before.event_id").alias("dst"), F.lit("FOLLOWS").alias("edge_type"), "session_id", gap.cast("long").alias("delta_ms"))


def caused_by(ledger: DataFrame) -> DataFrame:
    """CAUSED_BY edges: each event with a parent to it."""
    return ledger.where("parent_event_id IS NOT NULL").select(F.col("event_id").alias("src"), F.col("parent_event_id").alias("dst"), F.lit("CAUSED_BY").alias("edge_type"))


def event_edges(ledger: DataFrame) -> DataFrame:
    """Both edge types between events."""
    return follows(ledger).select("src", "dst", "edge_type").unionByName(caused_by(ledger))


def with_endpoints(edges: DataFrame, src_ids: DataFrame, dst_ids: DataFrame) -> DataFrame:
    """Edges whose ends exist; both id tables have one column, id."""
    return edges.join(src_ids.withColumnRenamed("id", "src"), "src", "left_semi").join(dst_ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) whose ends exist among ``nodes`` (id, label) with the labels that the type asks for; unknown types go."""
    rows = [(kind, a, b) for kind, (a, b) in EDGE_ENDS.items()]
    asked = edges.sparkSession.createDataFrame(rows, "edge_type string, from_label string, to_label string")  # a row for each type
    known = nodes.select("id", "label").distinct()
    end = lambda name: known.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    met = edges.join(F.broadcast(asked), "edge_type").join(end("src"), "src").join(end("dst"), "dst")
    fits = F.coalesce(F.col("src_label") == F.col("from_label"), F.lit(True)) & F.coalesce(F.col("dst_label") == F.col("to_label"), F.lit(True))
    return met.where(fits).select(*edges.columns)


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges within a set of nodes."""
    return with_endpoints(edges, ids, ids)


def enriched(ledger: DataFrame) -> DataFrame:
    """Key words, a default importance and the text to embed of each event."""
    from emberlake.functions.text import keywords

    words = keywords(F.col("event_type"), F.col("tool_name"))
    fresh = F.array_except(words, F.array("event_type", F.coalesce("tool_name", F.lit(""))))
    return ledger.select(
        "event_id", F.array_join(words, ",").alias("keywords"), F.coalesce("importance_hint", F.lit(5)).alias("importance_score"),
        F.concat_ws(" ", "event_type", "tool_name", F.when(F.size(fresh) > 0, F.array_join(fresh, " "))).alias("embedding_text"),
    )
