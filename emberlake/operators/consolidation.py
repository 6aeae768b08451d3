"""Episodes, summaries and the triggers of consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.ordering import with_previous, with_running


def episodes(ledger: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Events with their episode (from 0) within the session; a gap longer than ``gap_minutes`` starts another."""
    told = with_previous(ledger, ["occurred_us"])
    starts = F.when(F.col("occurred_us") - F.col("before.occurred_us") > gap_minutes * 60_000_000, 1).otherwise(0)
    return with_running(told, starts, "episode").drop("before")


def sum_of_ids(name: str) -> Column:
    """A digest of a group's ids in no order: exclusive or and sum of parts of their digests, which add up before the shuffle."""
    part = lambda at, n: F.conv(F.substring(F.md5(name), at, n), 16, 10).cast("long")
    return F.concat_ws("|", F.bit_xor(part(1, 15)).cast("string"), F.sum(part(16, 8)).cast("string"), F.count("*").cast("string"))


def summaries(events: DataFrame, scope: str, keys: list[str], bounded: bool = True) -> DataFrame:
    """One summary for each group: a deterministic id, count, types, extent and text.

    The id is a digest of the group's sorted event ids; groups without a bound (``bounded`` false) take one that needs no list of them.
    """
    ids = F.array_join(F.array_sort(F.collect_list("event_id")), "|") if bounded else sum_of_ids("event_id")
    grouped = events.groupBy(*keys).agg(
        F.left(F.sha2(ids, 256), F.lit(12)).alias("summary_id"), F.count("*").alias("event_count"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types"),
        F.min("occurred_us").alias("start_us"), F.max("occurred_us").alias("end_us"),
    )
    told = lambda us: F.date_format(F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(F.col("event_count").cast("string"), F.lit(" events ("), "event_types", F.lit(") from "), told(F.col("start_us")), F.lit(" to "), told(F.col("end_us")))
    return grouped.select(F.lit(scope).alias("scope"), *keys, "summary_id", "event_count", "event_types", "start_us", "end_us", text.alias("content"))


def qualifying(ledger: DataFrame, threshold: int = 150, weight: int = 5) -> DataFrame:
    """Sessions whose events, each worth ``weight``, reach the reflection threshold."""
    return ledger.groupBy("session_id").agg(F.count("*").alias("events")).where(F.col("events") * weight >= threshold)


def reflection_points(ledger: DataFrame, threshold: int = 150) -> DataFrame:
    """Events at which a session's importance sum passes another multiple of ``threshold``."""
    total = with_running(ledger, F.coalesce("importance_hint", F.lit(5)), "total")
    passed = F.floor(F.col("total") / threshold) > F.floor((F.col("total") - F.coalesce("importance_hint", F.lit(5))) / threshold)
    return total.where(passed).select("event_id", "session_id", "total")


def extraction_triggers(ledger: DataFrame, every: int = 50) -> DataFrame:
    """Every so many events of a session that the system hasn't made."""
    counted = with_running(ledger.where(~F.col("event_type").startswith("system.")), F.lit(1), "turn")
    return counted.where(F.col("turn") % every == 0).select("session_id", "event_id", "turn")


def transcript(conversations: DataFrame, width: int = 500) -> DataFrame:
    """One text for each conversation: a header for each turn, then its text, cut at ``width`` characters."""
    line = F.concat(F.lit("[Turn "), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), F.left("text", F.lit(width)))
    lines = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def session_transcripts(events: DataFrame, width: int = 500) -> DataFrame:
    """(session_id, transcript): for each event in order a header (turn, time, type, tool, agent), then its payload_ref, status, content, and input and output, cut at ``width``.

    events: session_id, occurred_at, occurred_us, position, event_type, tool_name, agent_id, payload_ref, status, payload (JSON). A null payload is read from a
    reference that is JSON itself. The text of a session is one value: its size is the session's.
    """
    from emberlake.functions.text import inline_payload

    body = F.coalesce("payload", inline_payload(F.col("payload_ref")))
    part = lambda name: F.get_json_object(body, f"$.{name}")
    short = lambda c: F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"  {label}: "), c))
    header = F.concat(F.date_format("occurred_at", "'['yyyy-MM-dd'T'HH:mm:ss.SSSSSS'] '"), "event_type", F.coalesce(F.concat(F.lit(" tool="), F.when(F.col("tool_name") != "", F.col("tool_name"))), F.lit("")), F.lit(" agent="), "agent_id")
    rest = F.concat_ws("\n", F.concat(F.lit("  payload_ref: "), F.coalesce("payload_ref", F.lit(""))), line("status", F.col("status")), line("content", part("content")), line("input", short(part("input"))), line("output", short(part("output"))), F.lit(""))
    turns = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("occurred_us", "position", header.alias("header"), rest.alias("rest")))).alias("turns"))
    told = F.transform("turns", lambda x, i: F.concat(F.lit("[Turn "), i.cast("string"), F.lit("] "), x["header"], F.lit("\n"), x["rest"]))
    return turns.select("session_id", F.array_join(told, "\n").alias("transcript"))
