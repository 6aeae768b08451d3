"""Queries that run streams over the ledger, started again and again from their checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.operators import graph, ledger
from emberlake.plans.catalogue import FAULTS, query, with_faults
from emberlake.sources.ledger import NOW_US
from emberlake.streaming import queries as streams

#: Every so many events a session ends, in the queries about ends.
END_STEP = 17
ENDED = f"CASE WHEN position % {END_STEP} = 0 THEN 'system.session_end' ELSE event_type END"
IN_SESSION = "PARTITION BY session_id ORDER BY occurred_us, position"


@query("stream_projection", """SELECT 'node' AS kind, session_id, event_id, event_type, tool_name, importance_hint AS importance_score, position AS global_position, NULL AS src, NULL AS dst, NULL AS edge_type, CAST(NULL AS BIGINT) AS delta_ms FROM ledger
UNION ALL SELECT 'edge', session_id, NULL, NULL, NULL, NULL, NULL, src, dst, 'FOLLOWS', delta_ms FROM follows
UNION ALL SELECT 'edge', session_id, NULL, NULL, NULL, NULL, NULL, event_id, parent_event_id, 'CAUSED_BY', NULL FROM ledger WHERE parent_event_id IS NOT NULL""")
def _(t):
    return streams.replayed(t.ledger, streams.projected, "stream_projection")


@query("stream_follows", "SELECT src, dst, 'FOLLOWS' AS edge_type, session_id, delta_ms FROM follows")
def _(t):
    return streams.replayed(t.ledger, streams.follows, "stream_follows", 2)


@query("stream_enrichment", """SELECT event_id, coalesce(importance_hint, 5) AS importance_score,
  CASE WHEN tool_name IS NULL THEN replace(event_type, '.', ',') ELSE replace(event_type, '.', ',') || ',' || tool_name END AS keywords
  FROM ledger""")
def _(t):
    return streams.replayed(t.ledger, streams.enriched, "stream_enrichment", 2).select("event_id", "importance_score", "keywords")


@query("stream_extraction", f""", e AS (SELECT session_id, event_id, occurred_us, position, {ENDED} AS event_type FROM ledger),
lives AS (SELECT *, coalesce(sum((event_type = 'system.session_end')::INT) OVER ({IN_SESSION} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e),
turned AS (SELECT *, sum((event_type NOT LIKE 'system.%')::INT) OVER (PARTITION BY session_id, life ORDER BY occurred_us, position) AS turn FROM lives),
due AS (SELECT *, CASE WHEN event_type = 'system.session_end' THEN 'session_end' WHEN event_type NOT LIKE 'system.%' AND turn % 5 = 0 THEN 'turn' END AS reason FROM turned),
hit AS (SELECT session_id, event_id, first_value(CASE WHEN reason IS NOT NULL THEN struct_pack(e := event_id, r := reason, t := turn) END IGNORE NULLS) OVER ({IN_SESSION} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h FROM due)
SELECT session_id, h.e AS trigger_event_id, h.r AS reason, CAST(h.t AS BIGINT) AS turns, event_id FROM hit WHERE h IS NOT NULL""")
def _(t):
    return streams.replayed(t.ledger.withColumn("event_type", F.expr(ENDED)), lambda s: streams.extraction_pieces(s, 5), "stream_extraction")


@query("stream_extraction_triggers", """SELECT session_id, event_id, turn
  FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_us, position) AS turn
  FROM ledger WHERE event_type NOT LIKE 'system.%') WHERE turn % 5 = 0""")
def _(t):
    return streams.replayed(t.ledger.where("event_type NOT LIKE 'system.%'"), lambda s: streams.extraction_triggers(s, 5), "stream_extraction_triggers", 2)


@query("stream_dedup", "SELECT event_id FROM ledger")
def _(t):
    folder = graph.cut(t.ledger.unionByName(t.ledger)).inputFiles()[0].rsplit("/", 1)[0]
    return streams.drained(streams.deduplicated(streams.event_stream(t.spark, folder, 100), None), "stream_dedup").select("event_id")


@query("stream_dedup_in_time", "SELECT event_id FROM ledger")
def _(t):
    """Each part arrives twice, the second time right after the first: the state holds a day of ids and no more."""
    base = streams.new_folder(t.spark, "stream_dedup_in_time")
    twice = [part for one in streams.by_time(t.ledger, 2) for part in (one, one)]
    return streams.arriving(twice, base, lambda s: streams.drained(streams.deduplicated(s, "31 days"), "dedup", f"{base}/out")).select("event_id")


@query("stream_windows", """, m AS (SELECT max(occurred_us) - 3600000000 AS mark FROM ledger), w AS (SELECT event_type, unnest(range(occurred_us // 21600000000 - 3, occurred_us // 21600000000 + 1)) * 21600000000 AS s FROM ledger)
SELECT s AS start_us, event_type, count(*) AS n FROM w, m WHERE s + 86400000000 <= mark GROUP BY ALL""")
def _(t):
    """Days that begin every six hours; those that the watermark has passed."""
    base = streams.new_folder(t.spark, "stream_windows")
    found = streams.arriving(streams.by_time(t.ledger, 2), base, lambda s: streams.drained(streams.windows(s, "1 hour", "1 day", "6 hours"), "windows", f"{base}/out", settle=True))
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_bursts", f""", cut AS (SELECT *, CASE WHEN occurred_us - lag(occurred_us) OVER ({IN_SESSION}) >= 1800000000 THEN 1 ELSE 0 END AS starts FROM ledger),
runs AS (SELECT *, sum(starts) OVER ({IN_SESSION} ROWS UNBOUNDED PRECEDING) AS run FROM cut), m AS (SELECT max(occurred_us) - 3600000000 AS mark FROM ledger)
SELECT session_id, min(occurred_us) AS start_us, max(occurred_us) + 1800000000 AS end_us, count(*) AS n FROM runs GROUP BY session_id, run HAVING max(occurred_us) + 1800000000 <= (SELECT mark FROM m)""")
def _(t):
    base = streams.new_folder(t.spark, "stream_bursts")
    found = streams.arriving(streams.by_time(t.ledger, 2), base, lambda s: streams.drained(streams.bursts(s), "bursts", f"{base}/out", settle=True))
    return found.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_late_rows", """, m AS (SELECT max(occurred_us) - 3600000000 AS mark FROM ledger WHERE position % 10 <> 0),
r AS (SELECT event_type, occurred_us // 86400000000 * 86400000000 AS start_us, position % 10 = 0 AND occurred_us // 86400000000 * 86400000000 + 86400000000 <= mark AS late FROM ledger, m)
SELECT CASE WHEN late THEN 'late' ELSE 'counted' END AS what, start_us, event_type, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    """A tenth of the events arrives after all others."""
    base = streams.new_folder(t.spark, "stream_late_rows")
    parts = [t.ledger.where("position % 10 != 0"), t.ledger.where("position % 10 = 0")]
    streams.arriving(parts, base, lambda s: streams.run_to_end(streams.counted_with_late(s, base), f"{base}/checkpoint"))
    late = t.spark.read.parquet(f"{base}/late").groupBy(F.window("at", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    both = streams.total_counts(t.spark, base).withColumn("what", F.lit("counted")).unionByName(late.withColumn("what", F.lit("late")))
    return both.select("what", F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_dead_letters", FAULTS + """, f AS (SELECT event_id, position, concat_ws(',', a, b, c, d, e) AS error FROM faulty)
SELECT CASE WHEN error = '' THEN 'good' WHEN position % 7 < 2 THEN 'dead' ELSE 'waiting' END AS what, event_id, CASE WHEN error <> '' AND position % 7 < 2 THEN position END AS original_position, CASE WHEN error <> '' AND position % 7 < 2 THEN 'projection' END AS "group",
  CASE WHEN error = '' THEN 1 WHEN position % 7 < 2 THEN 6 ELSE 7 - position % 7 END AS delivery_count, CASE WHEN error <> '' AND position % 7 < 2 THEN error END AS error FROM f""")
def _(t):
    """Seven parts arrive; an event that fails is delivered again with each of the following ones, and given up with the sixth delivery."""
    base, events = streams.new_folder(t.spark, "stream_dead_letters"), with_faults(t)
    checked = lambda df: ledger.errors(df, NOW_US).withColumn("error", F.when(F.size("errors") > 0, F.array_join("errors", ","))).drop("errors")
    parts = [events.where(F.col("position") % 7 == k) for k in range(7)]
    streams.arriving(parts, base, lambda s: streams.run_to_end(streams.with_dead_letters(s, base, "projection", checked), f"{base}/checkpoint"))
    names = ["original_position", "group", "delivery_count", "error"]

    def read(what: str, path: str):
        found = t.spark.read.parquet(f"{base}/{path}")
        more = [F.col(n) if n in found.columns else F.lit(None).cast("long" if n == "original_position" else "string").alias(n) for n in names]
        return found.select(F.lit(what).alias("what"), "event_id", *more)

    return read("good", "good").unionByName(read("dead", "dead")).unionByName(read("waiting", "waiting/epoch=6"))
