"""Queries of the batch jobs and of upserts that merge properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.model import Retention
from emberlake.operators import consolidation, cycle, projection, upsert
from emberlake.plans import sql
from emberlake.plans.catalogue import SESSION, query
from emberlake.sources.ledger import NOW_US

DAY_MS = 24 * 3_600_000


def episode_sql(name: str, minutes: int, of: str = "ledger") -> str:
    """A table of each event's episode for a gap of some minutes."""
    return f"""{name} AS (
  SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY occurred_us, position ROWS UNBOUNDED PRECEDING) AS episode FROM (
    SELECT *, CASE WHEN occurred_us - lag(occurred_us) OVER (PARTITION BY session_id ORDER BY occurred_us, position) > {minutes * 60_000_000} THEN 1 ELSE 0 END AS starts FROM {of}))"""


@query("cycle_summaries", f""", chosen AS (SELECT * FROM ledger WHERE session_id IN (SELECT session_id FROM ledger GROUP BY ALL HAVING count(*) * 5 >= 350)), {episode_sql("parts", 30, "chosen")}
SELECT scope, scope_id, count(*) AS event_count, min(occurred_us) AS start_us, max(occurred_us) AS end_us FROM (
  SELECT 'episode' AS scope, session_id || '-ep' || CAST(episode AS BIGINT) AS scope_id, occurred_us FROM parts
  UNION ALL SELECT 'session', session_id, occurred_us FROM chosen UNION ALL SELECT 'agent', agent_id, occurred_us FROM chosen) GROUP BY scope, scope_id""")
def _(t):
    return cycle.scoped_summaries(t.ledger, 350).select("scope", "scope_id", "event_count", "start_us", "end_us")


@query("cycle_events", f""", deg AS (SELECT dst, count(*) AS n FROM (SELECT dst FROM edges) GROUP BY dst),
scored AS (SELECT l.*, CASE WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 8 WHEN n >= 3 THEN 6 WHEN n IS NOT NULL THEN coalesce(importance_hint, 5) ELSE importance_hint END AS scored FROM ledger l LEFT JOIN deg ON dst = event_id)
SELECT event_id, scored AS importance_hint FROM (SELECT *, {sql.tier(480)} AS tier FROM scored) WHERE tier <> 'archive' AND NOT (tier = 'cold' AND coalesce(scored, 0) < 5 AND access_count < 3)""")
def _(t):
    edges = projection.event_edges(t.ledger).withColumn("similarity", F.lit(None).cast("double"))
    return cycle.consolidated(t.ledger, edges, NOW_US, 350, Retention(cold=480.0))[1].select("event_id", "importance_hint")


@query("ledger_trim", f""", p AS (SELECT least(min(ms), {NOW_US // 1000 - 10 * DAY_MS}) AS ms FROM (SELECT max(occurred_us) // 1000 AS ms FROM ledger GROUP BY agent_id)), old AS (SELECT {NOW_US // 1000 - 20 * DAY_MS} AS ms)
SELECT 'stream' AS part, count(*) AS n FROM ledger, p WHERE occurred_us // 1000 >= p.ms UNION ALL SELECT 'documents', count(*) FROM ledger, old WHERE occurred_us // 1000 >= old.ms
UNION ALL SELECT 'seen', count(*) FROM ledger, old WHERE occurred_us // 1000 >= old.ms
UNION ALL SELECT 'sessions', count(*) FROM (SELECT session_id FROM ledger GROUP BY ALL HAVING max(occurred_us) >= {NOW_US - 12 * 3_600_000_000})""")
def _(t):
    progress = t.ledger.groupBy("agent_id").agg(F.concat(F.floor(F.max("occurred_us") / 1000).cast("string"), F.lit("-0")).alias("stream_id"))
    seen = t.ledger.select("event_id", F.floor(F.col("occurred_us") / 1000).alias("ms"))
    left = cycle.trimmed(t.ledger, progress, seen, NOW_US, hot_days=10, ceiling_days=20, idle_hours=12)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("dedup_set_trim", f"SELECT event_id, occurred_us // 1000 AS ms FROM ledger WHERE occurred_us // 1000 >= {NOW_US // 1000 - 20 * DAY_MS}")
def _(t):
    return cycle.dedup_trimmed(t.ledger.select("event_id", F.floor(F.col("occurred_us") / 1000).alias("ms")), NOW_US // 1000 - 20 * DAY_MS)


@query("session_event_count", f"SELECT count(*) AS n FROM ledger WHERE session_id = '{SESSION}'")
def _(t):
    return t.ledger.where(F.col("session_id") == SESSION).agg(F.count("*").alias("n"))


def episode_nodes(ledger, minutes: int):
    """Episode nodes with their extent."""
    parts = consolidation.episodes(ledger, minutes)
    nodes = parts.groupBy("session_id", "episode").agg(F.count("*").alias("event_count"), F.min("occurred_us").alias("start_us"), F.max("occurred_us").alias("end_us"))
    return nodes.select(F.concat("session_id", F.lit("-ep"), F.col("episode").cast("string")).alias("episode_id"), "session_id", "start_us", "end_us", "event_count")


@query("episode_upsert", f""", {episode_sql("old", 60)}, {episode_sql("new", 30)},
a AS (SELECT session_id || '-ep' || CAST(episode AS BIGINT) AS id, session_id, count(*) AS n, min(occurred_us) AS s, max(occurred_us) AS e FROM old GROUP BY session_id, episode),
b AS (SELECT session_id || '-ep' || CAST(episode AS BIGINT) AS id, session_id, count(*) AS n, min(occurred_us) AS s, max(occurred_us) AS e FROM new GROUP BY session_id, episode)
SELECT coalesce(b.id, a.id) AS episode_id, coalesce(b.session_id, a.session_id) AS session_id, coalesce(b.s, a.s) AS start_us, coalesce(b.e, a.e) AS end_us, coalesce(b.n, a.n) AS event_count, CASE WHEN a.id IS NOT NULL THEN 'session' END AS episode_type FROM a FULL JOIN b ON a.id = b.id""")
def _(t):
    old = episode_nodes(t.ledger, 60).withColumn("episode_type", F.lit("session"))
    return upsert.merge_nodes("Episode", old, episode_nodes(t.ledger, 30).withColumn("at", F.lit(1)), "at")


@query("episode_contains", f""", {episode_sql("parts", 30)} SELECT session_id || '-ep' || CAST(episode AS BIGINT) AS src, event_id AS dst, 'CONTAINS' AS edge_type FROM parts""")
def _(t):
    parts = consolidation.episodes(t.ledger).select(F.concat("session_id", F.lit("-ep"), F.col("episode").cast("string")).alias("src"), F.col("event_id").alias("dst"))
    return upsert.typed_edges("CONTAINS", parts)


@query("belief_upsert", """, b AS (SELECT session_id || ':' || split_part(event_type, '.', 1) AS belief_id, * FROM ledger)
SELECT belief_id, arg_max(tool_name, position) FILTER (tool_name IS NOT NULL) AS belief_text, arg_max(value, position) FILTER (value IS NOT NULL) AS confidence, CASE WHEN split_part(belief_id, ':', 2) = 'tool' THEN count(*) END AS confirmation_count FROM b GROUP BY belief_id""")
def _(t):
    named = t.ledger.withColumn("belief_id", F.concat("session_id", F.lit(":"), F.split_part("event_type", F.lit("."), F.lit(1))))
    old = named.where("belief_id LIKE '%:tool'").groupBy("belief_id").agg(F.lit("to be replaced").alias("belief_text"), F.count("*").alias("confirmation_count"))
    changes = named.select("belief_id", F.col("tool_name").alias("belief_text"), F.col("value").alias("confidence"), "position")
    return upsert.merge_nodes("Belief", old, changes, "position").select("belief_id", "belief_text", "confidence", "confirmation_count")


@query("edges_upsert", """SELECT src, dst, 'FOLLOWS' AS edge_type, CAST(delta_ms AS VARCHAR) AS delta_ms, CASE WHEN delta_ms > 3600000 THEN '4' ELSE '1' END AS seen, CASE WHEN delta_ms > 3600000 THEN 'yes' END AS slow FROM follows
UNION ALL SELECT src, dst, 'CAUSED_BY', NULL, '2', NULL FROM caused""")
def _(t):
    def given(edges, kind, order, **props):
        entries = [x for name, value in props.items() for x in (F.lit(name), F.lit(value))]
        return edges.select("src", "dst", F.lit(kind).alias("edge_type"), F.create_map(*entries).alias("props"), F.lit(order).alias("at"))

    follows = projection.follows(t.ledger)
    old = upsert.typed_edges("FOLLOWS", follows.select("src", "dst", F.create_map(F.lit("delta_ms"), F.col("delta_ms").cast("string"), F.lit("seen"), F.lit("1")).alias("props")))
    slow = follows.where("delta_ms > 3600000")
    changes = given(projection.caused_by(t.ledger), "CAUSED_BY", 1, seen="2").unionByName(given(slow, "FOLLOWS", 2, seen="4", slow="yes"))
    changes = changes.unionByName(given(slow, "FOLLOWS", 1, seen="3")).unionByName(given(slow, "KNOWS", 1, seen="5"))
    merged = upsert.merge_edges(old, changes, "at")
    return merged.select("src", "dst", "edge_type", *[F.try_element_at("props", F.lit(c)).alias(c) for c in ("delta_ms", "seen", "slow")])
