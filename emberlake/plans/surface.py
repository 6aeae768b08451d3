"""More queries by name: responses, texts, extracted items, mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlake.functions import text
from emberlake.model import Retention
from emberlake.operators import consolidation, projection, resolution, retention, retrieval, surface, users, vectors
from emberlake.plans import sql
from emberlake.plans.catalogue import MENTIONS, SESSION, USER, mentions, query, session_of
from emberlake.sources.ledger import NOW_US, micros


@query("atlas_nodes", f"""SELECT event_id AS node_id, 'Event' AS node_type, tool_name AS tool, CAST(importance_hint AS VARCHAR) AS importance, 2 + (tool_name IS NOT NULL)::INT + (importance_hint IS NOT NULL)::INT AS n_attributes, trace_id
  FROM ledger WHERE session_id = '{SESSION}'""")
def _(t):
    n = surface.atlas_nodes(session_of(t))
    return n.select("node_id", "node_type", F.try_element_at("attributes", F.lit("tool_name")).alias("tool"), F.try_element_at("attributes", F.lit("importance_score")).alias("importance"), F.size("attributes").alias("n_attributes"), "provenance.trace_id")


@query("atlas_document")
def _(t):
    return surface.atlas(surface.atlas_nodes(session_of(t)), projection.event_edges(session_of(t)))


@query("read_only_query", f"SELECT event_type, count(*) AS n FROM ledger WHERE session_id = '{SESSION}' GROUP BY ALL")
def _(t):
    t.ledger.createOrReplaceTempView("ledger")
    return surface.read_only(t.spark, "SELECT event_type, count(*) AS n FROM ledger WHERE session_id = :s GROUP BY ALL", s=SESSION)


@query("offset_page", f"""SELECT event_id FROM (SELECT event_id, round({sql.DECAY}, 6) AS decay, position
  FROM ledger WHERE session_id = '{SESSION}') ORDER BY decay DESC, position LIMIT 10 OFFSET 10""")
def _(t):
    return retrieval.scored_events(session_of(t), NOW_US).orderBy(F.col("decay").desc(), "position").offset(10).limit(10).select("event_id")


@query("reciprocal_ranks", f"""SELECT event_id AS id, round(1 / row_number() OVER (ORDER BY importance_hint DESC, occurred_us, position), 6) AS score
  FROM ledger WHERE session_id = '{SESSION}' AND importance_hint IS NOT NULL""")
def _(t):
    return retrieval.reciprocal(retrieval.temporal_anchors(session_of(t), 1000)).select("id", F.round("score", 6).alias("score"))


@query("recall_texts", "SELECT event_id AS id, coalesce(tool_name, event_type) AS text FROM ledger")
def _(t):
    return t.ledger.select(F.col("event_id").alias("id"), surface.node_text(t.ledger.columns, "content", "tool_name", "event_type").alias("text"))


@query("context_text", f"""SELECT agent_id AS \"group\", string_agg('[' || event_type || '] ' || coalesce(tool_name, '') || ' (score: ' || printf('%.2f', access_count / 10.0) || ')', chr(10) ORDER BY access_count DESC, event_id) AS context
  FROM ledger WHERE user_id = {USER} GROUP BY agent_id""")
def _(t):
    rows = t.ledger.where(F.col("user_id") == USER).select(F.col("agent_id").alias("group"), F.col("event_id").alias("id"), F.col("event_type").alias("node_type"), F.coalesce("tool_name", F.lit("")).alias("text"), (F.col("access_count") / 10).alias("score"))
    return surface.context_lines(rows)


@query("markdown_sections", f"""SELECT event_type AS node_type, '## ' || event_type || chr(10) || string_agg('- ' || trace_id, chr(10) ORDER BY event_id) AS section
  FROM ledger WHERE session_id = '{SESSION}' GROUP BY event_type""")
def _(t):
    return surface.markdown(session_of(t).select(F.col("event_id").alias("id"), F.col("event_type").alias("node_type"), F.col("trace_id").alias("text")))


@query("parsed_items", "SELECT event_id AS id, j AS pos, 'n' || j AS name, k FROM ledger, (VALUES (0), (2)) AS v(j)")
def _(t):
    items = F.concat(F.lit('[{"name":"n0","k":'), "k", F.lit('},{"k":1},{"name":"n2","k":'), "k", F.lit("}]"))
    raw = t.ledger.select(F.col("event_id").alias("id"), items.alias("items"))
    return surface.parsed_items(raw, "struct<name:string,k:int>", ["name", "k"])


@query("stream_keys", "SELECT event_id, row_number() OVER (ORDER BY occurred_us // 1000, position) AS place FROM ledger")
def _(t):
    key = surface.stream_key(F.concat(F.floor(F.col("occurred_us") / 1000).cast("string"), F.lit("-"), "event_id"))
    ranged = t.ledger.select("event_id", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), key.alias("key"))
    # Places within days, then whole days before: no task sorts all rows.
    days = ranged.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n"))
    within = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy("key")))
    return within.join(days, "day").select("event_id", (F.col("before") + F.col("rn")).alias("place"))


@query("iso_timestamps", "SELECT event_id, CASE WHEN position % 4 = 0 THEN NULL ELSE occurred_us // 1000000 END AS seconds FROM ledger")
def _(t):
    raw = F.when(F.col("position") % 4 == 0, "not a time").otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = F.expr("try_cast(raw AS timestamp_ntz)")
    return t.ledger.select("event_id", raw.alias("raw")).select("event_id", F.floor(micros(parsed) / 1_000_000).alias("seconds"))


@query("summary_prompts", """SELECT session_id, 'Summarise ' || count(*) || ' events:' || chr(10) || string_agg('- ' || event_type || coalesce(' [' || tool_name || ']', '') || ' ' || status, chr(10) ORDER BY occurred_us, position) AS prompt
  FROM ledger GROUP BY session_id""")
def _(t):
    return surface.summary_prompts(t.ledger)


@query("summarizes_edges", """SELECT s.summary_id AS src, event_id AS dst FROM ledger
  JOIN (SELECT session_id, left(sha256(string_agg(event_id, '|' ORDER BY event_id)), 12) AS summary_id
  FROM ledger GROUP BY session_id) s USING (session_id)""")
def _(t):
    return surface.summarizes_edges(t.ledger, consolidation.summaries(t.ledger, "session", ["session_id"]), ["session_id"]).select("src", "dst")


@query("forgetting_run", f"""SELECT tier, CASE WHEN tier = 'cold' AND coalesce(importance_hint, 0) < 5 AND access_count < 3 THEN 'delete'
  WHEN tier = 'archive' THEN 'archive' ELSE 'keep' END AS action, count(*) AS n FROM (SELECT *, {sql.tier(480)} AS tier
  FROM ledger) GROUP BY ALL""")
def _(t):
    return surface.forgotten(t.ledger.withColumn("similarity", F.lit(None).cast("double")), NOW_US, Retention(cold=480))


@query("prune_dry_run", f"""SELECT event_id, (SELECT count(*) FROM ledger WHERE {sql.HOURS} >= 168 AND coalesce(importance_hint, 0) < 5 AND access_count < 3) > 100 AS truncated
  FROM ledger WHERE {sql.HOURS} >= 168 AND coalesce(importance_hint, 0) < 5 AND access_count < 3 ORDER BY position LIMIT 100""")
def _(t):
    found = t.ledger.where((retention.age_hours(NOW_US) >= 168) & retention.prune_cold(F.col("importance_hint"), F.col("access_count")))
    return surface.capped_ids(found, 100)


@query("workflow_patterns", """SELECT pattern, count(*) AS n, count(DISTINCT session_id) AS sessions
  FROM (SELECT session_id, event_type || ' > ' || lead(event_type, 1) OVER w || ' > ' || lead(event_type, 2) OVER w AS pattern
  FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY occurred_us, position)) WHERE pattern IS NOT NULL
  GROUP BY pattern HAVING count(DISTINCT session_id) >= 2""")
def _(t):
    return surface.workflow_patterns(t.ledger)


@query("rule_based_entities", """SELECT DISTINCT doc_id AS id, kind, unnest(v) AS value
  FROM (SELECT doc_id, 'email' AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}') AS v
  FROM documents UNION ALL SELECT doc_id, 'url', regexp_extract_all(text, 'https?://[^\\s)>]+')
  FROM documents UNION ALL SELECT doc_id, 'handle', regexp_extract_all(text, '@[A-Za-z0-9_]{3,}')
  FROM documents)""", model=False)
def _(t):
    return surface.mentioned(t.read("documents").select(F.col("doc_id").alias("id"), "text"))


@query("hashed_embeddings")
def _(t):
    return surface.embedded(t.read("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"))


@query("recorded_chain", """SELECT event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY occurred_us, position) AS parent_event_id
  FROM ledger""")
def _(t):
    return surface.chained(t.ledger)


@query("normalised_names", f"{MENTIONS} SELECT event_id, {sql.normalised('name')} AS plain FROM mentions")
def _(t):
    return mentions(t).select("event_id", text.normalised(F.col("name")).alias("plain"))


@query("resolution_cascade")
def _(t):
    """All names against those of one session, and what similar names' hashed words say."""
    named = mentions(t)
    known = named.where(F.col("session_id") == SESSION).groupBy("name").agg(F.min("position").alias("ordinal"), F.min_by("entity_type", "position").alias("entity_type"))
    new = named.groupBy("name").agg(F.min("position").alias("ordinal"), F.min_by("entity_type", "position").alias("entity_type"))
    vectors_of = lambda df: surface.embedded(df.select(F.col("name").alias("id"), F.col("name").alias("text")))
    near = vectors.vector_search(vectors_of(known), vectors_of(new).select(F.col("id").alias("qid"), F.col("vector").alias("q")), 1, 0.75)
    return surface.resolved(new, known, near.select(F.col("qid").alias("name"), F.col("id").alias("target"), "similarity"))


@query("events_of_user_entities", f"SELECT event_id FROM ledger WHERE session_id = '{SESSION}' AND k % 5 = 0")
def _(t):
    owners = t.entities.where("k % 5 = 0").select("entity_id")
    return surface.has_user_data(session_of(t), t.references, owners).select("event_id")


@query("caused_children", f"""SELECT dst AS event_id, count(*) AS children FROM caused JOIN ledger ON event_id = dst
  WHERE session_id = '{SESSION}' GROUP BY dst""")
def _(t):
    return projection.caused_by(session_of(t)).groupBy(F.col("dst").alias("event_id")).agg(F.count("*").alias("children"))


@query("user_provenance", f"""SELECT 'preference' AS kind, 'pref:' || event_id AS id, user_id, event_id
  FROM ledger WHERE user_id = {USER} UNION ALL SELECT 'skill', 'skill:' || event_type, user_id, event_id
  FROM ledger WHERE user_id = {USER} AND tool_name IS NOT NULL""")
def _(t):
    own = t.ledger.where(F.col("user_id") == USER)
    prefs = users.preferences(own).withColumn("event_id", F.substring("preference_id", 6, 100))
    skills = own.where("tool_name IS NOT NULL").select(F.concat(F.lit("skill:"), "event_type").alias("skill_id"), "user_id", "event_id")
    return surface.provenance(prefs, skills)


@query("tier_policies", """SELECT category, polarity, CASE WHEN n >= 500 THEN 'hot' WHEN n >= 200 THEN 'warm' ELSE 'cold' END AS tier
  FROM (SELECT split_part(event_type, '.', 1) AS category, CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n
  FROM ledger GROUP BY ALL)""")
def _(t):
    counts = users.preferences(t.ledger).groupBy("category", "polarity").agg(F.count("*").alias("n"))
    return counts.select("category", "polarity", F.when(F.col("n") >= 500, "hot").when(F.col("n") >= 200, "warm").otherwise("cold").alias("tier"))


@query("sessions_per_day", "SELECT strftime(occurred_at, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM ledger GROUP BY ALL")
def _(t):
    return t.ledger.groupBy(F.window("occurred_at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
