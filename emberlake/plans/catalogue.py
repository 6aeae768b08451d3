"""Queries by name: each a function of the tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import scoring, text
from emberlake.model import EDGE_TYPES, ENTITY_TYPES, INTENT_WEIGHTS, PROACTIVE_SIGNALS, EventQuery, Retention, SubgraphQuery
from emberlake.operators import consolidation, graph, ledger, projection, resolution, retention, retrieval, upsert, users, vectors
from emberlake.plans import sql
from emberlake.sources.ledger import NOW_US, Tables, to_json_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The session, user, and other literals that single-object queries ask about.
SESSION, USER = "s5", 5
TERMS = ["the", "and", "thing", "onth", "ering"]
QUESTIONS = [
    (1, "Why did the deploy fail because of the timeout?"), (2, "When was the timeline before the outage?"), (3, "What does explain mean, describe it"),
    (4, "similar incidents, like this one"), (5, "who is the team author"), (6, "how does the process workflow work"), (7, "prefer my favorite style"),
    (8, "hello world"), (9, "show me the order"), (10, "why and when, in what sequence"), (11, "root cause due to user method"), (12, ""),
]
#: Spellings of known names, which every tenth mention uses.
SPELLINGS = ["K8s", "Visual  Studio Code", "postgres", "PostgreSQL", "kubernetes", "VSCode", " PP ", "US Postal Service", "postgresq", "paypal.com"]
FEEDBACK_STEP = 3


def query(name: str, oracle: str | None = None, model: bool = True):
    """Registers a function of :class:`Tables` under ``name``, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLE_SQL[name] = (sql.MODEL if model else "") + oracle
        return f

    return keep


def session_of(t: Tables) -> DataFrame:
    return t.ledger.where(F.col("session_id") == SESSION)


def mentions(t: Tables) -> DataFrame:
    """(event_id, position, session_id, name, entity_type): what each event names, in several spellings: a part's name, now and then with a letter doubled, or a known service."""
    parts = t.read("part").select(F.col("p_partkey").cast("int").alias("k"), F.col("p_name").alias("part"))
    spelt = F.get(F.array(*[F.lit(x) for x in SPELLINGS]), F.floor(F.col("k") / 10).cast("int") % len(SPELLINGS))
    way = F.col("position") % 5
    name = F.when(way == 0, F.upper("part")).when(way == 1, F.concat(F.lit("  "), F.replace("part", F.lit(" "), F.lit("  ")))).when(way == 2, F.concat(F.left("part", F.lit(3)), F.substring("part", 3, 100))).otherwise(F.col("part"))
    kind = F.get(F.array(*[F.lit(x) for x in ENTITY_TYPES]), (F.col("k") % 6).cast("int"))
    return t.ledger.join(parts, "k").select("event_id", "position", "session_id", F.when(F.col("k") % 10 == 0, spelt).otherwise(name).alias("name"), kind.alias("entity_type"))


MENTIONS = f""", mentions AS (SELECT event_id, position, session_id, CASE WHEN k % 10 = 0 THEN {SPELLINGS}[(k // 10) % {len(SPELLINGS)} + 1] WHEN position % 5 = 0 THEN upper(p_name) WHEN position % 5 = 1 THEN '  ' || replace(p_name, ' ', '  ')
  WHEN position % 5 = 2 THEN left(p_name, 3) || substr(p_name, 3) ELSE p_name END AS name, {ENTITY_TYPES}[k % 6 + 1] AS entity_type FROM ledger JOIN part ON p_partkey = k)"""


# ---- ledger ----


@query("ledger_search", f"""SELECT event_id, session_id, event_type, occurred_us FROM ledger
  WHERE agent_id = 'a5' AND event_type = 'tool.execute' AND occurred_us BETWEEN {NOW_US - 1728000000000} AND {NOW_US} ORDER BY occurred_us, position LIMIT 50 OFFSET 5""")
def _(t):
    found = ledger.search(t.ledger, EventQuery(agent_id="a5", event_type="tool.execute", after_us=NOW_US - 1_728_000_000_000, before_us=NOW_US, limit=50, offset=5))
    return found.select("event_id", "session_id", "event_type", "occurred_us")


@query("event_by_id", """SELECT event_id, session_id, agent_id, trace_id, event_type, occurred_us, tool_name, importance_hint, parent_event_id, status
  FROM ledger WHERE event_id = '123'""")
def _(t):
    return t.ledger.where("event_id = '123'").select("event_id", "session_id", "agent_id", "trace_id", "event_type", "occurred_us", "tool_name", "importance_hint", "parent_event_id", "status")


@query("session_scan", f"SELECT event_id, occurred_us FROM ledger WHERE session_id = '{SESSION}' ORDER BY occurred_us, position LIMIT 20 OFFSET 10")
def _(t):
    return ledger.search(t.ledger, EventQuery(session_id=SESSION, limit=20, offset=10)).select("event_id", "occurred_us")


@query("ledger_count", "SELECT count(*) AS events FROM ledger")
def _(t):
    return t.ledger.agg(F.count("*").alias("events"))


@query("dedup_ingest", """SELECT event_id, arrival, payload FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS rn
  FROM (SELECT event_id, position AS arrival, 'first' AS payload FROM ledger UNION ALL SELECT event_id, position + 1000000000, 'again'
  FROM ledger WHERE position % 3 = 0)) WHERE rn = 1 AND NOT (arrival % 11 = 0)""")
def _(t):
    first = t.ledger.select("event_id", F.col("position").alias("arrival"), F.lit("first").alias("payload"))
    again = t.ledger.where("position % 3 = 0").select("event_id", (F.col("position") + 1_000_000_000).alias("arrival"), F.lit("again").alias("payload"))
    return ledger.append(t.ledger.where("position % 11 = 0"), first.unionByName(again))


def with_faults(t: Tables) -> DataFrame:
    """The ledger with faults put into known rows."""
    p = F.col("position")
    return t.ledger.select(
        "event_id", "position", F.when(p % 50 == 1, "Bad Type").otherwise(F.col("event_type")).alias("event_type"),
        F.when(p % 50 == 2, F.lit(NOW_US + 301_000_000)).otherwise(F.col("occurred_us")).alias("occurred_us"), F.when(p % 50 == 3, F.col("event_id")).otherwise(F.col("parent_event_id")).alias("parent_event_id"),
        F.when(p % 50 == 4, F.col("occurred_us") - 1).otherwise(F.lit(None).cast("long")).alias("ended_us"), F.when(p % 25 == 5, F.repeat(F.lit("x"), F.lit(2049))).otherwise("ref").alias("payload_ref"),
    )


FAULTS = f""", faulty AS (
  SELECT event_id, position, CASE WHEN position % 50 = 1 THEN 'event_type' END AS a, CASE WHEN position % 50 = 2 THEN 'occurred_at' END AS b, CASE WHEN position % 50 = 3 THEN 'parent_event_id' END AS c,
    CASE WHEN position % 50 = 4 THEN 'ended_at' END AS d, CASE WHEN position % 25 = 5 THEN 'payload_ref' END AS e FROM ledger)
"""


@query("validate_events", FAULTS + "SELECT event_id, concat_ws(',', a, b, c, d, e) AS errors FROM faulty WHERE concat_ws(',', a, b, c, d, e) <> ''")
def _(t):
    checked = ledger.errors(with_faults(t), NOW_US)
    return checked.where(F.size("errors") > 0).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("batch_accept_reject", FAULTS + """SELECT count(*) FILTER (concat_ws(',', a, b, c, d, e) = '') AS accepted, count(*) FILTER (concat_ws(',', a, b, c, d, e) <> '') AS rejected
  FROM faulty""")
def _(t):
    checked = ledger.errors(with_faults(t), NOW_US)
    return checked.agg(F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("rejected"))


@query("known_prefixes", """SELECT split_part(event_type, '.', 1) AS prefix, split_part(event_type, '.', 1) IN ('agent', 'tool', 'llm', 'observation', 'system', 'user') AS known, count(*) AS n
  FROM ledger GROUP BY ALL""")
def _(t):
    prefix = F.substring_index("event_type", ".", 1)
    return t.ledger.groupBy(prefix.alias("prefix"), ledger.known_prefix(F.col("event_type")).alias("known")).agg(F.count("*").alias("n"))


@query("newest_by_position", "SELECT event_id FROM ledger ORDER BY position DESC LIMIT 100")
def _(t):
    return ledger.newest(t.ledger, 100).select("event_id")


@query("json_documents", """SELECT event_id, CAST(json_extract_string(doc, '$.occurred_at_epoch_ms') AS BIGINT) AS ms, json_extract_string(doc, '$.tool_name') AS tool
  FROM (SELECT event_id, json_object('event_id', event_id, 'occurred_at_epoch_ms', occurred_us // 1000, 'tool_name', tool_name) AS doc
  FROM ledger)""")
def _(t):
    return to_json_lines(t.ledger).select("event_id", F.get_json_object("doc", "$.occurred_at_epoch_ms").cast("long").alias("ms"), F.get_json_object("doc", "$.tool_name").alias("tool"))


@query("date_partitions", "SELECT strftime(occurred_at, '%Y/%m/%d') AS day, count(*) AS n FROM ledger GROUP BY ALL")
def _(t):
    return t.ledger.groupBy(F.date_format("occurred_at", "yyyy/MM/dd").alias("day")).agg(F.count("*").alias("n"))


# ---- projection ----


@query("project_nodes", "SELECT event_id, event_type, session_id, importance_hint AS importance_score, position AS global_position FROM ledger")
def _(t):
    return projection.nodes(t.ledger).select("event_id", "event_type", "session_id", "importance_score", "global_position")


@query("follows_edges", "SELECT src, dst, session_id, delta_ms FROM follows")
def _(t):
    return projection.follows(t.ledger).drop("edge_type")


@query("caused_by_edges", "SELECT src, dst FROM caused")
def _(t):
    return projection.caused_by(t.ledger).select("src", "dst")


@query("replay_counts", "SELECT 'nodes' AS what, count(*) AS n FROM ledger UNION ALL SELECT edge_type, count(*) FROM edges GROUP BY edge_type")
def _(t):
    return t.ledger.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(projection.event_edges(t.ledger).groupBy(F.col("edge_type").alias("what")).agg(F.count("*").alias("n")))


@query("edges_with_endpoints", "SELECT src, dst, edge_type FROM edges WHERE CAST(src AS BIGINT) % 2 = 0 AND CAST(dst AS BIGINT) % 3 <> 0")
def _(t):
    ids = t.ledger.select(F.col("event_id").alias("id"), "position")
    return projection.with_endpoints(projection.event_edges(t.ledger), ids.where("position % 2 = 0").select("id"), ids.where("position % 3 <> 0").select("id")).select("src", "dst", "edge_type")


@query("enrich_keywords", """SELECT event_id, array_to_string(list_concat(string_split(event_type, '.'),
  CASE
  WHEN tool_name IS NULL THEN [] ELSE [tool_name] END), ',') AS keywords, coalesce(importance_hint, 5) AS importance_score, concat_ws(' ', event_type, tool_name, replace(event_type, '.', ' ')) AS embedding_text
  FROM ledger""")
def _(t):
    return projection.enriched(t.ledger)


@query("session_edges", f"""SELECT e.src, e.dst, e.edge_type FROM edges e JOIN (SELECT event_id
  FROM ledger WHERE session_id = '{SESSION}' ORDER BY occurred_us DESC, position DESC LIMIT 20) a ON a.event_id = e.src
  JOIN (SELECT event_id FROM ledger WHERE session_id = '{SESSION}' ORDER BY occurred_us DESC, position DESC LIMIT 20) b ON b.event_id = e.dst""")
def _(t):
    ids = retrieval.context(t.ledger, SESSION, 20, NOW_US).select(F.col("event_id").alias("id"))
    return projection.among(projection.event_edges(session_of(t)), ids).select("src", "dst", "edge_type")


# ---- aggregates ----


@query("session_counts", "SELECT session_id, count(*) AS events FROM ledger GROUP BY ALL")
def _(t):
    return t.ledger.groupBy("session_id").agg(F.count("*").alias("events"))


@query("graph_stats", "SELECT t.edge_type, count(e.src) AS n FROM (VALUES " + ", ".join(f"('{e}')" for e in EDGE_TYPES) + """) AS t(edge_type)
  LEFT JOIN (SELECT src, edge_type FROM edges UNION ALL SELECT src, 'REFERENCES' FROM refs) e USING (edge_type)
  GROUP BY ALL""")
def _(t):
    every = t.spark.createDataFrame([(e,) for e in EDGE_TYPES], "edge_type string")
    counts = projection.event_edges(t.ledger).unionByName(t.references).groupBy("edge_type").agg(F.count("*").alias("n"))
    return every.join(counts, "edge_type", "left").select("edge_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("type_histogram", "SELECT event_type, status, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ledger GROUP BY ALL")
def _(t):
    return t.ledger.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("agent_rollup", "SELECT agent_id, event_type, count(*) AS n FROM ledger GROUP BY ROLLUP (agent_id, event_type)")
def _(t):
    return t.ledger.rollup("agent_id", "event_type").agg(F.count("*").alias("n"))


@query("entity_overlap", """SELECT dst AS entity_id, count(DISTINCT session_id) AS sessions FROM refs
  JOIN ledger ON event_id = src GROUP BY ALL HAVING count(DISTINCT session_id) > 1""")
def _(t):
    return t.references.join(t.ledger.select("event_id", "session_id"), F.col("src") == F.col("event_id")).groupBy(F.col("dst").alias("entity_id")).agg(F.countDistinct("session_id").alias("sessions")).where("sessions > 1")


@query("top_entities_by_degree", "SELECT dst AS entity_id, count(*) AS degree FROM refs GROUP BY ALL ORDER BY degree DESC, entity_id LIMIT 20")
def _(t):
    return t.references.groupBy(F.col("dst").alias("entity_id")).agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "entity_id").limit(20)


@query("preference_histogram", """SELECT split_part(event_type, '.', 1) AS category, CASE
  WHEN value > 50 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n FROM ledger
  GROUP BY ALL""")
def _(t):
    return users.preferences(t.ledger).groupBy("category", "polarity").agg(F.count("*").alias("n"))


@query("degenerate_output", """SELECT trace_id, count(*) AS n, count(*) >= 3 AND stddev_pop(0.5 + value / 1000) < 0.02 AS degenerate
  FROM ledger GROUP BY ALL""")
def _(t):
    """Confidences of what a day's events of a user would give."""
    return resolution.degenerate(t.ledger.withColumn("confidence", 0.5 + F.col("value") / 1000), "trace_id", "confidence")


# ---- scores ----


@query("recency_score", f"""SELECT event_id, round({sql.RECENCY}, 6) AS recency, round(exp(-greatest(0.0, {sql.HOURS}) / (168.0::DOUBLE + access_count * 24.0::DOUBLE)), 6) AS linear
  FROM ledger""")
def _(t):
    return t.ledger.select("event_id", F.round(scoring.recency(F.col("occurred_us"), F.col("last_accessed_us"), F.col("access_count"), NOW_US), 6).alias("recency"), F.round(scoring.recency_linear(F.col("occurred_us"), F.col("access_count"), NOW_US), 6).alias("linear"))


@query("importance_score", f"""SELECT event_id, round({sql.importance('importance_hint', 'access_count', 'coalesce(d.n, 0)')}, 6) AS importance
  FROM ledger LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY ALL) d ON d.dst = event_id""")
def _(t):
    degree = graph.in_degree(projection.event_edges(t.ledger))
    joined = t.ledger.join(degree, F.col("event_id") == F.col("id"), "left")
    return joined.select("event_id", F.round(scoring.importance(F.col("importance_hint"), F.col("access_count"), F.coalesce("in_degree", F.lit(0))), 6).alias("importance"))


@query("relevance_score", """SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE))
  FROM embeddings WHERE vec_id = 7)))), 6) AS relevance FROM embeddings""", model=False)
def _(t):
    e = t.read("embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(q)).select("vec_id", F.round(scoring.relevance(F.col("embedding"), F.col("q")), 6).alias("relevance"))


@query("composite_score", f"""SELECT event_id, round({sql.RECENCY}, 6) AS recency, 0.5 AS relevance, coalesce(importance_hint, CAST(round_even(({sql.IMPORTANCE}) * 10, 0) AS INTEGER)) AS importance, round({sql.DECAY}, 6) AS decay
  FROM ledger""")
def _(t):
    return retrieval.scored_events(t.ledger, NOW_US).select("event_id", "recency", "relevance", "importance", "decay")


@query("entity_score", f"""SELECT entity_id, round(r, 6) AS recency, round(i, 6) AS importance, round((r + i + 0.5) / 3.5, 6) AS decay
  FROM (SELECT entity_id, {sql.recency('last_seen_us', 'NULL', 'mention_count', 336.0, 24.0)} AS r, {sql.importance('least(mention_count, 10)', 'mention_count')} AS i
  FROM entities)""")
def _(t):
    return retrieval.scored_entities(t.entities, NOW_US)


@query("user_affinity", """SELECT event_id, round(greatest(0.0, least(1.0, 0.4 * value / 100 + 0.3 * (access_count / 5.0) + 0.3 * (k / 100.0))), 6) AS affinity
  FROM ledger""")
def _(t):
    return t.ledger.select("event_id", F.round(scoring.user_affinity(F.col("value") / 100, F.col("access_count") / 5.0, F.col("k") / 100.0), 6).alias("affinity"))


@query("decay_curve", """SELECT event_id, d AS day, round(0.8 * exp(-(0.1 + (10 - importance_hint) * 0.05) * d), 6) AS score
  FROM ledger, range(8) AS r(d) WHERE importance_hint IS NOT NULL""")
def _(t):
    days = t.ledger.where("importance_hint IS NOT NULL").select("event_id", "importance_hint", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("day"))
    return days.select("event_id", "day", F.round(0.8 * F.exp(-(0.1 + (10 - F.col("importance_hint")) * 0.05) * F.col("day")), 6).alias("score"))


# ---- context and pages ----


@query("context_scored", f"""SELECT event_id, decay, row_number() OVER (ORDER BY decay DESC, position) AS rank
  FROM (SELECT event_id, position, round({sql.DECAY}, 6) AS decay FROM ledger WHERE session_id = '{SESSION}' ORDER BY occurred_us DESC, position DESC LIMIT 20)""")
def _(t):
    return retrieval.ranked(retrieval.context(t.ledger, SESSION, 20, NOW_US), F.col("decay").desc(), F.col("position")).select("event_id", "decay", F.col("rank").cast("long").alias("rank"))


@query("context_page2", f"SELECT event_id, occurred_us FROM ledger WHERE session_id = '{SESSION}' ORDER BY occurred_us DESC, position DESC LIMIT 10 OFFSET 10")
def _(t):
    last = session_of(t).orderBy(F.col("occurred_us").desc(), F.col("position").desc()).limit(10).orderBy("occurred_us", "position").first()
    return ledger.page_after(session_of(t), last["occurred_us"], last["event_id"], 10).select("event_id", "occurred_us")


@query("cursor_roundtrip", f"""SELECT event_id, translate(to_base64(encode(occurred_us || '|' || event_id)), '+/', '-_') AS cursor, occurred_us AS us, event_id AS id
  FROM ledger WHERE session_id = '{SESSION}'""")
def _(t):
    made = session_of(t).select("event_id", text.cursor(F.col("occurred_us"), F.col("event_id")).alias("cursor"))
    return made.withColumn("p", text.cursor_parts(F.col("cursor"))).select("event_id", "cursor", "p.us", F.col("p.event_id").alias("id"))


# ---- lineage and seeds ----


LINEAGE = """, walk(start, node, depth) AS (
  SELECT src, dst, 1 FROM caused
  UNION ALL SELECT w.start, c.dst, w.depth + 1 FROM walk w JOIN caused c ON c.src = w.node WHERE w.depth < 10)
"""


@query("lineage_paths", LINEAGE + "SELECT start, node AS ancestor, depth FROM walk")
def _(t):
    return graph.lineage(projection.caused_by(t.ledger), t.ledger.select(F.col("event_id").alias("id")), 10)


@query("lineage_depth_hist", LINEAGE + "SELECT depth, count(*) AS n FROM walk GROUP BY depth")
def _(t):
    return graph.lineage(projection.caused_by(t.ledger), t.ledger.select(F.col("event_id").alias("id")), 10).groupBy("depth").agg(F.count("*").alias("n"))


@query("seed_causal_roots", f"""SELECT event_id AS id, row_number() OVER (ORDER BY n DESC, position) AS rank
  FROM (SELECT l.event_id, l.position, count(*) AS n FROM ledger l JOIN caused c ON c.dst = l.event_id
  WHERE l.session_id = '{SESSION}' GROUP BY ALL) ORDER BY rank LIMIT 10""")
def _(t):
    return retrieval.causal_roots(session_of(t), projection.event_edges(session_of(t)), 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("seed_entity_hubs", f"""SELECT dst AS id, row_number() OVER (ORDER BY count(*) DESC, dst) AS rank
  FROM refs JOIN ledger ON event_id = src WHERE session_id = '{SESSION}' GROUP BY dst ORDER BY rank LIMIT 10""")
def _(t):
    return retrieval.entity_hubs(session_of(t), t.references, 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("seed_temporal_anchors", f"""SELECT event_id AS id, row_number() OVER (ORDER BY importance_hint DESC, occurred_us, position) AS rank
  FROM ledger WHERE session_id = '{SESSION}' AND importance_hint IS NOT NULL ORDER BY rank LIMIT 10""")
def _(t):
    return retrieval.temporal_anchors(session_of(t), 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("seed_workflow", f"""SELECT event_id AS id, row_number() OVER (ORDER BY occurred_us, position) AS rank
  FROM ledger WHERE session_id = '{SESSION}' AND event_type LIKE 'tool.%' ORDER BY rank LIMIT 10""")
def _(t):
    return retrieval.workflow_pattern(session_of(t), 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("seed_user_profile", f"""SELECT event_id AS id, row_number() OVER (ORDER BY occurred_us DESC, position DESC) AS rank
  FROM ledger WHERE session_id = '{SESSION}' AND k IN (SELECT k FROM entities WHERE mention_count > (SELECT avg(mention_count)
  FROM entities)) ORDER BY rank LIMIT 10""")
def _(t):
    mean = t.entities.agg(F.avg("mention_count").alias("mean"))  # one row
    linked = t.entities.join(F.broadcast(mean)).where("mention_count > mean").select("k")
    top = session_of(t).join(linked, "k", "left_semi").orderBy(F.col("occurred_us").desc(), F.col("position").desc()).limit(10)
    return retrieval.ranked(top, F.col("occurred_us").desc(), F.col("position").desc()).select(F.col("event_id").alias("id"), F.col("rank").cast("long").alias("rank"))


SIMILAR = f""", sims AS (SELECT x.event_id AS src, y.event_id AS dst, p.similarity FROM pairs p
  JOIN ledger x ON x.k = CAST(substr(p.a, 8) AS INTEGER) JOIN ledger y ON y.k = CAST(substr(p.b, 8) AS INTEGER) AND y.session_id = x.session_id
  WHERE p.similarity > 0.85)"""


#: Where the classes of similar entities of an application, a folder and its files as they were are stored, and from which similarity on.
PAIRS: dict[tuple, tuple[DataFrame, DataFrame]] = {}
LEAST_SIMILAR = 0.75


def entity_classes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Similar entities as :func:`vectors.similar_classes` gives them. Stored once as long as the vectors' files stay as they are."""
    key = (t.spark.sparkContext.applicationId, t.folder, *t.version("embeddings"))
    if key not in PAIRS:
        near, several = vectors.similar_classes(t.entity_vectors.select(F.col("k").alias("id"), "vector"), LEAST_SIMILAR)
        PAIRS[key] = graph.cut(near), graph.cut(several)
    return PAIRS[key]


def entity_pairs(t: Tables, threshold: float, copies: bool = True) -> DataFrame:
    """(a, b, similarity) of entities that are alike; a has the smaller number. Without ``copies``, entities of equal vectors are linked to one of them alone."""
    near, several = entity_classes(t)
    near = near.where(F.col("similarity") >= threshold)
    found = vectors.all_pairs(near, several) if copies else vectors.linked(near, several)
    return found.select(F.concat(F.lit("entity:"), "a").alias("a"), F.concat(F.lit("entity:"), "b").alias("b"), "similarity")


def similar_events(t: Tables, events: DataFrame) -> DataFrame:
    """SIMILAR_TO edges between events of one session whose entities are alike."""
    near = entity_pairs(t, 0.85).where("similarity > 0.85").select(F.split_part("a", F.lit(":"), F.lit(2)).cast("int").alias("ka"), F.split_part("b", F.lit(":"), F.lit(2)).cast("int").alias("kb"), "similarity")
    x = events.select(F.col("event_id").alias("src"), F.col("k").alias("ka"), "session_id")
    y = events.select(F.col("event_id").alias("dst"), F.col("k").alias("kb"), "session_id")
    return x.join(near, "ka").join(y, ["session_id", "kb"]).select("src", "dst", F.lit("SIMILAR_TO").alias("edge_type"), "similarity")


@query("similar_to_edges", SIMILAR + "SELECT src, dst, similarity FROM sims")
def _(t):
    return similar_events(t, t.ledger).select("src", "dst", "similarity")


@query("seed_similar_cluster", SIMILAR + f"""SELECT event_id AS id, row_number() OVER (ORDER BY count(*) DESC, position) AS rank
  FROM ledger JOIN (SELECT src AS e FROM sims UNION ALL SELECT dst FROM sims) ON e = event_id
  WHERE session_id = '{SESSION}' GROUP BY event_id, position ORDER BY rank LIMIT 10""")
def _(t):
    return retrieval.similar_cluster(session_of(t), similar_events(t, session_of(t)), 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("neighbors_batch", f"""SELECT s.event_id AS seed, e.dst, e.edge_type FROM ledger s LEFT JOIN edges e ON e.src = s.event_id
  WHERE s.session_id = '{SESSION}'""")
def _(t):
    return graph.neighbours(projection.event_edges(t.ledger), session_of(t).select(F.col("event_id").alias("id"))).select("seed", "dst", "edge_type")


@query("entity_events", """SELECT entity_id, event_id, occurred_us
  FROM (SELECT dst AS entity_id, event_id, occurred_us, row_number() OVER (PARTITION BY dst ORDER BY occurred_us DESC, position DESC) AS rn
  FROM refs JOIN ledger ON event_id = src) WHERE rn <= 5""")
def _(t):
    from pyspark.sql import Window

    joined = t.references.join(t.ledger, F.col("src") == F.col("event_id"))
    rn = F.row_number().over(Window.partitionBy("dst").orderBy(F.col("occurred_us").desc(), F.col("position").desc()))
    return joined.withColumn("rn", rn).where("rn <= 5").select(F.col("dst").alias("entity_id"), "event_id", "occurred_us")


@query("cross_session_bridge", f"""SELECT event_id, session_id, dst AS entity_id FROM ledger JOIN refs ON src = event_id
  WHERE session_id <> '{SESSION}' AND dst IN (SELECT r.dst FROM refs r JOIN ledger l ON l.event_id = r.src
  WHERE l.session_id = '{SESSION}') ORDER BY occurred_us DESC, position DESC LIMIT 20""")
def _(t):
    return retrieval.bridges(session_of(t), t.ledger, t.references, SESSION, 100).select("event_id", "session_id", "entity_id")


# ---- intents, fusion, text, vectors ----


def questions(t: Tables) -> DataFrame:
    """(qid, text): each turn of the conversations, opened by one of the questions."""
    asked = F.get(F.array(*[F.lit(q) for _, q in QUESTIONS]), ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS)).cast("int"))
    return t.read("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(asked, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


ASKED_SQL = "SELECT conv_id || '-' || turn AS qid, [" + ", ".join("'" + q.replace("'", "''") + "'" for _, q in QUESTIONS) + f"][(conv_id + turn) % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '') AS text FROM conversations"
INTENT_SQL = f"""
WITH q AS ({ASKED_SQL}), lex AS (SELECT * FROM (VALUES {sql.INTENT_ROWS}) AS v(ordinal, intent, word)),
h AS (SELECT qid, ordinal, intent, count(*) AS hits FROM q JOIN lex ON regexp_matches(lower(text), '\\b' || word || '\\b') GROUP BY ALL),
found AS (SELECT qid, ordinal, intent, least(1.0::DOUBLE, hits * 0.4::DOUBLE) / max(least(1.0::DOUBLE, hits * 0.4::DOUBLE)) OVER (PARTITION BY qid) AS confidence FROM h
  UNION ALL SELECT qid, 7, 'general', 0.5::DOUBLE FROM q WHERE qid NOT IN (SELECT qid FROM h))
"""


@query("intent_classify", INTENT_SQL + "SELECT qid, intent, round(confidence, 4) AS confidence FROM found", model=False)
def _(t):
    return retrieval.intents(questions(t)).select("qid", "intent", F.round("confidence", 4).alias("confidence"))


@query("intent_of_documents", INTENT_SQL.replace(ASKED_SQL, "SELECT doc_id AS qid, text FROM documents") + "SELECT intent, count(*) AS n FROM found GROUP BY ALL", model=False)
def _(t):
    return retrieval.intents(t.read("documents").select(F.col("doc_id").alias("qid"), "text")).groupBy("intent").agg(F.count("*").alias("n"))


@query("edge_weights", INTENT_SQL + f"""SELECT qid, edge_type, round(sum(confidence * w), 6) AS weight
  FROM found JOIN (VALUES {sql.WEIGHT_ROWS}) AS m(intent, edge_type, w) USING (intent) GROUP BY ALL""", model=False)
def _(t):
    return retrieval.edge_weights(retrieval.intents(questions(t))).select("qid", "edge_type", F.round("weight", 6).alias("weight"))


@query("seed_strategy", INTENT_SQL + f"""SELECT qid, intent, strategy
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, ordinal) AS rn
  FROM found) JOIN (VALUES {sql.STRATEGY_ROWS}) AS s(intent, strategy) USING (intent) WHERE rn = 1""", model=False)
def _(t):
    return retrieval.strategies(retrieval.intents(questions(t)))


@query("rrf_fusion", f"""SELECT id, round(sum(1 / (60 + rank)), 9) AS rrf
  FROM (SELECT event_id AS id, row_number() OVER (ORDER BY occurred_us DESC, position DESC) AS rank
  FROM ledger WHERE session_id = '{SESSION}' UNION ALL SELECT event_id, row_number() OVER (ORDER BY importance_hint DESC, occurred_us, position)
  FROM ledger WHERE session_id = '{SESSION}' AND importance_hint IS NOT NULL) GROUP BY id""")
def _(t):
    newest = retrieval.ranked(session_of(t), F.col("occurred_us").desc(), F.col("position").desc()).select(F.col("event_id").alias("id"), "rank")
    return retrieval.fused(newest.unionByName(retrieval.temporal_anchors(session_of(t), 1000).select("id", "rank"))).select("id", F.round("rrf", 9).alias("rrf"))


BM25_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) WHERE term IN ({", ".join(repr(x) for x in TERMS)}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 5) AS score
FROM tf JOIN df USING (term), stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
"""


@query("bm25_topk", BM25_SQL, model=False)
def _(t):
    return retrieval.bm25(t.read("documents").select(F.col("doc_id").alias("id"), "text"), TERMS, 20).select(F.col("id").alias("doc_id"), "score")


@query("token_frequencies", """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents)
  WHERE term <> '' GROUP BY ALL) GROUP BY term""", model=False)
def _(t):
    p = retrieval.postings(t.read("documents").select(F.col("doc_id").alias("id"), "text"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("vector_topk", """SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS similarity
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= 10""", model=False)
def _(t):
    e = t.read("embeddings")
    found = vectors.vector_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 10, -1.0)
    return found.select("qid", "id", "similarity")


@query("entity_vector_seeds", """SELECT q.entity_id AS qid, e.entity_id AS id, round(list_cosine_similarity(e.vector, q.vector), 6) AS similarity
  FROM evec e JOIN evec q ON q.k % 50 = 0 WHERE round(list_cosine_similarity(e.vector, q.vector), 6) >= 0.5
  QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY similarity DESC, e.entity_id) <= 10""")
def _(t):
    v = t.entity_vectors
    found = vectors.vector_search(v.select(F.col("entity_id").alias("id"), "vector"), v.where("k % 50 = 0").select(F.col("entity_id").alias("qid"), F.col("vector").alias("q")), 10, 0.5)
    return found.select("qid", "id", "similarity")


@query("mmr_rerank")
def _(t):
    v = t.entity_vectors
    seeds = v.where("k % 50 = 0").select(F.col("entity_id").alias("qid"), F.col("vector").alias("q"))
    near = vectors.vector_search(v.select(F.col("entity_id").alias("id"), "vector"), seeds, 20, -1.0)
    return retrieval.mmr(near.join(v.select(F.col("entity_id").alias("id"), "vector"), "id").select("qid", "id", F.col("similarity").alias("relevance"), "vector"), 10)


# ---- graph ----


def ppr_sql(rounds: int) -> str:
    out = f""", own AS (SELECT event_id FROM ledger WHERE session_id = '{SESSION}'), adj AS (
  SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 2.0::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, 2.0::DOUBLE FROM edges) WHERE src IN (SELECT event_id FROM own) GROUP BY ALL),
outs AS (SELECT src, sum(w) AS o FROM adj GROUP BY ALL), share AS (SELECT src, dst, w / o AS p FROM adj JOIN outs USING (src)),
seeds AS (SELECT event_id AS id FROM ledger WHERE session_id = '{SESSION}' ORDER BY position DESC LIMIT 3),
r0 AS (SELECT id, CASE WHEN id IN (SELECT id FROM seeds) THEN 1 / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS restart, CASE WHEN id IN (SELECT id FROM seeds) THEN 1 / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT DISTINCT src AS id FROM adj))
"""
    for k in range(1, rounds + 1):
        out += f""", u{k} AS (SELECT r.id, r.restart, 0.85 * coalesce(m.moved, 0) + 0.15 * r.restart AS raw FROM r{k - 1} r LEFT JOIN (SELECT dst, sum(score * p) AS moved FROM r{k - 1} JOIN share ON src = id GROUP BY dst) m ON m.dst = r.id),
r{k} AS (SELECT id, restart, raw / (SELECT sum(raw) FROM u{k}) AS score FROM u{k})
"""
    return out


def pagerank(t: Tables) -> DataFrame:
    seeds = session_of(t).orderBy(F.col("position").desc()).limit(3).select(F.col("event_id").alias("id"))
    return graph.personalised_pagerank(graph.weighted_both_ways(projection.event_edges(session_of(t))), seeds)


@query("ppr_5iter", ppr_sql(5) + "SELECT id, round(score, 6) AS score FROM r5")
def _(t):
    return pagerank(t).select("id", F.round("score", 6).alias("score"))


@query("ppr_blend", ppr_sql(5) + f"""SELECT id, round(CASE WHEN (SELECT count(*) FROM r5) > 500 THEN {sql.DECAY} ELSE 0.7 * {sql.DECAY} + 0.3 * greatest(0.0, least(1.0, score * (SELECT count(*)
  FROM r5))) END, 5) AS decay FROM r5 JOIN ledger ON event_id = id""")
def _(t):
    ranks = pagerank(t)
    raw = scoring.composite(scoring.recency(F.col("occurred_us"), F.col("last_accessed_us"), F.col("access_count"), NOW_US), scoring.importance(F.col("importance_hint"), F.col("access_count"), F.lit(0)), F.lit(0.5), F.lit(0.0))
    nodes = session_of(t).select(F.col("event_id").alias("id"), raw.alias("decay")).join(ranks.select("id"), "id", "left_semi")
    return retrieval.blended(nodes, ranks).select("id", F.round("decay", 5).alias("decay"))


COMPONENTS = """, same AS (SELECT a, b FROM pairs WHERE similarity >= 0.9), both_ways AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
comp AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
"""


def same_as(t: Tables, copies: bool = False) -> DataFrame:
    """Entities that are the same; components are theirs with or without ``copies``."""
    return entity_pairs(t, 0.9, copies).select("a", "b")


@query("same_as_components", COMPONENTS + """SELECT c.id, c.component, first_value(c.id) OVER (PARTITION BY c.component ORDER BY coalesce(e.mention_count, 0) DESC, c.id) AS canonical
  FROM comp c LEFT JOIN entities e ON e.entity_id = c.id""")
def _(t):
    return graph.canonical_members(same_as(t), t.entities.select(F.col("entity_id").alias("id"), "mention_count"))


@query("same_as_stars", COMPONENTS + """,
  canon AS (SELECT c.id, first_value(c.id) OVER (PARTITION BY c.component ORDER BY coalesce(e.mention_count, 0) DESC, c.id) AS canonical
  FROM comp c LEFT JOIN entities e ON e.entity_id = c.id) SELECT id AS src, canonical AS dst
  FROM canon WHERE id <> canonical""")
def _(t):
    found = graph.canonical_members(same_as(t), t.entities.select(F.col("entity_id").alias("id"), "mention_count"))
    return found.where("id != canonical").select(F.col("id").alias("src"), F.col("canonical").alias("dst"))


@query("entity_cluster_3hop", COMPONENTS + """, h1 AS (SELECT entity_id AS start, entity_id AS id
  FROM entities), h2 AS (SELECT * FROM h1 UNION SELECT h1.start, e.b FROM h1 JOIN both_ways e ON e.a = h1.id),
  h3 AS (SELECT * FROM h2 UNION SELECT h2.start, e.b FROM h2 JOIN both_ways e ON e.a = h2.id),
  h4 AS (SELECT * FROM h3 UNION SELECT h3.start, e.b FROM h3
  JOIN both_ways e ON e.a = h3.id) SELECT start, count(DISTINCT h4.id) AS members, count(src) AS events
  FROM h4 LEFT JOIN refs ON dst = h4.id GROUP BY start""")
def _(t):
    reached = graph.cluster_within(same_as(t, copies=True), t.entities.select(F.col("entity_id").alias("id")))
    return reached.join(t.references, reached["id"] == F.col("dst"), "left").groupBy("start").agg(F.countDistinct("id").alias("members"), F.count("src").alias("events"))


@query("centrality_importance", """SELECT event_id AS id, n AS in_degree, CASE WHEN n >= 10 THEN 10
  WHEN n >= 5 THEN 8 WHEN n >= 3 THEN 6 ELSE coalesce(importance_hint, 5) END AS importance_score
  FROM ledger JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) ON dst = event_id""")
def _(t):
    return graph.centrality_importance(t.ledger.select(F.col("event_id").alias("id"), F.col("importance_hint").alias("importance_score")), projection.event_edges(t.ledger))


@query("multi_hop_expansion", f""", s AS (SELECT event_id AS id, 1.0::DOUBLE AS score FROM ledger
  WHERE session_id = '{SESSION}' ORDER BY position DESC LIMIT 5), e AS (SELECT src, dst, least(1.0::DOUBLE, (CASE edge_type
  WHEN 'CAUSED_BY' THEN 5.0 ELSE 1.0 END)::DOUBLE / 5) * 0.5::DOUBLE AS f FROM edges), a AS (SELECT dst AS id, max(score * f) AS score
  FROM s JOIN e ON src = id GROUP BY dst), b AS (SELECT dst AS id, max(score * f) AS score FROM a
  JOIN e ON src = id GROUP BY dst) SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM s
  UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def _(t):
    weight = F.when(F.col("edge_type") == "CAUSED_BY", 5.0).otherwise(1.0).alias("w")
    seeds = session_of(t).orderBy(F.col("position").desc()).limit(5).select(F.col("event_id").alias("id"), F.lit(1.0).alias("score"))
    return graph.expanded(projection.event_edges(session_of(t)).select("src", "dst", weight), seeds).select("id", F.round("score", 6).alias("score"))


WHY = "why did this happen, because of what"
#: The weights of that question: both key words of why give it 0.8, that of what 0.4, half as much.
WHY_WEIGHTS = {e: w + 0.5 * INTENT_WEIGHTS["what"][e] for e, w in INTENT_WEIGHTS["why"].items()}
BEST = "ORDER BY decay DESC, length(id), id"
ENTITY_DECAY = f"({sql.recency('last_seen_us', 'NULL', 'mention_count', 336.0, 24.0)} + {sql.importance('least(mention_count, 10)', 'mention_count')} + 0.5) / 3.5"
SUBGRAPH = SIMILAR + f""", own AS (SELECT * FROM ledger WHERE session_id = '{SESSION}'), recent AS (SELECT event_id AS id, row_number() OVER (ORDER BY occurred_us DESC, position DESC) AS rank FROM own ORDER BY rank LIMIT 10),
causes AS (SELECT event_id AS id, row_number() OVER (ORDER BY n DESC, position) AS rank FROM (SELECT o.event_id, o.position, count(*) AS n FROM own o JOIN caused c ON c.dst = o.event_id GROUP BY ALL) ORDER BY rank LIMIT 10),
start AS (SELECT id FROM (SELECT id, sum(1 / (60 + rank)) AS rrf FROM (SELECT * FROM recent UNION ALL SELECT * FROM causes) GROUP BY id) ORDER BY rrf DESC, id LIMIT 10),
led AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_type, dst) AS rn FROM (SELECT src, dst, edge_type FROM edges UNION ALL SELECT src, dst, 'SIMILAR_TO' FROM sims UNION ALL SELECT src, dst, 'REFERENCES' FROM refs) WHERE src IN (SELECT id FROM start)) WHERE rn <= 50 AND src <> dst),
near AS (SELECT dst AS id, arg_min(struct_pack(w := w, s := s), (-w, edge_type)) AS b FROM led JOIN (VALUES {", ".join(f"('{e}', {w}::DOUBLE, '{PROACTIVE_SIGNALS[e]}')" for e, w in WHY_WEIGHTS.items())}) AS v(edge_type, w, s) USING (edge_type) WHERE dst NOT IN (SELECT id FROM start) GROUP BY dst),
scored AS (SELECT event_id AS id, 'Event' AS node_type, round({sql.DECAY}, 6) AS decay FROM ledger UNION ALL SELECT entity_id, 'Entity', round({ENTITY_DECAY}, 6) FROM entities),
every AS (SELECT id, node_type, 'seed' AS source, NULL::VARCHAR AS signal, decay FROM scored JOIN start USING (id) UNION ALL SELECT id, node_type, 'proactive', b.s, round(least(1.0, decay * (1 + b.w * 0.1)), 6) FROM scored JOIN near USING (id)),
top AS (SELECT *, row_number() OVER ({BEST}) AS rank FROM every {BEST} LIMIT 60)
"""


def flagship(t: Tables, per_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    q = SubgraphQuery(WHY, SESSION, max_nodes=60)
    return retrieval.subgraph(t.ledger, t.references, similar_events(t, session_of(t)), q, NOW_US, entities=t.entities, per_seed=per_seed)


@query("subgraph_flagship", SUBGRAPH + "SELECT id, node_type, source, signal, decay, CAST(rank AS INTEGER) AS rank FROM top")
def _(t):
    return flagship(t, 50)[0]


#: Along all edges of a seed.
WHOLE_SUBGRAPH = SUBGRAPH.replace("WHERE rn <= 50 AND src <> dst", "WHERE src <> dst")


@query("subgraph_edges", WHOLE_SUBGRAPH + "SELECT DISTINCT src, dst, edge_type FROM led WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def _(t):
    return flagship(t)[1]


CURSOR = "translate(to_base64(encode(occurred_us || '|' || event_id)), '+/', '-_')"


@query("context_response", f""", own AS (SELECT *, row_number() OVER (ORDER BY occurred_us DESC, position DESC) AS rn FROM ledger WHERE session_id = '{SESSION}'), page AS (SELECT * FROM own WHERE rn <= 20), d AS (SELECT event_id AS id, position, round({sql.DECAY}, 6) AS decay FROM page)
SELECT 'node' AS kind, id, decay, row_number() OVER (ORDER BY decay DESC, position) AS rank, NULL AS src, NULL AS dst, NULL AS edge_type, NULL AS has_more FROM d
UNION ALL SELECT DISTINCT 'edge', NULL, NULL, NULL, src, dst, edge_type, NULL FROM edges WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)
UNION ALL SELECT 'page', {CURSOR}, NULL, NULL, NULL, NULL, NULL, (SELECT count(*) FROM own) > 20 FROM page WHERE rn = 20""")
def _(t):
    return retrieval.context_response(t.ledger, SESSION, 20, NOW_US)


# ---- consolidation ----

EPISODES = """, ep AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY occurred_us, position ROWS UNBOUNDED PRECEDING) AS episode
  FROM (SELECT *, CASE
  WHEN occurred_us - lag(occurred_us) OVER (PARTITION BY session_id ORDER BY occurred_us, position) > 1800000000 THEN 1 ELSE 0 END AS starts
  FROM ledger))"""
SUMMARY = "left(sha256(string_agg(event_id, '|' ORDER BY event_id)), 12) AS summary_id, count(*) AS event_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types, min(occurred_us) AS start_us, max(occurred_us) AS end_us, count(*) || ' events (' || array_to_string(list_sort(list(DISTINCT event_type)), ',') || ') from ' || strftime(min(occurred_at), '%Y-%m-%dT%H:%M:%S.%f') || ' to ' || strftime(max(occurred_at), '%Y-%m-%dT%H:%M:%S.%f') AS content"


@query("episodes", EPISODES + "SELECT event_id, session_id, CAST(episode AS BIGINT) AS episode FROM ep")
def _(t):
    return consolidation.episodes(t.ledger).select("event_id", "session_id", "episode")


@query("episode_summaries", EPISODES + f"""SELECT 'episode' AS scope, session_id, CAST(episode AS BIGINT) AS episode, {SUMMARY}
  FROM ep GROUP BY session_id, episode""")
def _(t):
    return consolidation.summaries(consolidation.episodes(t.ledger), "episode", ["session_id", "episode"])


@query("session_summaries", f"SELECT 'session' AS scope, session_id, {SUMMARY} FROM ledger GROUP BY session_id")
def _(t):
    return consolidation.summaries(t.ledger, "session", ["session_id"])


#: The id of groups without a bound: a digest that adds up.
LOOSE_SUMMARY = SUMMARY.replace(
    "left(sha256(string_agg(event_id, '|' ORDER BY event_id)), 12)",
    "left(sha256(bit_xor(CAST('0x' || left(md5(event_id), 15) AS BIGINT)) || '|' || CAST(sum(CAST('0x' || substr(md5(event_id), 16, 8) AS BIGINT)) AS BIGINT) || '|' || count(*)), 12)",
)


@query("agent_summaries", f"SELECT 'agent' AS scope, agent_id, {LOOSE_SUMMARY} FROM ledger GROUP BY agent_id")
def _(t):
    return consolidation.summaries(t.ledger, "agent", ["agent_id"], bounded=False)


@query("reconsolidate_candidates", "SELECT session_id, count(*) AS events FROM ledger GROUP BY ALL HAVING count(*) * 5 >= 350")
def _(t):
    return consolidation.qualifying(t.ledger, 350)


@query("reflection_points", """SELECT event_id, session_id, total
  FROM (SELECT event_id, session_id, coalesce(importance_hint, 5) AS i, CAST(sum(coalesce(importance_hint, 5)) OVER (PARTITION BY session_id ORDER BY occurred_us, position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
  FROM ledger) WHERE total // 150 > (total - i) // 150""")
def _(t):
    return consolidation.reflection_points(t.ledger)


@query("extraction_triggers", """SELECT session_id, event_id, turn
  FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_us, position) AS turn
  FROM ledger WHERE event_type NOT LIKE 'system.%') WHERE turn % 25 = 0""")
def _(t):
    return consolidation.extraction_triggers(t.ledger, 25).select("session_id", "event_id", F.col("turn").cast("long").alias("turn"))


@query("transcript", """SELECT conv_id, string_agg('[Turn ' || turn || '] ' || role || ': ' || left(text, 500), chr(10) ORDER BY turn) AS transcript
  FROM conversations GROUP BY conv_id""", model=False)
def _(t):
    return consolidation.transcript(t.read("conversations"))


# ---- retention ----


@query("retention_tiers", f"SELECT {sql.tier(480)} AS tier, count(*) AS n FROM ledger GROUP BY ALL")
def _(t):
    return t.ledger.groupBy(retention.tier(NOW_US, Retention(cold=480)).alias("tier")).agg(F.count("*").alias("n"))


@query("prune_actions", f"""SELECT event_id, tier, CASE WHEN tier = 'warm' AND coalesce(similarity, 1.0) < 0.7 THEN 'drop_edges'
  WHEN tier = 'cold' AND coalesce(importance_hint, 0) < 5 AND access_count < 3 THEN 'delete'
  WHEN tier = 'archive' THEN 'archive' ELSE 'keep' END AS action FROM (SELECT event_id, importance_hint, access_count,
  CASE WHEN position % 4 <> 0 THEN (position % 10) / 10.0 END AS similarity, {sql.tier(480)} AS tier
  FROM ledger)""")
def _(t):
    nodes = t.ledger.withColumn("similarity", F.when(F.col("position") % 4 != 0, (F.col("position") % 10) / 10.0))
    return retention.actions(nodes, NOW_US, Retention(cold=480)).select("event_id", "tier", "action")


@query("cold_delete_survivors", f"SELECT event_id FROM ledger WHERE NOT ({sql.HOURS} >= 168 AND coalesce(importance_hint, 0) < 5 AND access_count < 3)")
def _(t):
    return retention.cold_survivors(t.ledger, NOW_US).select("event_id")


@query("similar_edge_prune", SIMILAR + f"""SELECT src, dst, similarity FROM sims JOIN ledger ON event_id = src
  WHERE NOT (similarity < 0.93 AND {sql.HOURS} > 24)""")
def _(t):
    return retention.similar_edges_kept(similar_events(t, t.ledger), t.ledger, NOW_US, 24, 0.93).select("src", "dst", "similarity")


@query("orphan_entities", """SELECT entity_id AS id FROM evec WHERE entity_id NOT IN (SELECT dst
  FROM refs JOIN ledger ON event_id = src WHERE session_id IN ('s1', 's2', 's3'))""")
def _(t):
    edges = t.references.join(t.ledger.where("session_id IN ('s1', 's2', 's3')").select(F.col("event_id").alias("src")), "src", "left_semi")
    return retention.orphans(t.entity_vectors.select(F.col("entity_id").alias("id")), edges)


@query("stream_trim", f""", p AS (SELECT min(occurred_us // 1000) AS ms FROM (SELECT agent_id, max(occurred_us) AS occurred_us
  FROM ledger GROUP BY ALL)) SELECT event_id FROM ledger, p WHERE occurred_us // 1000 >= least(ms, {NOW_US // 1000 - 240 * 3600 * 1000})""")
def _(t):
    progress = t.ledger.groupBy("agent_id").agg(F.concat(F.floor(F.max("occurred_us") / 1000).cast("string"), F.lit("-0")).alias("stream_id"))
    point = retention.trim_point(progress, NOW_US // 1000 - 240 * 3600 * 1000)  # one row
    return t.ledger.join(F.broadcast(point)).where(F.floor(F.col("occurred_us") / 1000) >= F.col("ms")).select("event_id")


@query("expired_docs", f"SELECT event_id FROM ledger WHERE occurred_us // 1000 < {(NOW_US - 20 * 24 * 3_600_000_000) // 1000}")
def _(t):
    return retention.expired(t.ledger, NOW_US, 20).select("event_id")


@query("idle_sessions", f"""SELECT session_id, max(occurred_us) AS last_us FROM ledger GROUP BY ALL
  HAVING max(occurred_us) < {NOW_US - 12 * 3_600_000_000}""")
def _(t):
    return retention.idle_sessions(t.ledger, NOW_US, 12)


# ---- upserts and users ----


@query("upsert_merge", """SELECT event_id, status FROM ledger WHERE position % 2 = 0 AND position % 3 <> 0
  UNION ALL SELECT event_id, 'v2' FROM ledger WHERE position % 3 = 0""")
def _(t):
    old = t.ledger.where("position % 2 = 0").select("event_id", "status")
    changed = t.ledger.where("position % 3 = 0")
    changes = changed.select("event_id", F.lit("v1").alias("status"), F.lit(1).alias("version")).unionByName(changed.select("event_id", F.lit("v2").alias("status"), F.lit(2).alias("version")))
    return upsert.merge(old, changes, ["event_id"], "version")


@query("upsert_counting", """SELECT o.id, coalesce(o.tool, n.tool) AS tool, coalesce(o.c, 0) + coalesce(n.c, 0) AS seen
  FROM (SELECT 'entity:' || k AS id, min(tool_name) FILTER (position % 2 = 0) AS tool, 1 AS c
  FROM ledger GROUP BY k) o FULL JOIN (SELECT 'entity:' || k AS id, arg_min(tool_name, position) FILTER (tool_name IS NOT NULL) AS tool, count(*) AS c
  FROM ledger GROUP BY k) n ON n.id = o.id""")
def _(t):
    name = F.concat(F.lit("entity:"), "k")
    old = t.ledger.groupBy(name.alias("id")).agg(F.min(F.when(F.col("position") % 2 == 0, F.col("tool_name"))).alias("tool"), F.lit(1).cast("long").alias("seen"))
    return upsert.merge_counting(old, t.ledger.select(name.alias("id"), F.col("tool_name").alias("tool"), F.col("position").alias("order")), "id", ["tool"], "seen")


@query("detach_delete", "SELECT edge_type, count(*) AS n FROM edges WHERE CAST(src AS BIGINT) % 5 <> 0 AND CAST(dst AS BIGINT) % 5 <> 0 GROUP BY ALL")
def _(t):
    ids = t.ledger.select(F.col("event_id").alias("id"), "position")
    _, left = upsert.detach_delete(ids.select("id"), projection.event_edges(t.ledger), ids.where("position % 5 = 0").select("id"))
    return left.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("feedback_importance", """SELECT event_id AS id, greatest(1, least(10, coalesce(importance_hint, 5) + (CASE
  WHEN position % 2 = 0 THEN 1 ELSE -1 END) * (1 + position % 3))) AS importance FROM ledger""")
def _(t):
    votes = t.ledger.select(F.col("event_id").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("position") % FEEDBACK_STEP)).alias("order"), F.when(F.col("position") % 2 == 0, 1).otherwise(-1).alias("delta"))
    return users.feedback_importance(t.ledger.select(F.col("event_id").alias("id"), "importance_hint"), votes)


@query("access_reinforcement", f"""SELECT event_id AS id, access_count + CASE WHEN position % 2 = 0 THEN 2 ELSE 0 END AS access_count,
  CASE WHEN position % 2 = 0 THEN greatest({NOW_US}, coalesce(last_accessed_us, 0)) ELSE last_accessed_us END AS last_us
  FROM ledger""")
def _(t):
    log = t.ledger.where("position % 2 = 0").select(F.col("event_id").alias("id"), F.explode(F.array(F.lit(NOW_US - 1), F.lit(NOW_US))).alias("us"))
    return users.access_reinforced(t.ledger.select(F.col("event_id").alias("id"), "access_count", "last_accessed_us"), log)


CONFLICTS = """, prefs AS (SELECT 'pref:' || event_id AS id, session_id, split_part(event_type, '.', 1) AS category, k % 20 AS key,
  CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS polarity, position, occurred_us
  FROM ledger), conf AS (SELECT lag(id) OVER w AS a, id AS b, lag(polarity) OVER w AS was, polarity
  FROM prefs WINDOW w AS (PARTITION BY session_id, category, key ORDER BY position))"""


@query("pref_contradictions", CONFLICTS + "SELECT a, b FROM conf WHERE a IS NOT NULL AND was <> polarity")
def _(t):
    return resolution.preference_conflicts(users.preferences(t.ledger)).select("a", "b")


@query("pref_resolution", CONFLICTS + "SELECT b AS winner, a AS loser FROM conf WHERE a IS NOT NULL AND was <> polarity")
def _(t):
    return resolution.preference_winner(resolution.preference_conflicts(users.preferences(t.ledger)))


@query("pref_active", CONFLICTS + "SELECT id AS preference_id FROM prefs WHERE id NOT IN (SELECT a FROM conf WHERE a IS NOT NULL AND was <> polarity)")
def _(t):
    prefs = users.preferences(t.ledger)
    return resolution.superseded(prefs, resolution.preference_winner(resolution.preference_conflicts(prefs)), "preference_id").where("superseded_by IS NULL").select("preference_id")


BELIEFS = """, beliefs AS (SELECT session_id, seq, event_id, importance_hint AS c, CASE
  WHEN position % 7 <> 0 THEN occurred_us END AS us, access_count AS n FROM ledger WHERE importance_hint IS NOT NULL)"""
A_WINS = "(a.c > b.c OR (a.c = b.c AND CASE WHEN a.us IS NOT NULL AND b.us IS NOT NULL AND a.us <> b.us THEN a.us > b.us ELSE a.n > b.n END))"


@query("belief_resolution", f"""{BELIEFS} SELECT CASE WHEN {A_WINS} THEN a.event_id ELSE b.event_id END AS winner,
  CASE WHEN {A_WINS} THEN b.event_id ELSE a.event_id END AS loser FROM beliefs a JOIN beliefs b ON b.session_id = a.session_id AND b.seq = a.seq + 1""")
def _(t):
    known = F.when(F.col("position") % 7 != 0, F.col("occurred_us"))
    rows = t.ledger.where("importance_hint IS NOT NULL")
    side = lambda p: rows.select("session_id", F.col("seq").alias(f"{p}_seq"), F.col("event_id").alias(p), F.col("importance_hint").alias(f"{p}_confidence"), known.alias(f"{p}_us"), F.col("access_count").alias(f"{p}_count"))
    before = side("a").withColumn("b_seq", F.col("a_seq") + 1)
    return resolution.belief_winner(before.join(side("b"), ["session_id", "b_seq"]))


@query("alias_resolution", f"""{MENTIONS}, n AS (SELECT m.*, coalesce(a.whole, {sql.normalised('name')}) AS key
  FROM mentions m LEFT JOIN (VALUES {sql.ALIAS_ROWS}) AS a(alias, whole) ON a.alias = {sql.normalised('name')}) SELECT x.name, x.entity_type,
  CASE WHEN x.entity_type = y.entity_type THEN 'MERGE' ELSE 'SAME_AS' END AS action, y.name AS target,
  CASE WHEN x.entity_type = y.entity_type THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence
  FROM n x JOIN (SELECT * FROM n WHERE session_id = '{SESSION}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY position) = 1) y USING (key)""")
def _(t):
    named = mentions(t)
    return resolution.by_alias(named, named.where(F.col("session_id") == SESSION).withColumnRenamed("position", "ordinal"))


@query("fuzzy_resolution")
def _(t):
    """All names against those of one session."""
    named = mentions(t)
    return resolution.fuzzy(named.select("name", "entity_type").distinct(), named.where(F.col("session_id") == SESSION).select("name", "entity_type").distinct())


@query("semantic_resolution", """SELECT a, b, CASE
  WHEN similarity >= 0.9 THEN 'SAME_AS' ELSE 'RELATED_TO' END AS action, round(similarity, 4) AS confidence
  FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1)
  WHERE similarity >= 0.75""")
def _(t):
    return resolution.semantic(entity_pairs(t, 0.75))


@query("belief_contradictions")
def _(t):
    beliefs = t.read("benchmark").select(F.col("item_id").alias("belief_id"), (F.col("item_id") % 20).cast("string").alias("category"), F.col("text").alias("belief_text"))
    again = beliefs.select((F.col("belief_id") + 100_000).alias("belief_id"), "category", F.concat(F.lit("It has been said before and told again, but it is not so: "), "belief_text").alias("belief_text"))
    return resolution.belief_contradictions(beliefs.unionByName(again))


@query("confidence_prior", f"""SELECT event_id, source, least(value / 100, coalesce(c, value / 100)) AS confidence
  FROM (SELECT event_id, value, ['explicit', 'inferred', 'observed', 'unheard'][position % 4 + 1] AS source
  FROM ledger) LEFT JOIN (VALUES {sql.CEILING_ROWS}) AS m(source, c) USING (source)""")
def _(t):
    source = F.get(F.array(*[F.lit(x) for x in ("explicit", "inferred", "observed", "unheard")]), (F.col("position") % 4).cast("int"))
    return t.ledger.select("event_id", source.alias("source"), text.capped_confidence(F.col("value") / 100, source).alias("confidence"))


def quotes(t: Tables) -> DataFrame:
    """A quote of each conversation's first turn against its second."""
    c = t.read("conversations")
    first = c.where("turn = 0").select("conv_id", F.substring("text", 6, 40).alias("quote"), F.col("text").alias("own"))
    return first.join(c.where("turn = 1").select("conv_id", F.col("text").alias("other")), "conv_id")


def supported_sql(said: str) -> str:
    words = f"list_distinct(list_filter(string_split({sql.normalised('quote')}, ' '), lambda w: len(w) > 3))"
    shared = f"len(list_intersect({words}, string_split({sql.normalised(said)}, ' ')))"
    return f"(quote <> '' AND {said} <> '' AND (contains({sql.normalised(said)}, {sql.normalised('quote')}) OR (len({words}) > 0 AND {shared} >= 0.6 * len({words}))))"


@query("quote_substring", f"""SELECT conv_id, coalesce({supported_sql('own')}, FALSE) AS in_own, coalesce({supported_sql('other')}, FALSE) AS in_other
  FROM (SELECT a.conv_id, substr(a.text, 6, 40) AS quote, a.text AS own, b.text AS other FROM conversations a
  JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn = 1)""", model=False)
def _(t):
    has = lambda said: F.coalesce(text.quote_supported(F.col("quote"), F.col(said)), F.lit(False))
    return quotes(t).select("conv_id", has("own").alias("in_own"), has("other").alias("in_other"))


@query("entailment_heuristic", f"""WITH p AS (SELECT a.conv_id, string_split({sql.normalised('substr(a.text, 6, 40)')}, ' ') AS c, string_split({sql.normalised('b.text')}, ' ') AS e, substr(a.text, 6, 40) AS q, b.text AS o
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn = 1),
  w AS (SELECT *, list_distinct(list_filter(c, lambda x: len(x) > 2)) AS cw, list_distinct(list_filter(e, lambda x: len(x) > 2)) AS ew
  FROM p) SELECT conv_id, q <> '' AND o <> '' AND list_has_any(c, {sql.NEGATION_LIST}) = list_has_any(e, {sql.NEGATION_LIST}) AND (len(cw) < 2 OR len(ew) = 0 OR len(list_intersect(cw, ew)) >= 0.5 * len(cw)) AS entailed
  FROM w""", model=False)
def _(t):
    return quotes(t).select("conv_id", text.entailed(F.col("quote"), F.col("other")).alias("entailed"))


@query("tool_preference", """SELECT agent_id, tool_name, count(*) AS uses, round(least(0.9, 0.3 + count(*) / 20.0), 6) AS strength
  FROM ledger WHERE tool_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) > 0.7""")
def _(t):
    return users.tool_preferences(t.ledger)


@query("user_interests", """SELECT user_id, 'entity:' || k AS entity_id, count(*) AS mentions, count(DISTINCT trace_id) AS days
  FROM ledger GROUP BY user_id, k HAVING count(*) >= 3""")
def _(t):
    return users.interests(t.ledger, 3)


@query("skill_proficiency", """SELECT user_id, split_part(event_type, '.', 1) AS skill, count(*) AS assessments, round(avg(CASE
  WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS proficiency FROM ledger GROUP BY ALL""")
def _(t):
    return t.ledger.groupBy("user_id", F.split_part("event_type", F.lit("."), F.lit(1)).alias("skill")).agg(F.count("*").alias("assessments"), F.round(F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)), 6).alias("proficiency"))


@query(
    "pref_decay",
    f"""SELECT 'pref:' || event_id AS preference_id, round(exp(-greatest(0.0, ({NOW_US} - greatest(occurred_us, coalesce(last_accessed_us, 0))) / 3.6e9) / (CASE
  WHEN split_part(event_type, '.', 1) = 'tool' THEN 336.0 ELSE 168.0 END)::DOUBLE) + 0.8::DOUBLE * (value / 100) + 0.8::DOUBLE * (k % 10 / 10.0)::DOUBLE, 6) AS score
  FROM ledger""",
)
def _(t):
    category = F.split_part("event_type", F.lit("."), F.lit(1))
    score = users.preference_decay(F.col("occurred_us"), F.col("last_accessed_us"), category, F.col("value") / 100, (F.col("k") % 10 / 10.0).cast("double"), NOW_US)
    return t.ledger.select(F.concat(F.lit("pref:"), "event_id").alias("preference_id"), F.round(score, 6).alias("score"))


@query("user_profile", f"""SELECT c_custkey AS user_id, c_name AS name, count(event_id) AS events
  FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL""", model=False)
def _(t):
    people = t.read("customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_name").alias("name"))
    return people.join(t.read("events").groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", "name", F.coalesce("n", F.lit(0)).alias("events"))


def user_edges(t: Tables) -> DataFrame:
    """What users are linked with: profiles, preferences, skills, interests, patterns, and other accounts."""
    user, skill = F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("skill:"), F.split_part("event_type", F.lit("."), F.lit(1)))
    told = [F.lit("rules").alias("method"), "session_id"]
    prefs = t.ledger.select(user.alias("user_entity_id"), F.concat(F.lit("pref:"), "event_id").alias("preference_id"), F.when(F.col("k") % 3 != 0, F.col("k").cast("string")).alias("about_entity"), F.array("event_id").alias("source_event_ids"), *told)
    nothing = [F.lit(None).cast("double").alias("proficiency"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source")]
    first = t.ledger.groupBy(user.alias("user_entity_id"), skill.alias("skill_id"), "session_id").agg(F.array(F.min("position").cast("string")).alias("source_event_ids"))
    skills = first.select("*", F.lit("rules").alias("method"), *nothing)
    wanted = users.interests(t.ledger, 3).select(user.alias("user_entity_id"), F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("entity_name"), F.lit(0.5).alias("weight"), F.lit("declared").alias("source"))
    people = t.ledger.select("user_id").distinct()
    own = lambda kind, what: people.select(*users.edge(user, F.concat(F.lit(f"{what}:"), "user_id"), kind))
    same = people.where("user_id % 5 IN (0, 4)").select(*users.edge(user, F.concat(F.lit("user:"), F.col("user_id") + 1), "SAME_AS"))
    out = own("HAS_PROFILE", "profile").unionByName(own("EXHIBITS_PATTERN", "pattern")).unionByName(same)
    for made in (users.preference_edges(prefs), users.skill_edges(skills), users.interest_edges(wanted)):
        out = out.unionByName(made)
    return out


def user_nodes(t: Tables) -> DataFrame:
    named = lambda df, prefix, key, label: df.select(F.concat(F.lit(prefix), key).alias("id"), F.lit(label).alias("label"), F.concat(F.lit(label + " "), key).alias("name")).distinct()
    people = t.ledger.select(F.col("user_id").cast("string").alias("u")).distinct()
    parts = [named(people, "user:", "u", "Entity"), named(people, "profile:", "u", "UserProfile"), named(people, "pattern:", "u", "BehavioralPattern"), named(t.ledger, "pref:", "event_id", "Preference")]
    parts += [named(t.ledger.select(F.col("k").cast("string").alias("k")), "entity:", "k", "Entity"), named(t.ledger.select(F.split_part("event_type", F.lit("."), F.lit(1)).alias("s")), "skill:", "s", "Skill")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


USERS = """, uedges AS (
  SELECT DISTINCT 'user:' || user_id AS src, 'profile:' || user_id AS dst, 'HAS_PROFILE' AS edge_type FROM ledger
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'pattern:' || user_id, 'EXHIBITS_PATTERN' FROM ledger
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'user:' || (user_id + 1), 'SAME_AS' FROM ledger WHERE user_id % 5 IN (0, 4)
  UNION ALL SELECT 'user:' || user_id, 'pref:' || event_id, 'HAS_PREFERENCE' FROM ledger
  UNION ALL SELECT 'pref:' || event_id, 'entity:' || k, 'ABOUT' FROM ledger WHERE k % 3 <> 0
  UNION ALL SELECT 'pref:' || event_id, event_id, 'DERIVED_FROM' FROM ledger
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'skill:' || split_part(event_type, '.', 1), 'HAS_SKILL' FROM ledger
  UNION ALL SELECT 'skill:' || split_part(event_type, '.', 1), CAST(min(position) AS VARCHAR), 'DERIVED_FROM' FROM ledger GROUP BY user_id, split_part(event_type, '.', 1)
  UNION ALL SELECT 'user:' || user_id, 'entity:' || k, 'INTERESTED_IN' FROM ledger GROUP BY user_id, k HAVING count(*) >= 3
), unodes AS (
  SELECT DISTINCT 'user:' || user_id AS id, 'Entity' AS label FROM ledger UNION ALL SELECT DISTINCT 'profile:' || user_id, 'UserProfile' FROM ledger
  UNION ALL SELECT DISTINCT 'pattern:' || user_id, 'BehavioralPattern' FROM ledger UNION ALL SELECT 'pref:' || event_id, 'Preference' FROM ledger
  UNION ALL SELECT DISTINCT 'entity:' || k, 'Entity' FROM ledger UNION ALL SELECT DISTINCT 'skill:' || split_part(event_type, '.', 1), 'Skill' FROM ledger
)
"""
ERASED = f""", mine AS (SELECT dst FROM uedges WHERE src = 'user:{USER}' AND edge_type IN ('HAS_PROFILE', 'HAS_PREFERENCE', 'EXHIBITS_PATTERN')),
left_edges AS (SELECT * FROM uedges WHERE src NOT IN (SELECT dst FROM mine) AND dst NOT IN (SELECT dst FROM mine) AND NOT (src = 'user:{USER}' AND edge_type IN ('HAS_SKILL', 'INTERESTED_IN')) AND NOT (edge_type = 'SAME_AS' AND (src = 'user:{USER}' OR dst = 'user:{USER}')))
"""


@query("user_edges", USERS + "SELECT src, dst, edge_type FROM uedges")
def _(t):
    return user_edges(t).select("src", "dst", "edge_type")


@query("gdpr_erase", USERS + ERASED + f"""SELECT edge_type AS what, count(*) AS n FROM left_edges
  GROUP BY ALL UNION ALL SELECT 'nodes', count(*) FROM unodes WHERE id NOT IN (SELECT dst FROM mine)
  UNION ALL SELECT 'redacted', count(*) FROM unodes WHERE id = 'user:{USER}' UNION ALL SELECT 'affected', 1""")
def _(t):
    nodes, edges, affected = users.erase_user(user_nodes(t), user_edges(t), f"user:{USER}")
    told = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("name") == "REDACTED").alias("redacted"))
    both = told.select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("redacted"), "redacted")).alias("what", "n"))
    return edges.groupBy(F.col("edge_type").alias("what")).agg(F.count("*").alias("n")).unionByName(both).unionByName(affected.select(F.lit("affected").alias("what"), F.col("affected").cast("long").alias("n")))


@query("gdpr_export", USERS + f""", own AS (SELECT CASE edge_type WHEN 'HAS_PROFILE' THEN 'profile'
  WHEN 'HAS_PREFERENCE' THEN 'preferences' WHEN 'HAS_SKILL' THEN 'skills'
  WHEN 'EXHIBITS_PATTERN' THEN 'patterns' ELSE 'interests' END AS kind, dst AS id FROM uedges
  WHERE src = 'user:{USER}' AND edge_type IN ('HAS_PROFILE', 'HAS_PREFERENCE', 'HAS_SKILL', 'EXHIBITS_PATTERN', 'INTERESTED_IN')) SELECT kind, id
  FROM own UNION ALL SELECT 'provenance_chains', src || '>' || dst FROM uedges WHERE edge_type = 'DERIVED_FROM' AND src IN (SELECT id
  FROM own)""")
def _(t):
    return users.export_user(user_nodes(t), user_edges(t), f"user:{USER}").select("kind", "id")


@query("orphan_labels", USERS + """, e AS (SELECT * FROM uedges
  WHERE edge_type NOT IN ('INTERESTED_IN', 'ABOUT', 'DERIVED_FROM') AND NOT (edge_type = 'HAS_PREFERENCE' AND src <> 'user:5')) SELECT label, count(*) AS n
  FROM unodes WHERE label <> 'UserProfile' AND id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst
  FROM e) GROUP BY ALL""")
def _(t):
    left = user_edges(t).where("edge_type NOT IN ('INTERESTED_IN', 'ABOUT', 'DERIVED_FROM') AND NOT (edge_type = 'HAS_PREFERENCE' AND src <> 'user:5')")
    return retention.orphan_sweep(user_nodes(t), left).groupBy("label").agg(F.count("*").alias("n"))


@query("tier_prunable", f"""SELECT event_id, tier FROM (SELECT *, {sql.tier(480)} AS tier FROM ledger)
  WHERE tier = 'archive' OR (coalesce(importance_hint, 0) < 5 AND ((tier = 'warm' AND access_count = 0) OR (tier = 'cold' AND access_count < 3)))""")
def _(t):
    return retention.prunable(t.ledger, NOW_US, Retention(cold=480.0)).select("event_id", "tier")


@query("forgetting_applied", SIMILAR + f""", kept AS (SELECT event_id, {sql.HOURS} AS hours FROM (SELECT *, {sql.tier(480)} AS tier
  FROM ledger) WHERE tier <> 'archive' AND NOT (tier = 'cold' AND coalesce(importance_hint, 0) < 5 AND access_count < 3)),
  alle AS (SELECT src, dst, edge_type, NULL::DOUBLE AS similarity FROM edges UNION ALL SELECT src, dst, 'SIMILAR_TO', similarity
  FROM sims) SELECT 'events' AS what, count(*) AS n FROM kept UNION ALL SELECT edge_type, count(*)
  FROM alle JOIN kept x ON x.event_id = src JOIN kept y ON y.event_id = dst
  WHERE NOT (edge_type = 'SIMILAR_TO' AND similarity < 0.93 AND x.hours > 24) GROUP BY edge_type""")
def _(t):
    edges = projection.event_edges(t.ledger).withColumn("similarity", F.lit(None).cast("double")).unionByName(similar_events(t, t.ledger))
    events, left = retention.forget(t.ledger, edges, NOW_US, Retention(cold=480.0, warm_similarity=0.93))
    return events.agg(F.count("*").alias("n")).select(F.lit("events").alias("what"), "n").unionByName(left.groupBy(F.col("edge_type").alias("what")).agg(F.count("*").alias("n")))


@query("path_safety", """SELECT page_id, length(p) BETWEEN 1 AND 256 AND NOT regexp_matches(p, '[%\\n\\r]|\\.\\.|/|\\\\') AS safe
  FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'a%2e' || page_id WHEN 2 THEN '..' ELSE 'id-' || page_id END AS p
  FROM pages)""", model=False)
def _(t):
    k = F.col("page_id") % 5
    given = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("a%2e"), "page_id")).when(k == 2, "..").otherwise(F.concat(F.lit("id-"), "page_id"))
    return t.read("pages").select("page_id", text.safe_path_parameter(given).alias("safe"))


@query("message_roles", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS message, CASE role
  WHEN 'user' THEN 'observation.input' WHEN 'assistant' THEN 'agent.invoke' ELSE 'system.session_start' END AS event_type
  FROM conversations""", model=False)
def _(t):
    role = F.col("role")
    message = F.when(role == "user", "human").when(role == "assistant", "ai").otherwise("system")
    kind = F.when(role == "user", "observation.input").when(role == "assistant", "agent.invoke").otherwise("system.session_start")
    return t.read("conversations").select("conv_id", "turn", message.alias("message"), kind.alias("event_type"))


# ---- archive ----


@query("archive_roundtrip", f"""SELECT strftime(occurred_at, '%Y/%m/%d') AS day, count(*) AS n FROM ledger
  WHERE occurred_us // 1000 < {(NOW_US - 20 * 24 * 3_600_000_000) // 1000} GROUP BY ALL""")
def _(t):
    import uuid

    from emberlake.sources.ledger import archive, archived

    base = graph.cut(t.spark.range(1)).inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base}/archive-{uuid.uuid4().hex}"
    archive(retention.expired(t.ledger, NOW_US, 20), path)
    return archived(t.spark, path).groupBy(F.date_format("occurred_at", "yyyy/MM/dd").alias("day")).agg(F.count("*").alias("n"))
