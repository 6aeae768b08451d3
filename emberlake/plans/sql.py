"""SQL building blocks of the oracles: the data model over the input tables, and the scores."""

from __future__ import annotations

from emberlake.model import ALIASES, CONFIDENCE_CEILINGS, ENTITY_TYPES, INTENT_WEIGHTS, INTENTS, NEGATIONS, SEED_STRATEGIES
from emberlake.sources.ledger import NOW_US

MODEL = f"""
WITH RECURSIVE base AS (
  SELECT event_id AS position, ts, user_id, event_type AS raw, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events
), ledger AS (
  SELECT CAST(b.position AS VARCHAR) AS event_id, b.position, 's' || b.user_id AS session_id, 'a' || (b.user_id % 10) AS agent_id,
    't' || b.user_id || '-' || strftime(b.ts, '%Y-%m-%d') AS trace_id,
    CASE b.raw WHEN 'click' THEN 'tool.execute' WHEN 'view' THEN 'observation.input' WHEN 'purchase' THEN 'agent.invoke' WHEN 'error' THEN 'observation.output' ELSE 'system.session_start' END AS event_type,
    b.ts AS occurred_at, epoch_us(b.ts) AS occurred_us, CASE WHEN b.raw = 'click' THEN 'tool_' || (b.k % 10) END AS tool_name,
    CASE WHEN b.k % 7 <> 0 THEN 1 + b.k % 10 END AS importance_hint, b.position % 5 AS access_count,
    CASE WHEN b.position % 3 <> 0 THEN epoch_us(b.ts) + (b.position % 3) * 3600000000 END AS last_accessed_us,
    CAST(p.position AS VARCHAR) AS parent_event_id, CASE WHEN b.raw = 'error' THEN 'failed' ELSE 'completed' END AS status, b.user_id, b.k, b.seq, b.value
  FROM base b LEFT JOIN base p ON p.user_id = b.user_id AND p.seq = b.seq // 2
), refs AS (SELECT event_id AS src, 'entity:' || k AS dst FROM ledger),
entities AS (
  SELECT 'entity:' || k AS entity_id, k, count(*) AS mention_count, min(occurred_us) AS first_seen_us, max(occurred_us) AS last_seen_us,
    [{", ".join(repr(x) for x in ENTITY_TYPES)}][k % 6 + 1] AS entity_type FROM ledger GROUP BY k
), lagged AS (
  SELECT event_id AS src, session_id, lag(event_id) OVER w AS dst, occurred_us - lag(occurred_us) OVER w AS gap FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY occurred_us, position)
), follows AS (SELECT src, dst, session_id, CAST(trunc(gap / 1000) AS BIGINT) AS delta_ms FROM lagged WHERE dst IS NOT NULL),
caused AS (SELECT event_id AS src, parent_event_id AS dst FROM ledger WHERE parent_event_id IS NOT NULL),
edges AS (SELECT src, dst, 'FOLLOWS' AS edge_type FROM follows UNION ALL SELECT src, dst, 'CAUSED_BY' FROM caused),
evec AS (
  SELECT 'entity:' || i.k AS entity_id, i.k AS k,
    list_transform(range(1, 65), lambda x: CAST(b.embedding[x] AS DOUBLE) + (CASE WHEN i.k % 3 = 0 THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END) * CAST(o.embedding[x] AS DOUBLE)) AS vector
  FROM (SELECT CAST(vec_id AS INTEGER) AS k FROM embeddings) i JOIN embeddings b ON b.vec_id = i.k // 4 JOIN embeddings o ON o.vec_id = i.k + 100
), pairs AS (
  SELECT x.entity_id AS a, y.entity_id AS b, round(list_cosine_similarity(x.vector, y.vector), 6) AS similarity FROM evec x JOIN evec y ON x.k < y.k
)
"""

HOURS = f"(({NOW_US} - occurred_us) / 3.6e9)"


def recency(occurred: str, accessed: str, count: str, base: float = 168.0, boost: float = 24.0) -> str:
    return f"exp(-greatest(0.0, ({NOW_US} - greatest({occurred}, coalesce({accessed}, {occurred}))) / 3.6e9) / ({base}::DOUBLE * (1 + {boost / base}::DOUBLE * ln(1 + {count}))))"


def importance(hint: str, count: str, degree: str = "0") -> str:
    return f"least(1.0, coalesce({hint} / 10.0, 0.5) + least(0.2, 0.05 * ln(1 + {count})) + least(0.2, 0.05 * ln(1 + {degree})))"


RECENCY = recency("occurred_us", "last_accessed_us", "access_count")
IMPORTANCE = importance("importance_hint", "access_count")
DECAY = f"((({RECENCY}) + ({IMPORTANCE}) + 0.5) / 3.5)"

ALIAS_ROWS = ", ".join(f"('{a}', '{whole}')" for whole, aliases in ALIASES.items() for a in aliases)
CEILING_ROWS = ", ".join(f"('{s}', {c})" for s, c in CONFIDENCE_CEILINGS.items())
INTENT_ROWS = ", ".join(f"({i}, '{n}', '{w}')" for i, (n, ws) in enumerate(INTENTS.items()) for w in ws)
WEIGHT_ROWS = ", ".join(f"('{i}', '{e}', {w})" for i, row in INTENT_WEIGHTS.items() for e, w in row.items())
STRATEGY_ROWS = ", ".join(f"('{i}', '{s}')" for i, s in SEED_STRATEGIES.items())
NEGATION_LIST = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in NEGATIONS) + "]"


def normalised(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def tier(cold: float = 720.0) -> str:
    return f"CASE WHEN {HOURS} < 24 THEN 'hot' WHEN {HOURS} < 168 THEN 'warm' WHEN {HOURS} < {cold} THEN 'cold' ELSE 'archive' END"
