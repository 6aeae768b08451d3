"""The data model: event schema, enumerations, defaults."""

from __future__ import annotations

import dataclasses

from pyspark.sql import types as T

# Enumerations and lexicons of the model.
EVENT_PREFIXES = ["agent", "llm", "tool", "observation", "system", "user"]
EDGE_TYPES = [
    "FOLLOWS", "CAUSED_BY", "SIMILAR_TO", "REFERENCES", "SUMMARIZES", "SAME_AS", "RELATED_TO", "HAS_PROFILE", "HAS_PREFERENCE", "HAS_SKILL", "DERIVED_FROM",
    "EXHIBITS_PATTERN", "INTERESTED_IN", "ABOUT", "ABSTRACTED_FROM", "PARENT_SKILL", "CONTRADICTS", "SUPERSEDES", "PURSUES", "CONTAINS",
]
ENTITY_TYPES = ["agent", "user", "service", "tool", "resource", "concept"]
INTENTS = {
    "why": ["why", "because", "caused", "reason", "root cause", "due to"],
    "when": ["when", "timeline", "before", "after", "sequence", "order", "time"],
    "what": ["what", "describe", "explain", "definition", "meaning"],
    "related": ["similar", "related", "like", "compare", "associated"],
    "who_is": ["who", "person", "user", "team", "member", "author"],
    "how_does": ["how", "process", "method", "approach", "workflow", "steps"],
    "personalize": ["prefer", "favorite", "style", "personalize", "customize"],
}
SEED_STRATEGIES = {
    "why": "causal_roots", "when": "temporal_anchors", "what": "entity_hubs", "who_is": "entity_hubs", "related": "similar_cluster", "how_does": "workflow_pattern",
    "personalize": "user_profile", "general": "general",
}
#: The labels that an edge type leads from and to; None: any. Fixed values.
EDGE_ENDS = {
    "FOLLOWS": ("Event", "Event"), "CAUSED_BY": ("Event", "Event"), "SIMILAR_TO": ("Event", "Event"), "REFERENCES": ("Event", "Entity"), "SUMMARIZES": ("Summary", None),
    "SAME_AS": ("Entity", "Entity"), "RELATED_TO": ("Entity", "Entity"), "HAS_PROFILE": ("Entity", "UserProfile"), "HAS_PREFERENCE": ("Entity", "Preference"), "HAS_SKILL": ("Entity", "Skill"),
    "DERIVED_FROM": (None, "Event"), "EXHIBITS_PATTERN": ("Entity", "BehavioralPattern"), "INTERESTED_IN": ("Entity", "Entity"), "ABOUT": ("Preference", "Entity"),
    "ABSTRACTED_FROM": ("Workflow", "Workflow"), "PARENT_SKILL": ("Skill", "Skill"), "CONTRADICTS": ("Belief", "Belief"), "SUPERSEDES": ("Belief", "Belief"), "PURSUES": ("Entity", "Goal"), "CONTAINS": ("Episode", "Event"),
}
#: Weight of the core edge types for each intent. Fixed values.
INTENT_WEIGHTS = {
    "why": {"CAUSED_BY": 5.0, "FOLLOWS": 1.0, "SIMILAR_TO": 1.5, "REFERENCES": 2.0, "SUMMARIZES": 1.0},
    "when": {"CAUSED_BY": 1.0, "FOLLOWS": 5.0, "SIMILAR_TO": 0.5, "REFERENCES": 1.0, "SUMMARIZES": 0.5},
    "what": {"CAUSED_BY": 2.0, "FOLLOWS": 1.0, "SIMILAR_TO": 2.0, "REFERENCES": 5.0, "SUMMARIZES": 2.0},
    "related": {"CAUSED_BY": 1.5, "FOLLOWS": 0.5, "SIMILAR_TO": 5.0, "REFERENCES": 2.0, "SUMMARIZES": 1.5},
    "general": {"CAUSED_BY": 2.0, "FOLLOWS": 2.0, "SIMILAR_TO": 2.0, "REFERENCES": 2.0, "SUMMARIZES": 2.0},
    "who_is": {"CAUSED_BY": 1.0, "FOLLOWS": 0.5, "SIMILAR_TO": 1.0, "REFERENCES": 3.0, "SUMMARIZES": 1.0, "HAS_PROFILE": 5.0, "HAS_PREFERENCE": 5.0, "HAS_SKILL": 5.0, "EXHIBITS_PATTERN": 4.0, "INTERESTED_IN": 4.0, "ABOUT": 3.0, "DERIVED_FROM": 2.0, "ABSTRACTED_FROM": 1.0, "PARENT_SKILL": 2.0, "SAME_AS": 4.0, "RELATED_TO": 3.0},
    "how_does": {"CAUSED_BY": 2.0, "FOLLOWS": 3.0, "SIMILAR_TO": 1.0, "REFERENCES": 2.0, "SUMMARIZES": 1.0, "HAS_PROFILE": 1.0, "HAS_PREFERENCE": 2.0, "HAS_SKILL": 3.0, "EXHIBITS_PATTERN": 5.0, "INTERESTED_IN": 2.0, "ABOUT": 1.0, "DERIVED_FROM": 1.0, "ABSTRACTED_FROM": 4.0, "PARENT_SKILL": 1.0, "SAME_AS": 1.0, "RELATED_TO": 2.0},
    "personalize": {"CAUSED_BY": 1.0, "FOLLOWS": 0.5, "SIMILAR_TO": 1.5, "REFERENCES": 2.0, "SUMMARIZES": 1.0, "HAS_PROFILE": 4.0, "HAS_PREFERENCE": 5.0, "HAS_SKILL": 4.0, "EXHIBITS_PATTERN": 3.0, "INTERESTED_IN": 4.0, "ABOUT": 3.0, "DERIVED_FROM": 3.0, "ABSTRACTED_FROM": 1.0, "PARENT_SKILL": 2.0, "SAME_AS": 2.0, "RELATED_TO": 2.0},
}
#: The most confidence that a source can give, words of negation, aliases of names.
CONFIDENCE_CEILINGS = {"explicit": 0.95, "implicit_intentional": 0.7, "implicit_unintentional": 0.5, "observed": 0.85, "declared": 0.95, "inferred": 0.6, "implicit": 0.7}
NEGATIONS = ["no", "not", "never", "none", "nor", "neither", "without", "don't", "doesn't", "didn't", "won't", "can't", "isn't", "aren't", "wasn't", "weren't"]
#: What sources in extracted preferences, skills and interests become, and what unknown ones do. Fixed values.
PREFERENCE_SOURCES = ({"explicit": "explicit", "implicit": "implicit_intentional", "implicit_intentional": "implicit_intentional", "implicit_unintentional": "implicit_unintentional", "inferred": "implicit_unintentional", "observed": "implicit_intentional"}, "implicit_intentional")
SKILL_SOURCES = ({"observed": "observed", "declared": "declared", "inferred": "inferred", "explicit": "declared", "implicit": "observed", "implicit_intentional": "observed"}, "observed")
INTEREST_SOURCES = ({"explicit": "explicit", "implicit": "implicit", "inferred": "inferred", "observed": "implicit", "implicit_intentional": "implicit", "implicit_unintentional": "implicit"}, "implicit")
#: Confidences that lie closer together than this say nothing; fewer of them than this aren't judged. Fixed values.
DEGENERATE = (0.02, 3)
#: What a neighbour tells, by the type of the edge that leads to it. Fixed values.
PROACTIVE_SIGNALS = {"REFERENCES": "entity_context", "SIMILAR_TO": "recurring_pattern", "CAUSED_BY": "causal_chain", "FOLLOWS": "temporal_sequence", "SUMMARIZES": "summary_context"}
OTHER_SIGNAL = "related_context"
ALIASES = {
    "quickbooks": ["qb", "qbo", "quickbooks online"], "paypal": ["pp", "paypal.com"], "stripe": ["stripe.com", "stripe api"], "github": ["gh", "github.com"],
    "visual studio code": ["vscode", "vs code"], "javascript": ["js"], "typescript": ["ts"], "python": ["py"], "postgresql": ["postgres", "psql", "pg"],
    "kubernetes": ["k8s"], "docker": ["docker.io"], "amazon web services": ["aws"], "google cloud platform": ["gcp"], "microsoft azure": ["azure"],
    "usps": ["us postal service", "united states postal service"], "fedex": ["federal express"], "csv": ["comma separated values", "comma-separated values"],
}
#: Hours over which a preference fades to 1/e, by category, and that of categories unheard of. Fixed values.
PREFERENCE_STABILITY = {"communication": 720.0, "environment": 720.0, "tool": 336.0, "workflow": 336.0, "domain": 168.0, "style": 168.0}
OTHER_STABILITY = 168.0
#: What recency, strength and confidence weigh in a preference's score. Fixed values.
PREFERENCE_WEIGHTS = (1.0, 0.8, 0.8)


@dataclasses.dataclass(frozen=True)
class Decay:
    """Recency and composite scoring defaults; hours and weights."""

    base: float = 168.0
    boost: float = 24.0
    entity_base: float = 336.0
    entity_boost: float = 24.0
    recency_weight: float = 1.0
    importance_weight: float = 1.0
    relevance_weight: float = 1.0
    affinity_weight: float = 0.5


@dataclasses.dataclass(frozen=True)
class Retention:
    """Retention tiers: upper ages in hours, and what is kept within them."""

    hot: float = 24.0
    warm: float = 168.0
    cold: float = 720.0
    warm_similarity: float = 0.7
    cold_importance: int = 5
    cold_access: int = 3


@dataclasses.dataclass(frozen=True)
class EventQuery:
    """A conjunctive ledger search; bounds are checked on creation."""

    session_id: str | None = None
    agent_id: str | None = None
    trace_id: str | None = None
    event_type: str | None = None
    tool_name: str | None = None
    after_us: int | None = None
    before_us: int | None = None
    limit: int = 100
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit is 1 to 1000, offset at least 0")


@dataclasses.dataclass(frozen=True)
class SubgraphQuery:
    """Bounds of a subgraph retrieval."""

    text: str
    session_id: str
    max_nodes: int = 100
    max_depth: int = 3

    def __post_init__(self) -> None:
        if not 1 <= self.max_nodes <= 500 or not 1 <= self.max_depth <= 10:
            raise ValueError("max_nodes is 1 to 500, max_depth 1 to 10")


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("position", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("agent_id", T.StringType()),
        T.StructField("trace_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("occurred_us", T.LongType()), T.StructField("tool_name", T.StringType()), T.StructField("importance_hint", T.IntegerType()),
        T.StructField("access_count", T.LongType()), T.StructField("last_accessed_us", T.LongType()), T.StructField("parent_event_id", T.StringType()),
        T.StructField("status", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("value", T.DoubleType()),
    ]
)
EDGE_SCHEMA = "src string, dst string, edge_type string"
