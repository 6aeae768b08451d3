"""User data: preferences, interests, tool habits, erasure and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import scoring
from emberlake.model import OTHER_STABILITY, PREFERENCE_STABILITY, PREFERENCE_WEIGHTS


def preferences(ledger: DataFrame) -> DataFrame:
    """Preferences that events state: category by event type, key by reference, polarity by the sign of the value."""
    return ledger.select(
        F.concat(F.lit("pref:"), "event_id").alias("preference_id"), "session_id", "user_id", F.split_part("event_type", F.lit("."), F.lit(1)).alias("category"),
        (F.col("k") % 20).alias("key"), F.when(F.col("value") > 50, "positive").otherwise("negative").alias("polarity"), "position", F.col("occurred_us").alias("confirmed_us"),
    )


def tool_preferences(ledger: DataFrame, least: int = 3, success: float = 0.7) -> DataFrame:
    """Tools that an agent has used often and with success: strength grows with use to 0.9."""
    used = ledger.where("tool_name IS NOT NULL").groupBy("agent_id", "tool_name").agg(F.count("*").alias("uses"), F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)).alias("success"))
    return used.where((F.col("uses") >= least) & (F.col("success") > success)).select("agent_id", "tool_name", "uses", F.round(F.least(F.lit(0.9), 0.3 + F.col("uses") / 20.0), 6).alias("strength"))


def interests(ledger: DataFrame, least: int = 5) -> DataFrame:
    """Entities that a user's events refer to at least so often, over how many days."""
    return ledger.groupBy("user_id", F.concat(F.lit("entity:"), "k").alias("entity_id")).agg(F.count("*").alias("mentions"), F.countDistinct("trace_id").alias("days")).where(F.col("mentions") >= least)


def preference_decay(first_us: Column, confirmed_us: Column, category: Column, strength: Column, confidence: Column, now_us: int) -> Column:
    """A preference's score: how much is left of it since it was last confirmed, by its category's stability, with its strength and confidence."""
    table = F.create_map(*[F.lit(x) for p in PREFERENCE_STABILITY.items() for x in p])
    stability = F.coalesce(F.try_element_at(table, category), F.lit(OTHER_STABILITY))
    left = F.exp(-F.greatest(F.lit(0.0), (F.lit(now_us) - F.greatest(first_us, confirmed_us)) / 3_600_000_000.0) / stability)
    w_left, w_strength, w_confidence = PREFERENCE_WEIGHTS
    return w_left * left + w_strength * strength + w_confidence * confidence


# ---- writes: edges (src, dst, edge_type, properties) ----

#: What an edge DERIVED_FROM can start from.
DERIVED_SOURCES = {"preference_id": "Preference", "skill_id": "Skill", "pattern_id": "BehavioralPattern", "workflow_id": "Workflow"}


def edge(src: Column, dst: Column, kind: str, **properties: Column) -> list[Column]:
    pairs = [x for name, value in properties.items() for x in (F.lit(name), value.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), made.alias("properties")]


def derived_from(items: DataFrame, id_field: str) -> DataFrame:
    """DERIVED_FROM edges of items (``id_field``, source_event_ids, method, session_id), one for each source event."""
    if id_field not in DERIVED_SOURCES:
        raise ValueError(f"unknown source {id_field!r}; allowed are {sorted(DERIVED_SOURCES)}")
    each = items.select(id_field, F.explode("source_event_ids").alias("event_id"), "method", "session_id").distinct()
    return each.select(*edge(F.col(id_field), F.col("event_id"), "DERIVED_FROM", method=F.coalesce("method", F.lit("llm_extraction")), session_id=F.coalesce("session_id", F.lit(""))))


def users_of(items: DataFrame) -> DataFrame:
    """The user entities that writes of ``items`` (user_entity_id) need; merge them into the entities."""
    ids = items.select(F.col("user_entity_id").alias("entity_id")).distinct()
    return ids.select("entity_id", F.col("entity_id").alias("name"), F.lit("user").alias("entity_type"), F.lit(1).cast("long").alias("mention_count"))


def preference_edges(items: DataFrame) -> DataFrame:
    """HAS_PREFERENCE, ABOUT (where about_entity is told) and DERIVED_FROM edges of preferences (user_entity_id, preference_id, about_entity, source_event_ids, method, session_id)."""
    owned = items.select(*edge(F.col("user_entity_id"), F.col("preference_id"), "HAS_PREFERENCE"))
    about = items.where("about_entity IS NOT NULL AND about_entity != ''").select(*edge(F.col("preference_id"), F.concat(F.lit("entity:"), "about_entity"), "ABOUT"))
    return owned.unionByName(about).dropDuplicates(["src", "dst", "edge_type"]).unionByName(derived_from(items, "preference_id"))


def skill_edges(items: DataFrame) -> DataFrame:
    """HAS_SKILL edges with proficiency, confidence and source (a half, a half and inferred unless told), and DERIVED_FROM edges of skills."""
    half = F.lit(0.5)
    has = edge(F.col("user_entity_id"), F.col("skill_id"), "HAS_SKILL", proficiency=F.coalesce("proficiency", half), confidence=F.coalesce("confidence", half), source=F.coalesce("source", F.lit("inferred")))
    return items.select(*has).dropDuplicates(["src", "dst", "edge_type"]).unionByName(derived_from(items, "skill_id"))


def interest_edges(items: DataFrame) -> DataFrame:
    """INTERESTED_IN edges of interests (user_entity_id, entity_name, weight, source)."""
    made = items.select(*edge(F.col("user_entity_id"), F.concat(F.lit("entity:"), "entity_name"), "INTERESTED_IN", weight=F.col("weight"), source=F.col("source")))
    return made.dropDuplicates(["src", "dst", "edge_type"])


def feedback_importance(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, importance): 5 if unset, then every vote of ``feedback`` (id, order, delta) in order, each time kept within 1 and 10."""
    votes = feedback.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("order", "delta"))).alias("votes"))
    start = F.coalesce("importance_hint", F.lit(5))
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(10), x))
    return nodes.join(votes, "id").select("id", F.aggregate("votes", start.cast("int"), lambda s, v: clamp(s + v["delta"])).alias("importance"))


def access_reinforced(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """(id, access_count, last_us): accesses from an append-only log (id, us) added to what nodes have."""
    seen = log.groupBy("id").agg(F.count("*").alias("n"), F.max("us").alias("us"))
    return nodes.join(seen, "id", "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), F.greatest("last_accessed_us", "us").alias("last_us"))


#: Edge types whose far ends an erasure deletes, and those that it only cuts.
OWNED, CUT = ["HAS_PROFILE", "HAS_PREFERENCE", "EXHIBITS_PATTERN"], ["HAS_SKILL", "INTERESTED_IN"]


def erase_user(nodes: DataFrame, edges: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, label, name) and edges (src, dst, edge_type) without a user's data, and how many entities were affected (0 or 1).

    The user's profile, preferences and patterns go with all their edges; skill, interest and SAME_AS edges go; the entity
    stays, as REDACTED. Only the user's own node ids are compared with the tables.
    """
    mine = edges.where((F.col("src") == entity_id) & F.col("edge_type").isin(OWNED)).select(F.col("dst").alias("id")).distinct()
    is_user = F.col("id") == entity_id
    left = nodes.join(mine, "id", "left_anti").withColumn("name", F.when(is_user, "REDACTED").otherwise(F.col("name")))
    if "entity_type" in left.columns:
        left = left.withColumn("entity_type", F.when(is_user, "user").otherwise(F.col("entity_type")))
    cut = ((F.col("src") == entity_id) & F.col("edge_type").isin(CUT)) | ((F.col("edge_type") == "SAME_AS") & ((F.col("src") == entity_id) | (F.col("dst") == entity_id)))
    kept = edges.where(~cut).join(mine.withColumnRenamed("id", "src"), "src", "left_anti").join(mine.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept.select(*edges.columns), nodes.where(is_user & (F.col("label") == "Entity")).agg(F.least(F.lit(1), F.count("*")).cast("int").alias("affected"))


def export_user(nodes: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    """(kind, id, body) of all that a user has: profile, preferences, skills, patterns, interests, and what these derive from."""
    kinds = {"HAS_PROFILE": "profile", "HAS_PREFERENCE": "preferences", "HAS_SKILL": "skills", "EXHIBITS_PATTERN": "patterns", "INTERESTED_IN": "interests"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("edge_type"))
    own = edges.where((F.col("src") == entity_id) & F.col("edge_type").isin(list(kinds))).select(kind.alias("kind"), F.col("dst").alias("id"))
    named = own.join(nodes.select("id", F.to_json(F.struct("label", "name")).alias("body")), "id").select("kind", "id", "body")
    chains = edges.where("edge_type = 'DERIVED_FROM'").join(own.select(F.col("id").alias("src")).distinct(), "src")
    return named.unionByName(chains.select(F.lit("provenance_chains").alias("kind"), F.concat("src", F.lit(">"), "dst").alias("id"), F.to_json(F.struct("src", "dst")).alias("body")))


# ---- affinity ----

#: Hours over which a retrieval fades, and days of which a user's entities count as recent.
RETRIEVAL_HOURS, RECENT_DAYS = 168.0, 7


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` (by, time, value) before its own time, null where there is none.

    Both sides go in one sort by time within ``by``, so nothing is joined pair by pair; rows of ``right`` at the very time don't count.
    """
    both = left.withColumn("_told", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0))
    more = right.select(*by, time, F.col(value).alias("_told"), F.lit(1).alias("_side"))
    line = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, -1)
    joined = both.unionByName(more, allowMissingColumns=True).withColumn(value, F.last("_told", ignorenulls=True).over(line))
    return joined.where("_side = 0").drop("_side", "_told")


def affinity_factors(events: DataFrame, preferences: DataFrame, retrievals: DataFrame, references: DataFrame, now_us: int) -> DataFrame:
    """(event_id, preference, retrieval, overlap, affinity): how near each of ``events`` (event_id, user_id, category, occurred_us) is to its user.

    preference: the strength of the user's last preference (user_id, category, occurred_us, strength) of its category before it. retrieval: how recently the user was
    last shown it (user_id, event_id, us). overlap: the entities that it shares with the user's events of the last days, over the larger number of both;
    references: (event_id, entity_id). What isn't there counts as 0.
    """
    told = as_of(events.select("event_id", "user_id", "category", "occurred_us"), preferences, ["user_id", "category"], "occurred_us", "strength")
    shown = retrievals.groupBy("user_id", "event_id").agg(F.max("us").alias("us"))
    recency = F.when(F.col("us").isNotNull(), F.exp(-F.greatest(F.lit(0.0), (F.lit(now_us) - F.col("us")) / scoring.HOUR_US) / RETRIEVAL_HOURS))
    owned = events.select("event_id", "user_id", "occurred_us").join(references.select("event_id", "entity_id").distinct(), "event_id")
    recent = owned.where(F.col("occurred_us") >= now_us - RECENT_DAYS * 24 * int(scoring.HOUR_US)).select("user_id", "entity_id").distinct()
    sizes = recent.groupBy("user_id").agg(F.count("*").alias("theirs"))
    shared = owned.join(recent.withColumn("known", F.lit(1)), ["user_id", "entity_id"], "left").groupBy("event_id", "user_id").agg(F.count("*").alias("own"), F.count("known").alias("shared"))
    overlap = shared.join(sizes, "user_id", "left").select("event_id", (F.col("shared") / F.greatest("own", F.coalesce("theirs", F.lit(0)))).alias("overlap"))
    joined = told.join(shown, ["user_id", "event_id"], "left").join(overlap, "event_id", "left")
    parts = [F.coalesce("strength", F.lit(0.0)), F.coalesce(recency, F.lit(0.0)), F.coalesce("overlap", F.lit(0.0))]
    return joined.select("event_id", *[F.round(x, 6).alias(n) for x, n in zip(parts, ("preference", "retrieval", "overlap"), strict=True)], F.round(scoring.user_affinity(*parts), 6).alias("affinity"))
