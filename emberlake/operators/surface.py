"""What callers see: response nodes, texts, pages, checks of extracted items, user reads, mining."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.model import EDGE_SCHEMA, EVENT_SCHEMA
from emberlake.operators.ordering import with_previous


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The typed tables of a new store; writing them over old ones wipes it."""
    return {"events": spark.createDataFrame([], EVENT_SCHEMA), "edges": spark.createDataFrame([], EDGE_SCHEMA)}


def read_only(spark: SparkSession, statement: str, **parameters) -> DataFrame:
    """An arbitrary SELECT with named parameters."""
    if not statement.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries are allowed")
    return spark.sql(statement, args=parameters)


def bounded(value: int | None, default: int, most: int) -> int:
    """A traversal bound within 1 and ``most``."""
    return max(1, min(default if value is None else int(value), most))


def hyde_query(query: str, hypothetical: str | None) -> str:
    """The text to embed: the question and, if there is one, a hypothetical answer."""
    return query if not (hypothetical or "").strip() else f"{query}\n{hypothetical.strip()}"


def atlas_nodes(events: DataFrame) -> DataFrame:
    """(node_id, node_type, attributes, provenance): what a response tells of each event."""
    attributes = F.map_filter(
        F.create_map(F.lit("event_type"), "event_type", F.lit("tool_name"), "tool_name", F.lit("status"), "status", F.lit("importance_score"), F.col("importance_hint").cast("string")), lambda k, v: v.isNotNull()
    )
    provenance = F.struct("event_id", F.col("position").cast("string").alias("global_position"), "session_id", "agent_id", "trace_id", "occurred_us")
    return events.select(F.col("event_id").alias("node_id"), F.lit("Event").alias("node_type"), attributes.alias("attributes"), provenance.alias("provenance"))


def atlas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document of a bounded result: nodes by id, edges, counts."""
    n = nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", F.to_json(F.struct("node_type", "attributes")).alias("body"))))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges", F.struct(F.size("nodes").alias("nodes_returned")).alias("meta"))).alias("atlas"))


def node_text(columns: list[str], *priority: str) -> Column:
    """The first filled text of a node, by priority."""
    return F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in priority if c in columns], F.lit(""))


def context_lines(nodes: DataFrame) -> DataFrame:
    """One text for each group: ``[type] text (score: x.xx)`` lines, best first."""
    line = F.format_string("[%s] %s (score: %.2f)", "node_type", "text", "score")
    lines = nodes.groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", line.alias("line")))).alias("l"))
    return lines.select("group", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def markdown(nodes: DataFrame, width: int = 120) -> DataFrame:
    """(node_type, section): a heading and a bullet for each node, cut at ``width``."""
    bullet = F.concat(F.lit("- "), F.when(F.length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("…"))).otherwise(F.col("text")))
    grouped = nodes.groupBy("node_type").agg(F.array_sort(F.collect_list(F.struct("id", bullet.alias("b")))).alias("l"))
    return grouped.select("node_type", F.concat(F.lit("## "), "node_type", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["b"]), "\n")).alias("section"))


def parsed_items(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Items of a JSON array column ``items``, one row each; those that lack a required field are dropped."""
    each = raw.select("id", F.posexplode(F.from_json("items", f"array<{schema}>")).alias("pos", "item"))
    good = each
    for name in required:
        good = good.where(F.col(f"item.{name}").isNotNull())
    return good.select("id", "pos", "item.*")


def stream_key(stream_id: Column) -> Column:
    """A stream id as a pair of numbers, which sorts as the stream does."""
    return F.struct(F.split_part(stream_id, F.lit("-"), F.lit(1)).try_cast("long").alias("ms"), F.split_part(stream_id, F.lit("-"), F.lit(2)).try_cast("long").alias("seq"))


def summary_prompts(events: DataFrame) -> DataFrame:
    """One prompt for each session: its events in order."""
    line = F.concat(F.lit("- "), "event_type", F.coalesce(F.concat(F.lit(" ["), "tool_name", F.lit("]")), F.lit("")), F.lit(" "), "status")
    lines = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("occurred_us", "position", line.alias("line")))).alias("l"))
    return lines.select("session_id", F.concat(F.lit("Summarise "), F.size("l").cast("string"), F.lit(" events:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))


def summarizes_edges(events: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """SUMMARIZES edges from each summary to its events."""
    return events.join(summaries.select(*keys, "summary_id"), keys).select(F.col("summary_id").alias("src"), F.col("event_id").alias("dst"), F.lit("SUMMARIZES").alias("edge_type"))


def forgotten(nodes: DataFrame, now_us: int, r) -> DataFrame:
    """(action, n): what a forgetting run would do, by action."""
    from emberlake.operators.retention import actions

    return actions(nodes, now_us, r).groupBy("tier", "action").agg(F.count("*").alias("n"))


def capped_ids(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` ids, by length and text, with whether there were more: a dry run's report."""
    top = found.select("event_id").orderBy(F.length("event_id"), "event_id").limit(most + 1)
    rn = F.row_number().over(Window.orderBy(F.length("event_id"), "event_id"))
    return top.withColumns({"rn": rn, "truncated": F.count("*").over(Window.partitionBy()) > most}).where(F.col("rn") <= most).drop("rn")


def workflow_patterns(ledger: DataFrame, length: int = 3, least: int = 2) -> DataFrame:
    """(pattern, n, sessions): runs of event types that sessions share."""
    runs = ledger.select("session_id", "occurred_us", "position", F.col("event_type").alias("s0"))
    for k in range(1, length):  # s1 is what came before s0, and so on
        runs = with_previous(runs, [f"s{k - 1}"]).withColumn(f"s{k}", F.col(f"before.s{k - 1}")).drop("before")
    runs = runs.where(F.col(f"s{length - 1}").isNotNull())
    pattern = F.concat_ws(" > ", *[f"s{k}" for k in reversed(range(length))])
    return runs.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions")).where(F.col("sessions") >= least)


def mentioned(docs: DataFrame) -> DataFrame:
    """(id, kind, value) of addresses, links and capitalised pairs that rules find in texts."""
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "url": r"https?://[^\s)>]+", "handle": r"@[A-Za-z0-9_]{3,}"}

    def hits(kind: str, rule: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(f"({rule})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[hits(k, r) for k, r in rules.items()])
    return docs.select("id", F.explode(found).alias("m")).select("id", "m.*").distinct()


def embedded(texts: DataFrame, width: int = 64) -> DataFrame:
    """(id, vector): a deterministic unit vector of hashed words, where no model is at hand."""
    import zlib

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"].fillna(""):
                v = np.zeros(width)
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % width] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"id": b["id"], "vector": out})

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, vector array<double>")


def chained(events: DataFrame) -> DataFrame:
    """(event_id, parent_event_id): a session recorded step by step, each event following from the one before."""
    told = with_previous(events.select("event_id", "session_id", "occurred_us", "position"), ["event_id"])
    return told.select("event_id", F.col("before.event_id").alias("parent_event_id"))


def resolved(new: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, action, target): alias, then fuzzy, then semantic resolution, else CREATE.

    new and known: ordinal, name, entity_type; pairs: name, target, similarity.
    """
    from emberlake.operators.resolution import by_alias, fuzzy

    a = by_alias(new, known).select("name", F.struct("action", "target").alias("a"))
    f = fuzzy(new, known).select("name", F.struct("action", "target").alias("f"))
    best = pairs.where("similarity >= 0.75").groupBy("name").agg(F.min_by(F.struct(F.when(F.col("similarity") >= 0.9, "SAME_AS").otherwise("RELATED_TO").alias("action"), "target"), -F.col("similarity")).alias("s"))
    joined = new.select("name").join(a, "name", "left").join(f, "name", "left").join(best, "name", "left")
    hit = F.coalesce("a", "f", "s")
    return joined.select("name", F.coalesce(hit["action"], F.lit("CREATE")).alias("action"), hit["target"].alias("target"))


def has_user_data(session: DataFrame, references: DataFrame, owners: DataFrame) -> DataFrame:
    """Events whose entity has a profile or a preference; ``owners``: entity_id of either edge."""
    linked = references.join(owners.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi")
    return session.join(linked.select(F.col("src").alias("event_id")), "event_id", "left_semi")


def provenance(preferences: DataFrame, skills: DataFrame) -> DataFrame:
    """(kind, id, user_id, event_id): what preferences and skills are derived from."""
    return preferences.select(F.lit("preference").alias("kind"), F.col("preference_id").alias("id"), "user_id", "event_id").unionByName(skills.select(F.lit("skill").alias("kind"), F.col("skill_id").alias("id"), "user_id", "event_id"))


def event_counts(events: DataFrame, caused: DataFrame, references: DataFrame, similar: DataFrame, owners: DataFrame) -> DataFrame:
    """(event_id, children, entities, profiles, similar): what each event has caused, refers to, refers to with a profile (``owners``: entity_id), and is similar to, either way."""
    counted = lambda df, end, name: df.groupBy(F.col(end).alias("event_id")).agg(F.count("*").alias(name))
    both = similar.select(F.col("src").alias("id")).unionByName(similar.select(F.col("dst").alias("id")))
    linked = references.join(owners.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi")
    out = events.select("event_id")
    for part in (counted(caused, "dst", "children"), counted(references, "src", "entities"), counted(linked, "src", "profiles"), counted(both, "id", "similar")):
        out = out.join(part, "event_id", "left")
    return out.na.fill(0)


#: Where a memory's text is looked for, in this order. Fixed values.
TEXT_KEYS = ("content", "payload_ref", "summary", "text", "belief_text", "description", "name")


def recalled(nodes: DataFrame, top_k: int, score: str = "decay") -> DataFrame:
    """(id, text, score, rank): the ``top_k`` nodes of the best score as flat memories, with the first filled text; ids decide between equals."""
    told = nodes.select("id", node_text(nodes.columns, *TEXT_KEYS).alias("text"), F.col(score).alias("score"))
    top = told.orderBy(F.col("score").desc_nulls_last(), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "id")))
