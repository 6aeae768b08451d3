"""Scored contexts, seeds, rank fusion, text and vector search, the subgraph query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import scoring, text
from emberlake.model import INTENT_WEIGHTS, INTENTS, OTHER_SIGNAL, PROACTIVE_SIGNALS, SEED_STRATEGIES, Decay, SubgraphQuery
from emberlake.operators import graph, projection


def scored_events(events: DataFrame, now_us: int, relevance: Column | None = None, d: Decay = Decay()) -> DataFrame:
    """``events`` with recency, importance, relevance and decay (the composite), rounded."""
    recency = scoring.recency(F.col("occurred_us"), F.col("last_accessed_us"), F.col("access_count"), now_us, d.base, d.boost)
    importance = scoring.importance(F.col("importance_hint"), F.col("access_count"), F.lit(0))
    near = relevance if relevance is not None else F.lit(0.5)
    raw = events.withColumns({"recency_raw": recency, "importance_raw": importance, "relevance_raw": near})
    decay = scoring.composite(F.col("recency_raw"), F.col("importance_raw"), F.col("relevance_raw"), F.lit(0.0), d)
    return raw.select(
        *events.columns, F.round("recency_raw", 6).alias("recency"), F.round("relevance_raw", 6).alias("relevance"),
        F.coalesce("importance_hint", F.bround(F.col("importance_raw") * 10).cast("int")).alias("importance"), F.round(decay, 6).alias("decay"),
    )


def scored_entities(entities: DataFrame, now_us: int, d: Decay = Decay()) -> DataFrame:
    """Entities by their last mention; mentions count as accesses and, up to ten, as importance."""
    recency = scoring.recency(F.col("last_seen_us"), F.lit(None).cast("long"), F.col("mention_count"), now_us, d.entity_base, d.entity_boost)
    importance = scoring.importance(F.least(F.col("mention_count"), F.lit(10)), F.col("mention_count"), F.lit(0))
    return entities.select("entity_id", F.round(recency, 6).alias("recency"), F.round(importance, 6).alias("importance"), F.round(scoring.composite(recency, importance, F.lit(0.5), F.lit(0.0), d), 6).alias("decay"))


def context(ledger: DataFrame, session_id: str, n: int, now_us: int) -> DataFrame:
    """The newest ``n`` events of a session, scored, best first."""
    own = ledger.where(F.col("session_id") == session_id).orderBy(F.col("occurred_us").desc(), F.col("position").desc()).limit(n)
    return scored_events(own, now_us).orderBy(F.col("decay").desc(), "position")


# ---- seeds: (id, rank) ----


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def causal_roots(session: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Events that most others follow from."""
    children = edges.where("edge_type = 'CAUSED_BY'").groupBy(F.col("dst").alias("event_id")).agg(F.count("*").alias("n"))
    top = session.join(children, "event_id").select(F.col("event_id").alias("id"), "n", "position").orderBy(F.col("n").desc(), "position").limit(n)
    return ranked(top, F.col("n").desc(), F.col("position"))


def entity_hubs(session: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """Entities that most events of the session refer to."""
    counts = session.join(references, session["event_id"] == references["src"]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return ranked(counts.orderBy(F.col("n").desc(), "id").limit(n), F.col("n").desc(), F.col("id"))


def temporal_anchors(session: DataFrame, n: int) -> DataFrame:
    """Most important events, oldest first among equals."""
    top = session.where("importance_hint IS NOT NULL").select(F.col("event_id").alias("id"), "importance_hint", "occurred_us", "position").orderBy(F.col("importance_hint").desc(), "occurred_us", "position").limit(n)
    return ranked(top, F.col("importance_hint").desc(), F.col("occurred_us"), F.col("position"))


def workflow_pattern(session: DataFrame, n: int) -> DataFrame:
    """Tool and workflow events, oldest first."""
    top = session.where(F.col("event_type").startswith("tool.") | F.col("event_type").startswith("workflow.")).select(F.col("event_id").alias("id"), "occurred_us", "position").orderBy("occurred_us", "position").limit(n)
    return ranked(top, F.col("occurred_us"), F.col("position"))


def similar_cluster(session: DataFrame, similar: DataFrame, n: int) -> DataFrame:
    """Events with most similar ones, whichever way the edges point."""
    ends = similar.select(F.col("src").alias("event_id")).unionByName(similar.select(F.col("dst").alias("event_id")))
    counts = session.join(ends, "event_id").groupBy(F.col("event_id").alias("id"), "position").agg(F.count("*").alias("n"))
    return ranked(counts.orderBy(F.col("n").desc(), "position").limit(n), F.col("n").desc(), F.col("position"))


def reciprocal(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("score", 1 / F.col("rank").cast("double"))


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``lists`` (id, rank from 1): sum of 1 / (k + rank)."""
    return lists.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank")).cast("double")).alias("rrf"))


# ---- intents ----


def intents(queries: DataFrame) -> DataFrame:
    """(qid, ordinal, intent, confidence) of ``queries`` (qid, text): 0.4 a key word, at most 1, the best scaled to 1; without any, general at 0.5.

    One pass over each text and nothing between rows, so no shuffle.
    """
    names = list(INTENTS)
    found = queries.select("qid", text.intent_words(F.coalesce("text", F.lit(""))).alias("words"))
    score = lambda n: F.least(F.lit(1.0), text.intent_hits(F.col("words"), n) * 0.4)
    every = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("intent"), score(n).alias("score")) for i, n in enumerate(names)])
    scored = found.select("qid", F.filter(every, lambda x: x["score"] > 0).alias("hits"))
    best = F.array_max(F.transform("hits", lambda x: x["score"]))
    some = F.transform("hits", lambda x: F.struct(x["ordinal"].alias("ordinal"), x["intent"].alias("intent"), (x["score"] / best).alias("confidence")))
    none = F.array(F.struct(F.lit(len(names)).alias("ordinal"), F.lit("general").alias("intent"), F.lit(0.5).alias("confidence")))
    return scored.select("qid", F.explode(F.when(F.size("hits") > 0, some).otherwise(none)).alias("h")).select("qid", "h.*")


def edge_weights(found: DataFrame) -> DataFrame:
    """(qid, edge_type, weight): the weight rows of a query's intents, scaled by confidence and added."""
    rows = [(i, e, w) for i, row in INTENT_WEIGHTS.items() for e, w in row.items()]
    matrix = found.sparkSession.createDataFrame(rows, "intent string, edge_type string, w double")
    return found.join(F.broadcast(matrix), "intent").groupBy("qid", "edge_type").agg(F.sum(F.col("confidence") * F.col("w")).alias("weight"))


def strategies(found: DataFrame) -> DataFrame:
    """(qid, strategy) of the strongest intent, the first declared among equals."""
    best = found.groupBy("qid").agg(F.min_by("intent", F.struct(-F.col("confidence"), "ordinal")).alias("intent"))
    return best.select("qid", "intent", F.element_at(text.literal_map(SEED_STRATEGIES), F.col("intent")).alias("strategy"))


# ---- text and vectors ----


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of ``docs`` (id, text): counts of terms, and of all terms of the document."""
    split = docs.select("id", text.tokens(F.col("text")).alias("terms"))
    return split.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents for some terms by BM25, with their scores.

    Only the postings of the asked terms leave the scan; lengths and document counts are plain aggregates.
    """
    lengths = docs.select("id", F.size(text.tokens(F.col("text"))).alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    hits = docs.select("id", text.tokens(F.col("text")).alias("terms")).select("id", F.size("terms").alias("dl"), F.explode(F.filter("terms", lambda t: t.isin(terms))).alias("term"))
    tf = hits.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most as many rows as terms
    joined = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("id").agg(F.round(F.sum(part), 5).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def mmr(candidates: DataFrame, n: int, diversity: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance per query over ``candidates`` (qid, id, relevance, vector): (qid, id, rank, mmr).

    All candidates of a query are ranked, in one task: pass a page of a bounded size.
    """
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        v = np.stack(rows["vector"].to_numpy())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel = rows["relevance"].to_numpy(float)
        rel = (rel - rel.min()) / (rel.max() - rel.min()) if rel.max() > rel.min() else np.ones_like(rel)
        near, free, out = np.zeros(len(rel)), np.ones(len(rel), bool), []
        for rank in range(1, min(n, len(rel)) + 1):
            value = np.where(free, diversity * rel - (1 - diversity) * near, -np.inf)
            k = int(value.argmax())
            out.append((rows["qid"].iloc[0], rows["id"].iloc[k], rank, round(float(value[k]), 6)))
            free[k], near = False, np.maximum(near, v @ v[k])
        return pd.DataFrame(out, columns=["qid", "id", "rank", "mmr"])

    return candidates.groupBy("qid").applyInPandas(pick, "qid string, id string, rank int, mmr double")


# ---- cross-session ----


def bridges(session: DataFrame, ledger: DataFrame, references: DataFrame, session_id: str, n: int) -> DataFrame:
    """The newest events of other sessions that refer to entities of this one."""
    entities = references.join(session.select(F.col("event_id").alias("src")), "src", "left_semi").select("dst").distinct()
    other = references.join(entities, "dst", "left_semi").select(F.col("src").alias("event_id"), F.col("dst").alias("entity_id"))
    found = ledger.where(F.col("session_id") != session_id).join(other, "event_id")
    return found.select("event_id", "session_id", "entity_id", "occurred_us", "position").orderBy(F.col("occurred_us").desc(), F.col("position").desc()).limit(max(1, n // 5))


def context_response(ledger: DataFrame, session_id: str, n: int, now_us: int) -> DataFrame:
    """A session's newest ``n`` events as a response: rows of kind node (id, decay, rank), edge (src, dst, edge_type; those among the nodes) and page (id: the cursor of the next page, has_more)."""
    session = ledger.where(F.col("session_id") == session_id)
    order = [F.col("occurred_us").desc(), F.col("position").desc()]
    fetched = session.orderBy(*order).limit(n + 1)  # one more tells whether there is another page
    numbered = fetched.withColumns({"rn": F.row_number().over(Window.orderBy(*order)), "fetched": F.count("*").over(Window.partitionBy())})
    own = graph.cut(numbered.where(F.col("rn") <= n))
    nodes = ranked(scored_events(own, now_us).select(F.col("event_id").alias("id"), "decay", "position"), F.col("decay").desc(), F.col("position")).drop("position")
    edges = projection.among(projection.event_edges(session), own.select(F.col("event_id").alias("id"))).select("src", "dst", "edge_type").distinct()
    last = own.orderBy(F.col("rn").desc()).limit(1)
    cursor = F.when(F.col("fetched") > n, text.cursor(F.col("occurred_us"), F.col("event_id")))
    page = last.select(cursor.alias("id"), (F.col("fetched") > n).alias("has_more"))
    out = nodes.withColumn("kind", F.lit("node")).unionByName(edges.withColumn("kind", F.lit("edge")), allowMissingColumns=True)
    return out.unionByName(page.withColumn("kind", F.lit("page")), allowMissingColumns=True)


def expanded(seeds: DataFrame, edges: DataFrame, weights: dict[str, float], per_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What one hop from ``seeds`` (id) leads to, along all edges or the first ``per_seed`` of each: nodes (id, w, signal) and the edges (src, dst, edge_type) that do.

    A node takes the weight and the signal of the strongest edge that leads to it, of equals the first type. A seed isn't its own neighbour.
    """
    near = graph.cut(graph.neighbours(edges, seeds, per_seed).where("dst IS NOT NULL AND dst != seed"))
    weight = F.coalesce(F.try_element_at(text.literal_map(weights), F.col("edge_type")), F.lit(1.0))
    signal = F.coalesce(F.try_element_at(text.literal_map(PROACTIVE_SIGNALS), F.col("edge_type")), F.lit(OTHER_SIGNAL))
    best = near.groupBy(F.col("dst").alias("id")).agg(F.min_by(F.struct(weight.alias("w"), signal.alias("signal")), F.struct(-weight, "edge_type")).alias("b"))
    return best.select("id", "b.*"), near.select(F.col("seed").alias("src"), "dst", "edge_type").distinct()


def subgraph(
    ledger: DataFrame, references: DataFrame, similar: DataFrame, q: SubgraphQuery, now_us: int, seeds: int = 10, entities: DataFrame | None = None, owners: DataFrame | None = None, given: DataFrame | None = None, per_seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The intent-aware subgraph of a session: seeds by strategy and recency fused, what they lead to boosted, best first.

    entities: known ones with their scores' columns, which seeds refer to. owners: entity_id of the entities with a profile or a preference, for
    questions about the user. given: ids to start from instead of a strategy's; unknown ones stay, without a score. per_seed: edges that are
    followed from each seed, by default all.
    Returns nodes (id, node_type, source, signal, decay, rank) and the edges among them. Only the query's intents, one row, reach the driver.
    """
    spark = ledger.sparkSession
    asked = intents(spark.createDataFrame([(0, q.text)], "qid int, text string"))
    weights = {r["edge_type"]: r["weight"] for r in edge_weights(asked).collect()}  # at most one row for each edge type
    session = ledger.where(F.col("session_id") == q.session_id)
    own_edges = projection.event_edges(session)
    if given is None:
        strategy = strategies(asked).first()["strategy"]  # one row
        chosen = {
            "causal_roots": lambda: causal_roots(session, own_edges, seeds), "temporal_anchors": lambda: temporal_anchors(session, seeds), "workflow_pattern": lambda: workflow_pattern(session, seeds),
            "similar_cluster": lambda: similar_cluster(session, similar, seeds), "entity_hubs": lambda: hub_events(session, references, seeds), "user_profile": lambda: user_profile_seeds(session, references, owners, seeds), "general": lambda: newest(session, seeds),
        }[strategy]()
        given = fused(chosen.select("id", "rank").unionByName(newest(session, seeds).select("id", "rank"))).orderBy(F.col("rrf").desc(), "id").limit(seeds)
    start = graph.cut(given.select("id").distinct())
    edges = own_edges.unionByName(similar.select("src", "dst", "edge_type")).unionByName(references.select("src", "dst", "edge_type")).join(F.broadcast(start.withColumnRenamed("id", "src")), "src", "left_semi")
    near, led = expanded(start, edges, weights, per_seed)
    near = near.join(start, "id", "left_anti")
    event = lambda rows, score: rows.select(F.col("event_id").alias("id"), F.lit("Event").alias("node_type"), score.alias("decay"))
    own = start.join(event(scored_events(ledger.join(F.broadcast(start.withColumnRenamed("id", "event_id")), "event_id", "left_semi"), now_us), F.col("decay")), "id", "left")
    own = own.select("id", F.coalesce("node_type", F.lit("Unknown")).alias("node_type"), F.lit("seed").alias("source"), F.lit(None).cast("string").alias("signal"), "decay")
    around = event(scored_events(ledger.join(near.select(F.col("id").alias("event_id")), "event_id", "left_semi"), now_us), F.col("decay"))
    if entities is not None:
        found = scored_entities(entities.join(near.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), now_us)
        around = around.unionByName(found.select(F.col("entity_id").alias("id"), F.lit("Entity").alias("node_type"), "decay"))
    around = around.join(near, "id").select("id", "node_type", F.lit("proactive").alias("source"), "signal", scoring.boosted(F.col("decay"), F.col("w")).alias("decay"))
    best = [F.col("decay").desc_nulls_last(), F.length("id"), F.col("id")]
    top = graph.cut(own.unionByName(around).withColumn("decay", F.round("decay", 6)).orderBy(*best).limit(q.max_nodes))
    ids = top.select("id")
    return ranked(top, *best), projection.among(led, ids)


#: What PageRank weighs in a blend, and how many nodes a graph may have for one. Fixed values.
PPR_WEIGHT, PPR_MOST = 0.3, 500


def blended(nodes: DataFrame, ranks: DataFrame, weight: float = PPR_WEIGHT, most: int = PPR_MOST, enabled: bool = True) -> DataFrame:
    """``nodes`` (id, decay, ...) with decay blended with PageRank (id, score) times the number of nodes; a graph of over ``most`` nodes, or one with blending off, stays as it is."""
    if not enabled:
        return nodes
    n = nodes.agg(F.count("*").alias("n"))  # one row
    joined = nodes.join(ranks.select("id", "score"), "id", "left").join(F.broadcast(n))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)) * F.col("n")))
    return joined.withColumn("decay", F.when(F.col("n") > most, F.col("decay")).otherwise((1 - weight) * F.col("decay") + weight * near)).drop("score", "n")


def newest(session: DataFrame, n: int) -> DataFrame:
    """The newest events."""
    order = [F.col("occurred_us").desc(), F.col("position").desc()]
    return ranked(session.select(F.col("event_id").alias("id"), "occurred_us", "position").orderBy(*order).limit(n), *order)


def user_profile_seeds(session: DataFrame, references: DataFrame, owners: DataFrame | None, n: int) -> DataFrame:
    """Events that refer to most entities with a profile or a preference; without any such entity, none."""
    if owners is None:
        owners = references.select(F.col("dst").alias("entity_id")).limit(0)
    linked = references.join(owners.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("event_id")).agg(F.count("*").alias("links"))
    order = [F.col("links").desc(), F.col("occurred_us").desc(), F.col("position").desc()]
    return ranked(session.join(linked, "event_id").select(F.col("event_id").alias("id"), "links", "occurred_us", "position").orderBy(*order).limit(n), *order)


def hub_events(session: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """Events of the session that refer to its hub entities: entity seeds as events."""
    hubs = entity_hubs(session, references, n)
    events = session.join(references, session["event_id"] == references["src"]).join(F.broadcast(hubs.select(F.col("id").alias("dst"), F.col("rank").alias("hub"))), "dst")
    top = events.select(F.col("event_id").alias("id"), "hub", "occurred_us", "position").orderBy("hub", F.col("occurred_us").desc(), "position").limit(n)
    return ranked(top, F.col("hub"), F.col("occurred_us").desc(), F.col("position"))
