"""Graph operators over edge tables: lineage, neighbours, PageRank, components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.model import INTENT_WEIGHTS


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='emberlake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that loops keep short plans."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Starts whose paths one task puts together, about.
STARTS = 100_000


def lineage(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, ancestor, depth) along ``edges`` (src to dst) from ``starts`` (id), up to ``max_depth`` (at most 10) hops.

    Paths never visit a node twice; of several paths the shortest tells the depth.
    """
    steps = edges.select("src", "dst").hint("merge")  # a table of the ledger's size isn't held ten times in each task
    # One chain of joins: a path that ends early is carried along under its start, which spreads such paths over all tasks; all of its nodes are told at the end.
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    for _ in range(max(1, min(max_depth, 10))):
        at = front.withColumn("at", F.coalesce("node", "start"))
        joined = at.join(steps, (at["at"] == steps["src"]) & at["node"].isNotNull(), "left")
        goes_on = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        front = joined.select("start", F.when(goes_on, F.col("dst")).alias("node"), F.when(goes_on, F.array_append("path", F.col("dst"))).otherwise(F.col("path")).alias("path"))
    # All nodes of a start in one task, which holds a bounded number of starts however few files and partitions they come from.
    front = front.repartition(max(1, -(-starts.count() // STARTS)), "start")
    told = front.select("start", F.posexplode("path").alias("depth", "ancestor")).where("depth > 0")
    return told.groupBy("start", "ancestor").agg(F.min("depth").alias("depth"))


#: Most hops and most nodes of a traversal. Fixed values.
MOST_HOPS, MOST_NODES = 10, 500


def bounded_lineage(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_nodes: int = 100, edge_types: tuple[str, ...] = ("CAUSED_BY",)) -> tuple[DataFrame, DataFrame]:
    """What ``starts`` (id) lead to along some types of ``edges`` (src, dst, edge_type): nodes (start, node, depth) and the edges (start, src, dst, edge_type) among them.

    Breadth first, a round of joins for each hop, until no start has a new node: each start gets at most ``max_nodes`` nodes besides itself, nearer ones
    first, then smaller ids; what is left out isn't followed further. A start without any ancestor gives no rows.
    """
    depth, most = max(1, min(max_depth, MOST_HOPS)), max(1, min(max_nodes, MOST_NODES))
    kept = edges.where(F.col("edge_type").isin(*edge_types))
    # A start takes at most ``most`` nodes of one source and has at most ``most`` + 1 already, so a source's next ones are never taken.
    place = F.dense_rank().over(Window.partitionBy("src").orderBy("dst"))
    steps = cut(kept.select("src", "dst", place.alias("place")).where(F.col("place") <= 2 * most + 1).select("src", "dst"))
    # A row for each start with what it has, at most ``most`` nodes and itself; one that is full or has no new node is done and isn't read again.
    rows = starts.select(F.col("id").alias("start")).distinct()
    rows = rows.select("start", F.array("start").alias("nodes"), F.array(F.lit(0)).alias("depths"), F.array("start").alias("front"))
    done = []
    for hop in range(1, depth + 1):
        hits = rows.select("start", F.explode("front").alias("src")).join(steps, "src").groupBy("start").agg(F.collect_set("dst").alias("hits"))
        new = F.slice(F.array_sort(F.array_except("hits", "nodes")), 1, most + 1 - F.size("nodes"))
        told = rows.join(hits, "start", "left").withColumn("front", F.coalesce(new, F.array().cast("array<string>")))
        nodes, depths = F.concat("nodes", "front"), F.concat("depths", F.array_repeat(F.lit(hop), F.size("front")))
        rows = cut(told.select("start", nodes.alias("nodes"), depths.alias("depths"), "front", ((F.size("front") > 0) & (F.size(nodes) <= most)).alias("open")))
        done.append(rows if hop == depth else rows.where("NOT open"))
        rows = rows.where("open").drop("open")
        if hop == depth or rows.isEmpty():
            break
    seen = functools.reduce(DataFrame.unionByName, [d.where("size(nodes) > 1").select("start", "nodes", "depths") for d in done])
    each = seen.select("start", F.explode(F.arrays_zip("nodes", "depths")).alias("e")).select("start", F.col("e.nodes").alias("node"), F.col("e.depths").alias("depth"))
    among = each.select("start", F.col("node").alias("src")).join(kept.select("src", "dst", "edge_type").distinct(), "src")
    among = among.join(seen.select("start", "nodes"), "start").where(F.array_contains("nodes", F.col("dst")))
    return each.where("depth > 0"), among.select("start", "src", "dst", "edge_type")


def neighbours(edges: DataFrame, seeds: DataFrame, per_seed: int | None = None) -> DataFrame:
    """(seed, dst, edge_type) of the outgoing edges of distinct ``seeds`` (id), all or the first ``per_seed`` of each by type and end; seeds without any stay, with nulls."""
    distinct = seeds.select(F.col("id").alias("seed")).distinct()
    joined = distinct.join(edges.select(F.col("src").alias("seed"), "dst", "edge_type"), "seed", "left")
    if per_seed is None:
        return joined
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("edge_type", "dst"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= per_seed).drop("rank")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def centrality_importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, importance_score): many incoming edges raise the importance to 10, 8 or 6, else it stays (5 if unset)."""
    n = F.col("in_degree")
    raised = F.when(n >= 10, 10).when(n >= 5, 8).when(n >= 3, 6).otherwise(F.coalesce("importance_score", F.lit(5)))
    return nodes.select("id", "importance_score").join(in_degree(edges), "id").select("id", "in_degree", raised.alias("importance_score"))


def weighted_both_ways(edges: DataFrame, intent: str = "general", default: float = 1.0) -> DataFrame:
    """(src, dst, w): each edge in both directions with its type's weight for an intent."""
    weights = F.create_map(*[F.lit(x) for pair in INTENT_WEIGHTS[intent].items() for x in pair])
    w = F.coalesce(F.try_element_at(weights, F.col("edge_type")), F.lit(default)).alias("w")
    return edges.select("src", "dst", w).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w))


def personalised_pagerank(adjacency: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 5) -> DataFrame:
    """(id, score) after some rounds of power iteration from ``seeds`` (id); empty without a known seed.

    Mass at nodes without outgoing edges returns to the seeds, so each round keeps the sum at one
    and needs no scaling. A round is one table in the shared folder.
    """
    links = adjacency.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = links.groupBy("src").agg(F.sum("w").alias("out"))
    share = cut(links.join(total, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    ids = share.select(F.col("src").alias("id")).union(share.select(F.col("dst").alias("id"))).distinct()
    known = seeds.select("id").distinct().join(ids, "id", "left_semi")
    start = ids.join(known.withColumn("seed", F.lit(1)), "id", "left").join(share.select(F.col("src").alias("id"), F.lit(1).alias("has_out")).distinct(), "id", "left")
    one = F.coalesce("seed", F.lit(0))
    rank = start.join(F.broadcast(known.agg(F.count("*").alias("n")))).where("n > 0").select("id", (one / F.col("n")).alias("restart"), (one / F.col("n")).alias("score"), F.col("has_out").isNull().alias("sink"))
    rank = cut(rank)
    for _ in range(rounds):
        moved = rank.join(share, rank["id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("p")).alias("moved"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0)).alias("lost"))
        joined = rank.join(moved, rank["id"] == moved["dst"], "left").join(F.broadcast(lost))  # one row
        score = damping * (F.coalesce("moved", F.lit(0.0)) + F.col("lost") * F.col("restart")) + (1 - damping) * F.col("restart")
        rank = cut(joined.select("id", "restart", score.alias("score"), "sink"))
    return rank.select("id", "score")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each node's component; node ids of ``edges`` (a, b) are strings.

    Labels spread to neighbours and jump to their own label's label each round, until none changes.
    """
    both = cut(edges.select("a", "b").where("a != b").union(edges.select("b", "a").where("a != b")).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = spread.select(F.col("id").alias("at"), F.col("to").alias("beyond"))
        moved = spread.join(jump, spread["to"] == jump["at"], "left").select("id", F.least("to", F.coalesce("beyond", "to")).alias("label"), "was")
        moved = cut(moved)
        labels = moved.select("id", "label")
        if moved.where("label != was").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def canonical_members(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, component, canonical): of each component the member with most mentions, then the smallest id."""
    members = components(edges).join(mentions, "id", "left").withColumn("n", F.coalesce("mention_count", F.lit(0)))
    best = members.groupBy("component").agg(F.min_by("id", F.struct(-F.col("n"), "id")).alias("canonical"))
    return members.join(best, "component").select("id", "component", "canonical")


def cluster_within(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(start, id) of what lies within some undirected hops of ``seeds`` (id), themselves included."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    reached = seeds.select(F.col("id").alias("start"), "id")
    for _ in range(hops):
        more = reached.join(both, reached["id"] == both["a"]).select("start", F.col("b").alias("id"))
        reached = reached.union(more).distinct()
    return reached


def expanded(edges: DataFrame, seeds: DataFrame, hops: int = 2, fade: float = 0.5) -> DataFrame:
    """(id, score): best product of seed score and edge weight / 5 * ``fade`` per hop, within some hops of ``seeds`` (id, score)."""
    reached, front = seeds.select("id", "score"), seeds.select("id", "score")
    for _ in range(hops):
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("score") * fade * F.least(F.lit(1.0), F.col("w") / 5)).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
        reached = reached.unionByName(front)
    return reached.groupBy("id").agg(F.max("score").alias("score"))
