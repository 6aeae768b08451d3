"""Upserts and deletions over plain tables: what a merge would do, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.model import EDGE_TYPES

#: The column that names a node, by label.
NODE_KEYS = {"Summary": "summary_id", "Belief": "belief_id", "Goal": "goal_id", "Episode": "episode_id"}
EDGE_KEYS = ["src", "dst", "edge_type"]

def last_write(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return changes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge(old: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the last change of each key in place of, or besides, its rows."""
    new = last_write(changes, keys, order).drop(order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_counting(old: DataFrame, changes: DataFrame, key: str, kept: list[str], counter: str) -> DataFrame:
    """Old values stay where they are set, else the first change's count; ``counter`` grows by the number of changes."""
    new = changes.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(f"new_{c}") for c in kept], F.count("*").alias("times"))
    both = old.join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(c, f"new_{c}").alias(c) for c in kept], (F.coalesce(counter, F.lit(0)) + F.coalesce("times", F.lit(0))).alias(counter))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` (id) and the edges at them."""
    left = nodes.join(gone, "id", "left_anti")
    cut = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, cut


def merge_properties(old: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the properties that changes give: of each property the last value that isn't null; what no change names stays.

    A null in a change means that it says nothing of the property. New keys become new rows; columns that only one side has are kept.
    """
    given = [c for c in changes.columns if c not in (*keys, order)]
    new = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in given])
    names = [c for c in old.columns if c not in keys] + [c for c in given if c not in old.columns]
    value = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in old.columns else F.col(f"new_{c}") for c in given}
    return old.join(new, keys, "full_outer").select(*keys, *[value.get(c, F.col(c)).alias(c) for c in names])


def merge_nodes(label: str, old: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Summary, Belief, Goal and Episode nodes with their changes, by the id of the label."""
    return merge_properties(old, changes, [NODE_KEYS[label]], order)


def typed_edges(edge_type: str, rows: DataFrame) -> DataFrame:
    """``rows`` (src, dst, props) as edges of one type, which must be known."""
    if edge_type not in EDGE_TYPES:
        raise ValueError(f"unknown edge type {edge_type}")
    return rows.withColumn("edge_type", F.lit(edge_type))


def merge_edges(old: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Edges (src, dst, edge_type, props) with the changes of all types in one pass; of each property the last value stays, types unheard of are skipped.

    props: map of strings.
    """
    known = changes.where(F.col("edge_type").isin(EDGE_TYPES))
    flat = known.select(*EDGE_KEYS, order, F.explode_outer("props").alias("name", "value"))
    last = flat.groupBy(*EDGE_KEYS, "name").agg(F.max_by("value", order).alias("value"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    new = last.groupBy(*EDGE_KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("given"))
    both = F.map_zip_with("props", "given", lambda _, a, b: F.coalesce(b, a))
    return old.join(new, EDGE_KEYS, "full_outer").select(*EDGE_KEYS, F.coalesce(both, "given", "props").alias("props"))
