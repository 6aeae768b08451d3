"""What comes before an event in its session, without sorting a whole session in one task.

Sessions are cut into hours. Within an hour a window does the work; what an hour hands on to the next (its last event, its sum) is one row an hour,
over which a second window runs. So a session that holds a third of all events is spread over as many tasks as it has hours. Events have
a session and a time, which ingest checks; rows without one belong to no session and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
ORDER = ["occurred_us", "position"]


def _cut(events: DataFrame) -> DataFrame:
    return events.withColumn("_hour", F.floor(F.col("occurred_us") / HOUR_US))


def with_previous(events: DataFrame, names: list[str], as_name: str = "before") -> DataFrame:
    """``events`` (session_id, occurred_us, position, ...) with a struct of the previous event's ``names``, null for a session's first."""
    cut, own = _cut(events), F.struct(*names)
    within = Window.partitionBy("session_id", "_hour").orderBy(*ORDER)
    last = cut.groupBy("session_id", "_hour").agg(F.max_by(own, F.struct(*ORDER)).alias("_last"))
    handed = last.select("session_id", "_hour", F.lag("_last").over(Window.partitionBy("session_id").orderBy("_hour")).alias("_handed"))
    inner = cut.withColumn("_inner", F.lag(own).over(within))
    return inner.join(handed, ["session_id", "_hour"]).withColumn(as_name, F.coalesce("_inner", "_handed")).select(*events.columns, as_name)


def with_running(events: DataFrame, value: Column, name: str) -> DataFrame:
    """``events`` with the sum of ``value`` over their session up to and with them."""
    cut = _cut(events).withColumn("_value", value)
    within = Window.partitionBy("session_id", "_hour").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("session_id", "_hour").agg(F.sum("_value").alias("_sum"))
    handed = sums.select("session_id", "_hour", (F.sum("_sum").over(Window.partitionBy("session_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_handed"))
    inner = cut.withColumn("_inner", F.sum("_value").over(within))
    return inner.join(handed, ["session_id", "_hour"]).withColumn(name, F.col("_inner") + F.col("_handed")).select(*events.columns, name)
