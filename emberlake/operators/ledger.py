"""Ingest, validation and search of the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.model import EVENT_PREFIXES, EventQuery


# The form of event types, how far ahead an event may lie, the longest payload reference.
TYPE_FORM = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_]*)+$"
AHEAD_US = 300_000_000
REFERENCE = 2048


def errors(events: DataFrame, now_us: int) -> DataFrame:
    """``events`` with a column errors: the names of the checks that fail."""
    found = F.array_compact(
        F.array(
            F.when(~F.regexp_like(F.coalesce("event_type", F.lit("")), F.lit(TYPE_FORM)), "event_type"),
            F.when(F.col("occurred_us") > now_us + AHEAD_US, "occurred_at"), F.when(F.col("parent_event_id") == F.col("event_id"), "parent_event_id"),
            F.when(F.col("ended_us") < F.col("occurred_us"), "ended_at"), F.when(F.length("payload_ref") > REFERENCE, "payload_ref"),
        )
    )
    return events.withColumn("errors", found)


def known_prefix(event_type):
    return F.substring_index(event_type, ".", 1).isin(EVENT_PREFIXES)


def deduplicated(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each event_id."""
    first = Window.partitionBy("event_id").orderBy("arrival")
    return arrivals.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def append(ledger: DataFrame, arrivals: DataFrame) -> DataFrame:
    """New events of ``arrivals`` (first of each id) that the ledger doesn't hold; write them in append mode."""
    return deduplicated(arrivals).join(ledger.select("event_id"), "event_id", "left_anti")


# ---- ingest with positions ----


def positioned(rows: DataFrame, first: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a column position: whole numbers without gaps in an order, from that in ``first`` (one row, column first) on.

    Rows are ranged, counted by range, and numbered within theirs from the sum of the ranges before, so none is sorted with all others.
    """
    from emberlake.operators.graph import cut

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumns({"_part": F.shiftright(here, 33).cast("int"), "_place": here.bitwiseAND((1 << 33) - 1)}))  # one order for counts and places
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = ranged.join(F.broadcast(before), "_part").join(F.broadcast(first))
    return numbered.withColumn("position", F.col("first") + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "first")


def ingested(ledger: DataFrame, arrivals: DataFrame, batch_id: str) -> DataFrame:
    """The rows that a batch adds to ``ledger`` (event_id, position, batch_id, ...): the first arrival of each new event id, with positions that go on from the ledger's.

    A batch that the ledger holds already gives the rows that it gave then, so it can be repeated; write each batch over its own folder
    (:func:`write_batch`), so that one that broke off is replaced.
    """
    held = ledger.where(F.col("batch_id") == batch_id)
    if not held.isEmpty():
        return held
    new = append(ledger, arrivals)
    first = ledger.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("first"))  # one row
    return positioned(new, first, "arrival", "event_id").withColumn("batch_id", F.lit(batch_id))


def receipts(arrivals: DataFrame, ledger: DataFrame) -> DataFrame:
    """(arrival, event_id, position, duplicate) for every arrival: the position that its event has in ``ledger``, and whether another arrival brought it."""
    own = ledger.select("event_id", "position", F.col("arrival").alias("brought"))
    return arrivals.select("arrival", "event_id").join(own, "event_id").select("arrival", "event_id", "position", (F.col("arrival") != F.col("brought")).alias("duplicate"))


def write_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Writes a batch's rows as a folder of its own under ``path``, in place of what an earlier try left there."""
    rows.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# ---- batches of requests ----

#: Fewest and most events of a request. Fixed values.
REQUEST = (1, 1000)


def split_request(requests: DataFrame, now_us: int) -> DataFrame:
    """(request_id, accepted, rejected, errors) of ``requests`` (request_id, events: an array of structs): errors by index from 0.

    A request of fewer or more events than REQUEST allows is rejected as a whole, with the error ``size`` at index -1.
    """
    size = F.size("events")
    fits = F.coalesce(size.between(*REQUEST), F.lit(False))
    each = requests.where(fits).select("request_id", F.posexplode("events").alias("index", "e")).select("request_id", "index", "e.*")
    told = errors(each, now_us).groupBy("request_id").agg(
        F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("rejected"),
        F.array_sort(F.collect_list(F.when(F.size("errors") > 0, F.struct("index", "errors")))).alias("errors"),
    )
    wrong = requests.where(~fits).select("request_id", F.lit(0).cast("long").alias("accepted"), F.coalesce(size, F.lit(0)).cast("long").alias("rejected"), F.array(F.struct(F.lit(-1).alias("index"), F.array(F.lit("size")).alias("errors"))).alias("errors"))
    return told.unionByName(wrong)


def search(ledger: DataFrame, q: EventQuery) -> DataFrame:
    """Events that meet all conditions of ``q``, oldest first."""
    found = ledger
    for name in ("session_id", "agent_id", "trace_id", "event_type", "tool_name"):
        if (value := getattr(q, name)) is not None:
            found = found.where(F.col(name) == value)
    if q.after_us is not None:
        found = found.where(F.col("occurred_us") >= q.after_us)
    if q.before_us is not None:
        found = found.where(F.col("occurred_us") <= q.before_us)
    return found.orderBy("occurred_us", "position").offset(q.offset).limit(q.limit)


def page_after(events: DataFrame, us: int, event_id: str, n: int) -> DataFrame:
    """The next ``n`` events behind a cursor, newest first, with has_more on each row.

    Ids of one moment are ordered by length, then as texts: numbers as numbers, and ids of one length as they are.
    """
    key, here = F.struct("occurred_us", F.length("event_id").alias("n"), "event_id"), F.struct(F.lit(us).cast("long"), F.lit(len(event_id)), F.lit(event_id))
    order = [F.col("occurred_us").desc(), F.length("event_id").desc(), F.col("event_id").desc()]
    fetched = events.where((F.col("occurred_us") <= us) & (key < here)).orderBy(*order).limit(n + 1)  # one more tells whether there is another page
    numbered = fetched.withColumns({"rn": F.row_number().over(Window.orderBy(*order)), "has_more": F.count("*").over(Window.partitionBy()) > n})
    return numbered.where(F.col("rn") <= n).drop("rn")


def newest(ledger: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events by position: a length cap on the stream."""
    return ledger.orderBy(F.col("position").desc()).limit(n)
