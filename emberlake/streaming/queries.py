"""Streams over the ledger: dedup, projection and extraction with state, windows with late rows, dead letters.

State lies in RocksDB under the query's checkpoint, so a query that is started again with the same checkpoint goes on where it stopped.
A key's rows of a trigger come in arrival order of files only; within a trigger they are put in the order of time. A trigger's
rows of one session are one list in one task: bound triggers by ``files_per_trigger``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from emberlake.operators import projection
from emberlake.operators.graph import shared_folder

SESSION_END = "system.session_end"
#: How long a session's state is kept without an event.
KEPT_MS = 30 * 24 * 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Ledger events as a stream from a folder of Parquet files, with event time ``at``; None: what there is comes in one trigger."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    raw = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)
    return raw.withColumn("at", F.timestamp_micros("occurred_us"))


def deduplicated(stream: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """The first arrival of each event id within the watermark; None: of all, with every id in the state, for replays whose files aren't in time order."""
    if watermark is None:
        return stream.dropDuplicates(["event_id"])
    return stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["event_id"])


# ---- state by session ----


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of a trigger in the order of time; rows without one come last."""
    return sorted(rows, key=lambda r: (r.occurred_us is None, r.occurred_us, r.position is None, r.position))


def with_state(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``stream`` by session through a processor; state that no event has touched for ``KEPT_MS`` goes."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("session_id").transformWithState(processor, StructType.fromDDL(schema), "Append", "ProcessingTime")


def row_of(schema: str) -> Row:
    """A maker of rows with the names of ``schema``."""
    return Row(*[f.split()[0] for f in schema.split(", ")])


PROJECTED = "kind string, session_id string, event_id string, event_type string, tool_name string, importance_score int, global_position long, src string, dst string, edge_type string, delta_ms long"
FOLLOWS = "src string, dst string, edge_type string, session_id string, delta_ms long"


class Follows(StatefulProcessor):
    """FOLLOWS edges; the state is a session's last event, dropped at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_id string, us long", KEPT_MS)
        self.row = row_of(FOLLOWS)

    def steps(self, rows: Iterator[Row]) -> Iterator[tuple[Row, str | None, int | None]]:
        """Each event with the one before it, if it follows one, and the milliseconds between."""
        held = self.last.get()
        before, us = held or (None, None)
        for r in in_order(rows):
            yield r, before, None if us is None or r.occurred_us is None else (r.occurred_us - us) // 1000
            before, us = (None, None) if r.event_type == SESSION_END else (r.event_id, r.occurred_us)  # nothing follows an end
        if before is not None:
            self.last.update((before, us))
        elif held:
            self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for r, before, delta in self.steps(rows):
            if before is not None:
                yield self.row(r.event_id, before, "FOLLOWS", key[0], delta)

    def close(self) -> None:
        pass


class Projection(Follows):
    """Nodes and edges of each event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.row = row_of(PROJECTED)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for r, before, delta in self.steps(rows):
            yield self.row("node", key[0], r.event_id, r.event_type, r.tool_name, r.importance_hint, r.position, None, None, None, None)
            if before is not None:
                yield self.row("edge", key[0], None, None, None, None, None, r.event_id, before, "FOLLOWS", delta)
            if r.parent_event_id is not None:
                yield self.row("edge", key[0], None, None, None, None, None, r.event_id, r.parent_event_id, "CAUSED_BY", None)


def projected(stream: DataFrame) -> DataFrame:
    """Graph rows of ``stream`` in one pass: nodes (kind node) and FOLLOWS and CAUSED_BY edges (kind edge), as they arrive."""
    names = ["session_id", "event_id", "event_type", "tool_name", "importance_hint", "position", "occurred_us", "parent_event_id"]
    return with_state(stream.select(*names), Projection(), PROJECTED)


def follows(stream: DataFrame) -> DataFrame:
    """FOLLOWS edges in arrival order, from the last event of each session; a session's end drops its state."""
    return with_state(stream.select("session_id", "event_id", "event_type", "occurred_us", "position"), Follows(), FOLLOWS)


PIECES = "session_id string, trigger_event_id string, reason string, turns long, event_id string"
TRIGGERS = "session_id string, event_id string, turn long"


class Triggers(StatefulProcessor):
    """Every so many events of a session that the system hasn't made; the state is their number, dropped at the session's end, after which it begins anew."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", "n long", KEPT_MS)
        self.row = row_of(TRIGGERS)

    def steps(self, rows: Iterator[Row], turn: int) -> Iterator[tuple[Row, int, str | None]]:
        """Each event with the turns up to it and, if it is a trigger, the reason."""
        for r in in_order(rows):
            ends, counts = r.event_type == SESSION_END, r.event_type is not None and not r.event_type.startswith("system.")
            turn += counts
            yield r, turn, "session_end" if ends else "turn" if counts and turn % self.every == 0 else None
            turn = 0 if ends else turn

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.turns.get()
        turn, reason = 0, None
        for r, turn, reason in self.steps(rows, held[0] if held else 0):
            if reason == "turn":
                yield self.row(key[0], r.event_id, turn)
        if reason != "session_end":
            self.turns.update((turn,))
        elif held:
            self.turns.clear()

    def close(self) -> None:
        pass


class Extraction(Triggers):
    """Events of a session since its last trigger, given out at every so many turns and at its end; what waits is kept with the number of turns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "n long, waiting array<string>", KEPT_MS)
        self.row = row_of(PIECES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.open.get()
        before, waiting = (held[0], list(held[1])) if held else (0, [])
        turn, reason = 0, None
        for r, turn, reason in self.steps(rows, before):
            waiting.append(r.event_id)
            if reason is not None:
                for e in waiting:
                    yield self.row(key[0], r.event_id, reason, turn, e)
                waiting = []
        if reason != "session_end":
            self.open.update((turn, waiting))
        elif held:
            self.open.clear()


def extraction_pieces(stream: DataFrame, every: int = 50) -> DataFrame:
    """(session_id, trigger_event_id, reason, turns, event_id): the events of a session since its last trigger, at every so many
    events that the system hasn't made and at ``system.session_end``.

    The state holds what waits for the next trigger and a count, both dropped at the end. All pieces of a session together are its events.
    """
    names = ["session_id", "event_id", "event_type", "occurred_us", "position"]
    return with_state(stream.select(*names), Extraction(every), PIECES)


def extraction_triggers(stream: DataFrame, every: int = 50) -> DataFrame:
    """(session_id, event_id, turn): every so many events of a session that the system hasn't made."""
    return with_state(stream.select("session_id", "event_id", "event_type", "occurred_us", "position"), Triggers(every), TRIGGERS)


def enriched(stream: DataFrame) -> DataFrame:
    """Key words, importance and the text to embed of each event, as it comes; nothing is kept between events."""
    return projection.enriched(stream)


# ---- windows and late rows ----


def windows(stream: DataFrame, watermark: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events of each type in windows of event time, every ``slide`` or one behind the other, once the watermark has passed them."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    counted = stream.withWatermark("at", watermark).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def bursts(stream: DataFrame, watermark: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Runs of a session's events that no longer gap interrupts, once the watermark has passed their end."""
    counted = stream.withWatermark("at", watermark).groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counted_with_late(stream: DataFrame, base: str, delay: str = "1 hour", width: str = "1 day", keys: tuple[str, ...] = ("event_type",)):
    """A writer that counts events by window and keeps those that come too late for theirs.

    A row is late if its window has ended by the watermark: the greatest event time of all triggers before, less ``delay``. ``base`` gets
    late (the rows, with the watermark), counts (each trigger's own counts; add them up) and marks (each trigger's greatest time). Every trigger
    writes folders of its own, so one that is repeated after a failure replaces what it wrote.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = spark.createDataFrame([], "at timestamp, epoch long")
        if epoch:
            marks = spark.read.schema("at timestamp, epoch long").parquet(f"{base}/marks").where(F.col("epoch") < epoch)
        mark = marks.agg((F.max("at") - F.expr(f"INTERVAL {delay}")).alias("watermark"))  # one row
        rows = batch.withColumn("w", F.window("at", width)).join(F.broadcast(mark)).persist()
        try:
            late = F.coalesce(F.col("w.end") <= F.col("watermark"), F.lit(False))
            rows.where(late).drop("w").write.mode("overwrite").parquet(f"{base}/late/epoch={epoch}")
            counts = rows.where(~late).groupBy(F.col("w.start").alias("start"), *keys).agg(F.count("*").alias("n"))
            counts.write.mode("overwrite").parquet(f"{base}/counts/epoch={epoch}")
            rows.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{base}/marks/epoch={epoch}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(split)


def total_counts(spark: SparkSession, base: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The windows' counts over all triggers of :func:`counted_with_late`."""
    return spark.read.parquet(f"{base}/counts").groupBy("start", *keys).agg(F.sum("n").alias("n"))


# ---- dead letters ----


def with_dead_letters(stream: DataFrame, base: str, group: str, fault: Column | Callable[[DataFrame], DataFrame], most: int = 5):
    """A writer that processes events, delivers those that fail again with each trigger, and gives them up after ``most`` deliveries.

    fault: a column with the error's text, or null; or a function that adds it as column ``error``. ``base`` gets good, dead (with original_position,
    group, delivery_count, error and epoch) and waiting (what failed so far), one folder a trigger, which a repeated trigger replaces.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("delivery_count", F.lit(1))
        if epoch:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{base}/waiting/epoch={epoch - 1}").withColumn("delivery_count", F.col("delivery_count") + 1))
        tried = (fault(rows) if callable(fault) else rows.withColumn("error", fault)).persist()
        try:
            failed, over = F.col("error").isNotNull(), F.col("delivery_count") > most
            tried.where(~failed).drop("error").write.mode("overwrite").parquet(f"{base}/good/epoch={epoch}")
            tried.where(failed & ~over).drop("error").write.mode("overwrite").parquet(f"{base}/waiting/epoch={epoch}")
            dead = tried.where(failed & over).withColumns({"original_position": F.col("position"), "group": F.lit(group)})
            dead.write.mode("overwrite").parquet(f"{base}/dead/epoch={epoch}")
        finally:
            tried.unpersist()

    return stream.writeStream.foreachBatch(split)


# ---- runs ----


def run_to_end(writer, checkpoint: str, settle: bool = False) -> None:
    """Runs a stream over what there is, to its end; a failed stream raises. The same checkpoint goes on where an earlier run stopped.

    settle: a last trigger without data closes the windows that the watermark has passed. State with a time to live would ask for such
    triggers for ever, so they are off otherwise.
    """
    conf, name = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(settle).lower())
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def drained(df: DataFrame, name: str, path: str | None = None, settle: bool = False) -> DataFrame:
    """The rows of a stream over what there is, through Parquet files in the shared folder, or under ``path``, where another run goes on."""
    path = path or new_folder(df.sparkSession, name)
    run_to_end(df.writeStream.format("parquet").option("path", f"{path}/rows").outputMode("append"), f"{path}/checkpoint", settle)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def by_time(events: DataFrame, parts: int) -> list[DataFrame]:
    """``events`` cut into ``parts`` of about the same size, one after the other."""
    shares = ", ".join(str(k / parts) for k in range(1, parts))
    ends = events.selectExpr(f"percentile_approx(occurred_us, array({shares}), 1000)").first()[0] or []  # a few numbers
    us = F.col("occurred_us")
    first = [events.where(us <= ends[0])] if ends else [events]
    return first + [events.where((us > low) & (us <= high)) for low, high in zip(ends, ends[1:], strict=False)] + ([events.where(us > ends[-1])] if ends else [])


def arriving(parts: list[DataFrame], base: str, step: Callable[[DataFrame], object]) -> object:
    """Lets ``parts`` arrive one after the other, each followed by ``step`` over the stream of what has arrived; the last step's result."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/events")
        out = step(event_stream(part.sparkSession, f"{base}/events", None))
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def replayed(events: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, parts: int = 3) -> DataFrame:
    """The rows of the stream ``make`` over ``events``, which arrive in ``parts`` by time: after each, the query is started again from its checkpoint."""
    base = new_folder(events.sparkSession, name)
    return arriving(by_time(events, parts), base, lambda stream: drained(make(stream), name, f"{base}/out"))
