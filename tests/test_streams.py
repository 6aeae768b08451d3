"""Replays of streams whose files and batches aren't in time order."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from emberlake.plans import streams as _queries  # noqa: F401  registers the queries
from emberlake.plans.catalogue import QUERIES
from emberlake.sources.ledger import Tables
from emberlake.streaming import queries as streams


@pytest.fixture
def settings(spark):
    """Sets session options, which go back afterwards."""
    before = {}

    def put(**options):
        for k, v in options.items():
            k = k.replace("__", ".")
            before[k] = spark.conf.get(k)
            spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def test_replay_of_more_files_than_a_trigger_reads(spark, folder, settings):
    """One file a trigger, each over all days: later triggers must not take their events for late."""
    wanted = {r.event_id for r in Tables(spark, folder).ledger.select("event_id").collect()}
    plain = streams.event_stream

    def small(spark, path, files_per_trigger):
        return plain(spark, path, files_per_trigger and 1)

    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    streams.event_stream = small
    try:
        found = [r.event_id for r in QUERIES["stream_dedup"](spark, folder).collect()]
    finally:
        streams.event_stream = plain
    assert len(found) == len(wanted) and set(found) == wanted


def test_follows_over_many_batches_and_files(spark, settings, tmp_path):
    rows = [(f"e{k}", "s", "tool.execute", 1000 * k, k) for k in range(200)]
    events = spark.createDataFrame(rows[::-1], "event_id string, session_id string, event_type string, occurred_us long, position long").coalesce(1)
    events.where("position % 2 = 0").write.parquet(f"{tmp_path}/in")
    events.where("position % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    settings(spark__sql__execution__arrow__maxRecordsPerBatch="10")
    found = streams.drained(streams.follows(streams.event_stream(spark, str(tmp_path / "in"), None)), "many_batches")
    assert sorted((r.dst, r.src) for r in found.collect()) == sorted((f"e{k}", f"e{k + 1}") for k in range(199))


def test_state_goes_on_after_a_restart_and_ends_with_a_session(spark, tmp_path):
    kinds = ["tool.execute", "tool.execute", "system.session_end", "tool.execute", "agent.invoke", "agent.invoke", "system.session_start"]
    rows = [(f"e{k}", "s", kind, "t", k, 1000 * k, k, f"e{k - 1}" if k == 4 else None) for k, kind in enumerate(kinds)]
    schema = "event_id string, session_id string, event_type string, tool_name string, importance_hint int, occurred_us long, position long, parent_event_id string"
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 1), (1, 4), (4, 7))]
    base = str(tmp_path)
    seen = []
    out = streams.arriving(parts, f"{base}/p", lambda s: seen.append(1) or streams.drained(streams.projected(s), "p", f"{base}/p/out"))
    found = out.collect()
    assert len(seen) == 3 and sorted(r.event_id for r in found if r.kind == "node") == [f"e{k}" for k in range(7)]
    assert sorted((r.dst, r.src) for r in found if r.edge_type == "FOLLOWS") == [("e0", "e1"), ("e1", "e2"), ("e3", "e4"), ("e4", "e5"), ("e5", "e6")]
    assert [(r.src, r.dst, r.delta_ms) for r in found if r.edge_type == "CAUSED_BY"] == [("e4", "e3", None)]
    got = streams.arriving(parts, f"{base}/x", lambda s: streams.drained(streams.extraction_pieces(s, 2), "x", f"{base}/x/out")).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r.trigger_event_id, r.reason, r.turns), set()).add(r.event_id)
    assert pieces == {("e1", "turn", 2): {"e0", "e1"}, ("e2", "session_end", 2): {"e2"}, ("e4", "turn", 2): {"e3", "e4"}}


def test_a_repeated_trigger_replaces_its_counts(spark, tmp_path):
    """The same trigger twice, as after a failure, counts once."""
    hour = 3_600_000_000
    events = spark.createDataFrame([("a", hour), ("a", 30 * hour), ("b", 2 * hour)], "event_type string, occurred_us long").withColumn("at", F.timestamp_micros("occurred_us"))
    kept = {}

    class Writer:
        def foreachBatch(self, f):
            kept["f"] = f

    class Stream:
        writeStream = Writer()

    base = str(tmp_path)
    streams.counted_with_late(Stream(), base)
    split = kept["f"]
    split(events, 0)
    late = spark.createDataFrame([("a", hour), ("a", 40 * hour)], "event_type string, occurred_us long").withColumn("at", F.timestamp_micros("occurred_us"))
    for _ in range(2):
        split(late, 1)
    assert sorted((r.event_type, r.n) for r in streams.total_counts(spark, base).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [(r.event_type, r.occurred_us) for r in spark.read.parquet(f"{base}/late").collect()] == [("a", hour)]


def test_events_without_a_time_come_last_and_are_kept(spark, tmp_path):
    rows = [("e0", "s", "tool.execute", None, 0), ("e1", "s", "tool.execute", 2000, 1), ("e2", "s", "tool.execute", 1000, 2), ("e3", "s", "tool.execute", 5000, 3)]
    schema = "event_id string, session_id string, event_type string, occurred_us long, position long"
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 3), (3, 4))]
    found = streams.arriving(parts, f"{tmp_path}/f", lambda s: streams.drained(streams.follows(s), "f", f"{tmp_path}/f/out")).collect()
    assert sorted((r.dst, r.src, r.delta_ms) for r in found) == [("e0", "e3", None), ("e1", "e0", None), ("e2", "e1", 1)]


@pytest.mark.parametrize("make", [streams.Follows, streams.Projection, lambda: streams.Triggers(2), lambda: streams.Extraction(2)])
def test_a_session_costs_two_calls_of_state_a_trigger(make):
    """Each call waits for the JVM, so a trigger over many sessions takes as long as its calls."""
    calls, kept = [], []

    class State:
        def get(self):
            calls.append("get")
            return kept[-1] if kept else None

        def update(self, value):
            calls.append("update")
            kept.append(value)

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        def getValueState(self, *_):
            return State()

    def rows(kinds):
        return iter([Row(event_id=f"e{k}", event_type=kind, tool_name=None, importance_hint=None, occurred_us=k, position=k, parent_event_id=None) for k, kind in enumerate(kinds)])

    one = make()
    one.init(Handle())
    for kinds in (["agent.invoke"] * 3, ["agent.invoke", "system.session_start"], ["agent.invoke", "system.session_end"]):
        calls.clear()
        list(one.handleInputRows(("s",), rows(kinds), None))
        assert 1 <= len(calls) <= 2
    assert not kept
