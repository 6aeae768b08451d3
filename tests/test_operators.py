"""Operators on small literal tables: boundaries, nulls, loops and faults."""

import pytest
from pyspark.sql import functions as F

from emberlake.functions import scoring, text
from emberlake.model import EventQuery, SubgraphQuery
from emberlake.operators import consolidation, graph, ledger, resolution, retention, retrieval, upsert, users
from emberlake.sources.ledger import NOW_US, Tables, archive_files

HOUR = 3_600_000_000


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        EventQuery(limit=0)
    with pytest.raises(ValueError):
        SubgraphQuery("", "s", max_depth=11)


def test_first_arrival_wins(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "only"), (None, 4, "x")], "event_id string, arrival int, payload string")
    old = spark.createDataFrame([("b",)], "event_id string")
    assert {(r.event_id, r.payload) for r in ledger.append(old, rows).collect()} == {("a", "first"), (None, "x")}


def test_validation(spark):
    rows = spark.createDataFrame(
        [("a", "x.y", 0, None, None, None), ("b", "X", NOW_US + 300_000_001, "b", -1, "r" * 2049), ("c", None, 0, None, 0, ""), ("d", "a.b_c", NOW_US + 300_000_000, "a", None, "r" * 2048)],
        "event_id string, event_type string, occurred_us long, parent_event_id string, ended_us long, payload_ref string",
    )
    found = {r.event_id: r.errors for r in ledger.errors(rows, NOW_US).collect()}
    assert found == {"a": [], "b": ["event_type", "occurred_at", "parent_event_id", "ended_at", "payload_ref"], "c": ["event_type"], "d": []}


def test_tiers_at_their_bounds(spark):
    ages = [0, 23.999, 24, 167.999, 168, 719.999, 720]
    rows = spark.createDataFrame([(i, NOW_US - int(h * HOUR)) for i, h in enumerate(ages)], "i int, occurred_us long")
    assert [r.t for r in rows.select("i", retention.tier(NOW_US).alias("t")).orderBy("i").collect()] == ["hot", "hot", "warm", "warm", "cold", "cold", "archive"]


def test_episode_gap_is_strict(spark):
    gap = 30 * 60_000_000
    rows = spark.createDataFrame([("s", "1", 1, 0), ("s", "2", 2, gap), ("s", "3", 3, 2 * gap + 1), ("t", "4", 4, 5)], "session_id string, event_id string, position long, occurred_us long")
    assert {r.event_id: r.episode for r in consolidation.episodes(rows).collect()} == {"1": 0, "2": 0, "3": 1, "4": 0}


def test_lineage_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",)], "id string")
    assert {(r.start, r.ancestor, r.depth) for r in graph.lineage(edges, starts, 10).collect()} == {("a", "b", 1), ("a", "c", 2)}


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z1"), ("q", "q"), ("y3", "y1")]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {found[f"n{i:03}"] for i in range(61)} == {"n000"} and found["z2"] == "z1" and found["y3"] == "y1" and "q" not in found


def brute_pagerank(adj, seeds, d=0.85, rounds=5):
    ids = sorted({x for e in adj for x in e[:2]})
    known = [s for s in seeds if s in ids]
    restart = {i: (1 / len(known) if i in known else 0) for i in ids}
    score = dict(restart)
    for _ in range(rounds):
        out = {i: sum(w for s, _, w in adj if s == i) for i in ids}
        lost = sum(score[i] for i in ids if not out[i])
        raw = {i: d * (sum(score[s] * w / out[s] for s, t, w in adj if t == i) + lost * restart[i]) + (1 - d) * restart[i] for i in ids}
        score = {i: v / sum(raw.values()) for i, v in raw.items()}
    return score


def test_pagerank_with_dangling_nodes(spark):
    adj = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "a", 3.0)]
    found = graph.personalised_pagerank(spark.createDataFrame(adj, "src string, dst string, w double"), spark.createDataFrame([("a",), ("nobody",)], "id string"))
    want = brute_pagerank(adj, ["a", "nobody"])
    assert {r.id: pytest.approx(r.score) for r in found.collect()} == want


def test_upsert_keeps_last_and_others(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, at int")
    assert {(r.id, r.v) for r in upsert.merge(old, new, ["id"], "at").collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_cosine_defaults(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [], []), (4, [1.0], [1.0, 2.0]), (5, [0.0, 0.0], [1.0, 0.0]), (6, None, [1.0])], "i int, a array<double>, b array<double>")
    assert [r.s for r in rows.select("i", scoring.relevance(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()] == [1.0, 0.0, 0.5, 0.5, 0.5, 0.5]


def test_intents_match_whole_words(spark):
    found = retrieval.intents(spark.createDataFrame([(1, "show me"), (2, "How does the process work"), (3, None)], "qid int, text string"))
    assert {(r.qid, r.intent) for r in found.collect()} == {(1, "general"), (2, "how_does"), (3, "general")}


def test_cursors(spark):
    rows = spark.createDataFrame([("bm90IGEgY3Vyc29y",), ("***",), (None,)], "c string")
    assert [r.us for r in rows.select(text.cursor_parts(F.col("c")).alias("p")).select("p.us").collect()] == [None, None, None]


def test_feedback_clamps_at_each_step(spark):
    nodes = spark.createDataFrame([("a", 9), ("b", None)], "id string, importance_hint int")
    votes = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, -1), ("b", 1, -1)], "id string, order int, delta int")
    assert {r.id: r.importance for r in users.feedback_importance(nodes, votes).collect()} == {"a": 9, "b": 4}


def test_preference_winner_with_unknown_times(spark):
    rows = spark.createDataFrame([("a", "b", 1, 2), ("c", "d", 2, 1), ("e", "f", None, 1), ("g", "h", 1, None), ("i", "j", 1, 1)], "a string, b string, a_us long, b_us long")
    assert {r.winner for r in resolution.preference_winner(rows).collect()} == {"b", "c", "e", "h", "j"}


def test_fuzzy_names(spark):
    new = spark.createDataFrame([("postgresq", "service"), ("zzz", "tool")], "name string, entity_type string")
    known = spark.createDataFrame([("postgresql", "service"), ("post office", "service")], "name string, entity_type string")
    assert [(r.name, r.target, r.action) for r in resolution.fuzzy(new, known).collect()] == [("postgresq", "postgresql", "SAME_AS")]


def test_mmr_prefers_different_vectors(spark):
    rows = [("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.01]), ("q", "c", 0.7, [0.0, 1.0])]
    found = retrieval.mmr(spark.createDataFrame(rows, "qid string, id string, relevance double, vector array<double>"), 3, 0.5)
    assert [r.id for r in found.orderBy("rank").collect()] == ["a", "c", "b"]


def test_archive_before_delete(spark, folder, tmp_path):
    t = Tables(spark, folder)
    left = retention.archive_then_delete(t.ledger, NOW_US, 20, f"file://{tmp_path}/a")
    gone = retention.expired(t.ledger, NOW_US, 20).count()
    assert left.count() == t.ledger.count() - gone and archive_files(spark, f"file://{tmp_path}/a").count() > 0


def test_dead_letters(spark, folder, tmp_path):
    from emberlake.streaming import queries as streams

    t = Tables(spark, folder)
    rows = t.ledger.select("event_id", "position", F.when(F.col("position") % 10 == 0, "BAD").otherwise(F.col("event_type")).alias("event_type"), "occurred_us", "parent_event_id", F.lit(None).cast("long").alias("ended_us"), F.lit("r").alias("payload_ref"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", 100).drop("at")
    checked = lambda df: ledger.errors(df, NOW_US).withColumn("error", F.when(F.size("errors") > 0, F.array_join("errors", ","))).drop("errors")
    streams.run_to_end(streams.with_dead_letters(stream, str(tmp_path), "g", checked, most=0), f"{tmp_path}/c")  # no second delivery
    dead = spark.read.parquet(f"{tmp_path}/dead")
    assert dead.count() == 100 and spark.read.parquet(f"{tmp_path}/good").count() == 900
    assert {(r.error, r.group, r.delivery_count, r.original_position % 10) for r in dead.collect()} == {("event_type", "g", 1, 0)}


def test_stored_ledger_is_pruned(spark, folder, tmp_path, capsys):
    from emberlake.sources.ledger import read_ledger, write_ledger

    t = Tables(spark, folder)
    write_ledger(t.ledger, f"{tmp_path}/l")
    back = read_ledger(spark, f"{tmp_path}/l")
    assert back.drop("day").exceptAll(t.ledger).isEmpty() and back.count() == t.ledger.count()
    one = ledger.search(back.where("day = DATE'2024-01-10'"), EventQuery(session_id="s5")).select("event_id")
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(session_id,s5)" in plan and "PartitionFilters: [isnotnull(day" in plan and "importance_hint" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_surface_helpers(spark):
    from emberlake.operators import surface

    assert [surface.bounded(x, 3, 10) for x in (None, 0, 5, 99)] == [3, 1, 5, 10]
    assert surface.hyde_query("q", "  ") == "q" and surface.hyde_query("q", " a ") == "q\na"
    assert all(t.count() == 0 for t in surface.empty_tables(spark).values())
    with pytest.raises(ValueError):
        surface.read_only(spark, "DROP TABLE x")
    keys = spark.createDataFrame([("10-2",), ("9-10",), ("9-9",), ("bad",)], "s string")
    assert [r.s for r in keys.orderBy(surface.stream_key(F.col("s"))).collect()] == ["bad", "9-9", "9-10", "10-2"]


def test_redaction(spark):
    rows = spark.createDataFrame([("token=abc next",), ("Authorization: xyz",), ("plain",)], "t string")
    assert [r.t for r in rows.select(text.redacted(F.col("t")).alias("t")).collect()] == ["token=*** next", "Authorization: ***", "plain"]


def test_archive_files_by_prefix_and_limit(spark, tmp_path):
    for day in ("y=2024/m=01/d=02", "y=2024/m=01/d=03", "y=2024/m=02/d=01"):
        (tmp_path / day).mkdir(parents=True)
        (tmp_path / day / "part.json").write_text("{}")
    path = f"file://{tmp_path}"
    assert archive_files(spark, path).count() == 3
    assert [r.path.split("/y=")[1] for r in archive_files(spark, path, "y=2024/m=01").collect()] == ["2024/m=01/d=02/part.json", "2024/m=01/d=03/part.json"]
    assert archive_files(spark, path, most=1).count() == 1 and archive_files(spark, path, "y=2023").isEmpty()


def test_merging_properties(spark):
    old = spark.createDataFrame([(1, "a", "kept"), (2, "b", None)], "id int, v string, w string")
    changes = spark.createDataFrame([(1, "x", 5, 1), (1, None, 6, 2), (3, "z", None, 1)], "id int, v string, u int, at int")
    assert sorted(map(tuple, upsert.merge_properties(old, changes, ["id"], "at").collect())) == [(1, "x", "kept", 6), (2, "b", None, None), (3, "z", None, None)]
    assert upsert.merge_properties(old.limit(0), changes.limit(0), ["id"], "at").isEmpty()


def test_merging_edges(spark):
    schema = "src string, dst string, edge_type string, props map<string,string>"
    old = spark.createDataFrame([("a", "b", "FOLLOWS", {"x": "1", "y": "1"}), ("a", "c", "FOLLOWS", None)], schema)
    changes = spark.createDataFrame(
        [("a", "b", "FOLLOWS", {"y": "3"}, 2), ("a", "b", "FOLLOWS", {"y": "2", "z": "2"}, 1), ("a", "c", "FOLLOWS", {"x": "9"}, 1), ("d", "e", "SAME_AS", {}, 1), ("d", "e", "UNKNOWN", {}, 1)], f"{schema}, at int"
    )
    found = {(r.src, r.dst, r.edge_type): r.props for r in upsert.merge_edges(old, changes, "at").collect()}
    assert found == {("a", "b", "FOLLOWS"): {"x": "1", "y": "3", "z": "2"}, ("a", "c", "FOLLOWS"): {"x": "9"}, ("d", "e", "SAME_AS"): {}}
    with pytest.raises(ValueError):
        upsert.typed_edges("UNKNOWN", old)
