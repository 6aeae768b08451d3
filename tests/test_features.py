"""Search, positions, lineage, resolution in order, archives and affinity against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlake.functions import text
from emberlake.model import ALIASES
from emberlake.operators import graph, ledger, resolution, retention, textindex, users
from emberlake.operators.graph import shared_folder
from emberlake.plans.catalogue import QUERIES
from emberlake.sources.ledger import archived, read_scenarios, scenarios, write_scenarios


def plain_search(docs, query, k, session=None):
    fields = {"summary": 2.0, "keywords": 1.5}
    tf, dl, df = {}, {}, defaultdict(int)
    for d in docs:
        counts = defaultdict(float)
        dl[d["id"]] = 0
        for f, w in fields.items():
            found = re.findall("[a-z0-9]+", (d[f] or "").lower())
            dl[d["id"]] += len(found)
            for x in found:
                counts[x] += w
        tf[d["id"]] = counts
        for x in counts:
            df[x] += 1
    avg, out = sum(dl.values()) / len(dl), []
    for d in docs:
        if session is not None and d["session"] != session:
            continue
        hits = [x for x in textindex.terms_of(query) if x in tf[d["id"]]]
        if hits:
            part = lambda x, i=d["id"]: math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * tf[i][x] * 2.2 / (tf[i][x] + 1.2 * (0.25 + 0.75 * dl[i] / avg))
            out.append((-round(sum(map(part, hits)), 5), d["id"]))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_ranked_search_reads_what_it_needs(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    docs = [{"id": f"d{k:03d}", "session": f"s{k % 5}", "summary": " ".join(rng.choices(words, [1 / (n + 1) for n in range(40)], k=rng.randint(1, 30))), "keywords": rng.choice(words) if k % 3 else None} for k in range(400)]
    docs += [{"id": "none", "session": "s1", "summary": None, "keywords": ""}]
    table = spark.createDataFrame(docs, "id string, session string, summary string, keywords string")
    index = textindex.build(table, path=str(tmp_path / "index"))
    for query, k, session in (("w0 w1 w30", 5, None), ("W39!", 3, None), ("w0", 7, None), ("w2 w17 nothere", 10, "s2"), ("w0 w1 w2 w3", 1000, None), ("nothere", 5, None), ("?!", 5, None)):
        found = [(r.id, r.score) for r in textindex.search(spark, index, query, k, session).collect()]
        want = plain_search(docs, query, k, session)
        assert [i for i, _ in found] == [i for i, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-5)
    plan = textindex.search(spark, index, "w30", 5, "s1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_positions_have_no_gap_and_repeats_change_nothing(spark, tmp_path):
    schema, path = "event_id string, arrival long, position long, batch_id string", str(tmp_path / "ledger")
    held = spark.createDataFrame([], schema)
    rng = random.Random(1)
    seen, want = set(), []
    for n in range(3):
        batch = [(f"e{rng.randint(0, 300)}", 1000 * n + k) for k in range(200)]
        for e, a in sorted(batch, key=lambda x: (x[1], x[0])):
            if e not in seen:
                seen.add(e)
                want.append(e)
        arrivals = spark.createDataFrame(batch, "event_id string, arrival long").repartition(5)
        for _ in range(2):  # the second time as after a failure
            rows = ledger.ingested(held, arrivals, f"b{n}")
            if "batch_id" not in rows.columns or held.where(f"batch_id = 'b{n}'").isEmpty():
                ledger.write_batch(rows, path, f"b{n}")
            held = spark.read.schema(schema).parquet(path)
    got = sorted((r.position, r.event_id) for r in held.collect())
    assert [p for p, _ in got] == list(range(1, len(want) + 1)) and [e for _, e in got] == want
    told = ledger.receipts(arrivals, held).collect()
    first = {r.event_id: (r.position, r.arrival) for r in held.collect()}
    assert len(told) == 200 and all((r.position, r.duplicate) == (first[r.event_id][0], first[r.event_id][1] != r.arrival) for r in told)


def test_requests_keep_their_bounds(spark):
    one = "struct<event_type:string,occurred_us:long,event_id:string,parent_event_id:string,ended_us:long,payload_ref:string>"
    good, bad = ("tool.run", 1, "a", None, None, "r"), ("Bad", 1, "b", "b", 0, "r")
    rows = [(1, [good, bad, good]), (2, []), (3, [good] * 1001), (4, [good] * 1000), (5, None)]
    found = {r.request_id: r for r in ledger.split_request(spark.createDataFrame(rows, f"request_id int, events array<{one}>"), 10).collect()}
    assert (found[1].accepted, found[1].rejected) == (2, 1) and [(e["index"], e["errors"]) for e in found[1].errors] == [(1, ["event_type", "parent_event_id", "ended_at"])]
    assert (found[4].accepted, found[4].rejected) == (1000, 0)
    for k, n in ((2, 0), (3, 1001), (5, 0)):
        assert (found[k].accepted, found[k].rejected, found[k].errors[0]["errors"]) == (0, n, ["size"])


def plain_lineage(edges, start, depth, most, kinds):
    seen, front, out = {start}, {start}, {}
    for hop in range(1, depth + 1):
        new = sorted({d for s, d, k in edges if s in front and k in kinds} - seen)[: most - len(out)]
        front = set(new)
        seen |= front
        out |= dict.fromkeys(new, hop)
        if not new:
            break
    return out, {(s, d, k) for s, d, k in edges if s in seen and d in seen and k in kinds}


def test_bounded_lineage(spark):
    rng = random.Random(8)
    edges = list({(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}", rng.choice(["CAUSED_BY", "FOLLOWS", "REFERENCES"])) for _ in range(70)})
    table, starts = spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame([(f"n{k}",) for k in range(0, 26, 3)] + [("alone",)], "id string")
    for depth, most, kinds in ((3, 4, ("CAUSED_BY",)), (10, 100, ("CAUSED_BY", "FOLLOWS")), (1, 2, ("FOLLOWS",))):
        nodes, links = graph.bounded_lineage(table, starts, depth, most, kinds)
        got, got_links = defaultdict(dict), defaultdict(set)
        for r in nodes.collect():
            got[r.start][r.node] = r.depth
        for r in links.collect():
            got_links[r.start].add((r.src, r.dst, r.edge_type))
        for start in [f"n{k}" for k in range(0, 26, 3)] + ["alone"]:
            want, want_links = plain_lineage(edges, start, depth, most, kinds)
            assert got[start] == want and got_links[start] == want_links


@pytest.fixture
def tables(monkeypatch):
    """The rows of each table that is written between steps."""
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def test_bounded_lineage_keeps_a_row_a_start_and_leaves_full_ones(spark, tables):
    """A source of many nodes, and a chain whose starts are full after two hops of ten."""
    edges = [(f"c{k}", f"c{k + 1}", "CAUSED_BY") for k in range(40)] + [("hub", f"h{k:04}", "CAUSED_BY") for k in range(3000)] + [("h0001", "z", "CAUSED_BY")]
    starts = spark.createDataFrame([(f"c{k}",) for k in range(40)] + [("hub",)], "id string")
    nodes, links = graph.bounded_lineage(spark.createDataFrame(edges, "src string, dst string, edge_type string"), starts, 10, 2)
    found = defaultdict(set)
    for r in nodes.collect():
        found[r.start].add((r.node, r.depth))
    assert found["hub"] == {("h0000", 1), ("h0001", 1)} and found["c5"] == {("c6", 1), ("c7", 2)} and found["c39"] == {("c40", 1)}
    assert {(r.src, r.dst) for r in links.collect() if r.start == "hub"} == {("hub", "h0000"), ("hub", "h0001")}
    assert tables == [40 + 5 + 1, 41, 40]  # edges that can matter, then the starts of each hop that aren't full


def test_resolution_of_one_name_grows_with_its_mentions(spark, tables):
    items = [("b", k, "marble" if k % 2 else "quartz", "tool" if k % 3 else "service") for k in range(300)]
    found = resolution.resolved_in_order(spark.createDataFrame(items, "batch string, ordinal int, name string, entity_type string"), spark.createDataFrame([], "ordinal int, name string, entity_type string")).collect()
    assert {(r.ordinal, r.action) for r in found if r.ordinal < 5} == {(0, "CREATE"), (1, "CREATE"), (2, "SAME_AS"), (3, "SAME_AS"), (4, "SAME_AS")}
    assert len(found) == 300 and max(tables) <= 300


def canonical(name):
    flat = {a: w for w, names in ALIASES.items() for a in names}
    plain = re.sub(r"\s+", " ", name.lower()).strip(" ")
    return flat.get(plain, plain), plain


def alike(a, b):
    return max(SequenceMatcher(None, x, y, autojunk=False).ratio() for x in set(canonical(a)) for y in set(canonical(b)))


def plain_resolution(items, known, similar):
    out = {}
    for batch in {b for b, *_ in items}:
        there = [(n, k) for _, n, k in sorted(known)]
        for _, ordinal, name, kind in sorted(x for x in items if x[0] == batch):
            hit = next(((n, k) for n, k in there if canonical(n)[0] == canonical(name)[0]), None)
            if hit:
                out[batch, ordinal] = ("MERGE" if hit[1] == kind else "SAME_AS", hit[0])
                continue
            best = max(((alike(name, n), -i, n, k) for i, (n, k) in enumerate(there)), default=(0, 0, None, None))
            if best[0] >= 0.9:
                out[batch, ordinal] = ("SAME_AS" if best[3] == kind else "RELATED_TO", best[2])
                continue
            far = max(((s, t) for n, t, s in similar if n == name), default=(0, None))
            if far[0] >= 0.75:
                out[batch, ordinal] = ("SAME_AS" if far[0] >= 0.9 else "RELATED_TO", far[1])
                continue
            out[batch, ordinal] = ("CREATE", None)
            there.append((name, kind))
    return out


def test_resolution_in_order(spark):
    rng = random.Random(3)
    base = ["kubernetes", "postgres", "billing service", "data lake house", "stone river", "stone rivers", "stone riverss", "VSCode", "visual studio code"]
    names = base + [n[:4] + n[3:] for n in base] + ["gh", "github.com", "K8s", " data  lake house", "unlike all", "marble"]
    known = [(1, "github", "service"), (2, "Kubernetes", "service"), (3, "data lake hause", "concept")]
    items = [(f"b{b}", k, rng.choice(names), rng.choice(["service", "tool"])) for b in range(6) for k in range(25)]
    similar = [("marble", "github", 0.93), ("unlike all", "Kubernetes", 0.8), ("unlike all", "github", 0.2)]
    found = resolution.resolved_in_order(
        spark.createDataFrame(items, "batch string, ordinal int, name string, entity_type string").repartition(4), spark.createDataFrame(known, "ordinal int, name string, entity_type string"), spark.createDataFrame(similar, "name string, target string, similarity double")
    ).collect()
    got = {(r.batch, r.ordinal): (r.action, r.target) for r in found}
    assert got == plain_resolution(items, known, similar)
    assert {r.entity_id for r in found if r.action == "MERGE"} <= {f"entity:{r.target}" for r in found}
    events = spark.createDataFrame([("b0", "e1"), ("b0", "e2"), ("b9", "e3")], "batch string, event_id string")
    edges = resolution.extraction_edges(spark.createDataFrame(found), events).collect()
    entities = {r.entity_id for r in found if r.batch == "b0"}
    assert {(r.src, r.dst) for r in edges if r.edge_type == "REFERENCES"} == {(e, x) for e in ("e1", "e2") for x in entities}
    assert resolution.resolved_in_order(spark.createDataFrame([], "batch string, ordinal int, name string, entity_type string"), spark.createDataFrame(known, "ordinal int, name string, entity_type string")).count() == 0


def test_beliefs_meet_in_their_category_only(spark):
    rows = [(k, str(k % 100), f"belief number {k} holds that things are so and so") for k in range(300)]
    low = spark.createDataFrame(rows, "id int, category string, t string")
    pairs = resolution.likely_pairs(low.selectExpr("category", "t as l"), low.selectExpr("category", "t as r"), 0.6, "category")
    assert pairs.count() == 900


def test_grams_lose_no_pair(spark):
    rng = random.Random(6)
    texts = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 24))) for _ in range(150)}
    for t in list(texts)[:80]:
        x = list(t)
        for _ in range(rng.randint(1, 2)):
            x.insert(rng.randrange(len(x) + 1), rng.choice("abcx"))
        texts.add("".join(x))
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    met = {(r.l, r.r) for r in resolution.likely_pairs(table.selectExpr("t as l"), table.selectExpr("t as r"), 0.9).collect()}
    near = {(a, b) for a in texts for b in texts if SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9}
    assert near <= met and len(met) < 0.3 * len(texts) ** 2


def test_archive_goes_on_where_it_broke_off(spark, folder, tmp_path):
    from emberlake.sources.ledger import NOW_US, Tables

    events, path = Tables(spark, folder).ledger, str(tmp_path)
    old = retention.expired(events, NOW_US, 20).count()
    some = events.where("day(occurred_at) < 5")
    retention.archive_days(some, NOW_US, 20, path)
    before = {r.day: r.n for r in retention.committed(spark, path).collect()}
    (tmp_path / "events" / "y=2024" / "m=01" / "d=06").mkdir(parents=True)  # what a run leaves that broke off
    (tmp_path / "events" / "y=2024" / "m=01" / "d=06" / "part-broken.json").write_text('{"event_id":"half"}\n')
    left = retention.archive_then_delete(events, NOW_US, 20, path)
    assert left.count() == events.count() - old
    after = {r.day: r.n for r in retention.committed(spark, path).collect()}
    assert before.items() <= after.items() and sum(after.values()) == old == archived(spark, f"{path}/events").count()


def test_as_of_takes_what_was_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", 7, 4)], "k string, t int, row int")
    right = spark.createDataFrame([("a", 1, 0.1), ("a", 5, 0.5), ("b", 10, 1.0)], "k string, t int, v double")
    assert {r.row: r.v for r in users.as_of(left, right, ["k"], "t", "v").collect()} == {1: 0.1, 2: None, 3: None, 4: 0.5}


def test_texts_that_are_shown(spark):
    long = "x" * 600
    rows = [("api_key=abc token: t1 postgres://u:p@h/db",), (long,), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "m string").select(text.shown_error("m").alias("s")).collect()]
    assert found[0] == "api_key=*** token: *** postgres://***" and found[1] == "x" * 500 + "..." and found[2] is None
    cursors = spark.createDataFrame([("MTI=",), ("!!",), (None,), ("LTU=",)], "c string")
    assert [r[0] for r in cursors.select(text.offset_of("c").alias("n")).collect()] == [12, 0, 0, 0]


def test_scenario_documents_share_files(spark, tmp_path):
    """Files follow the tasks, not the scenarios; documents come back whole, line ends in texts included. A file of one document over several lines is still read."""
    made = spark.createDataFrame([(f"s{k}", [(f"e{k}", "a\nb")] * (k % 3)) for k in range(60)], "scenario string, events array<struct<event_id:string,said:string>>").repartition(2)
    write_scenarios(made, f"{tmp_path}/many")
    assert len(list((tmp_path / "many").glob("*.json"))) <= 2
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(read_scenarios(spark, f"{tmp_path}/many", made.schema)) == key(made)
    (tmp_path / "one.json").write_text('{\n "scenario": "x"\n}')
    assert scenarios(spark, f"{tmp_path}/one.json").first().scenario == "x"


def test_the_scenario_query_writes_no_file_for_each_session(spark, folder):
    before = set(Path(shared_folder(spark).removeprefix("file://")).glob("scenarios-*"))
    QUERIES["scenario_events"](spark, folder)
    (new,) = set(Path(shared_folder(spark).removeprefix("file://")).glob("scenarios-*")) - before
    assert len(list(new.rglob("*.json"))) <= 8


def test_lineage_holds_few_starts_in_a_task(spark, monkeypatch):
    """However few files the starts come from, tasks that put paths together have a bounded number; paths that have ended don't meet in one task of a join."""
    edges = spark.createDataFrame([(f"n{k}", f"n{k // 2}") for k in range(2, 600)], "src string, dst string").coalesce(1)
    starts = spark.createDataFrame([(f"n{k}",) for k in range(1, 600)], "id string").coalesce(1)
    monkeypatch.setattr(graph, "STARTS", 50, raising=False)
    found = graph.lineage(edges, starts, 10)
    assert {(r.start, r.ancestor, r.depth) for r in found.collect()} == {(f"n{k}", f"n{k >> d}", d) for k in range(1, 600) for d in range(1, 11) if k >> d}
    told = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("start").alias("n")).collect()
    assert max(r.n for r in told) <= 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "coalesce(node" in graph.lineage(edges, starts, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_index_joins_its_counts_once(spark, tmp_path):
    """Scores are stored before they are dealt out by range, which would join twice; levels begin at 0 with each term's best."""
    docs = spark.createDataFrame([(str(k), "s", "a " * (k % 4 + 1) + f"b{k % 9}", "c") for k in range(80)], "id string, session string, summary string, keywords string")
    index = textindex.build(docs, path=f"{tmp_path}/i")
    own, levels = index.postings(spark), index.levels(spark)
    stored = spark.read.parquet(f"{tmp_path}/i/scored")
    names = ["term", "id", "score", "level", "bucket"]
    assert sorted(map(tuple, stored.select(names).collect())) == sorted(map(tuple, own.select(names).collect()))
    assert {r[0] for r in levels.groupBy("term").agg(F.min("level")).select("min(level)").collect()} == {0}
    assert own.count() == 240 and levels.agg(F.sum("n")).first()[0] == 240


def test_the_index_holds_postings_once_however_they_are_dealt_out(spark, tmp_path, monkeypatch):
    """Many slices, terms dealt out by id, repeated rows of an id, documents without words; one stored copy of the postings, no shuffles left to add up."""
    rng = random.Random(9)
    rows = [(f"d{k}", f"s{k % 3}", " ".join(["all"] * (k % 4) + rng.choices([f"w{n}" for n in range(50)], k=k % 12)), "some" if k % 2 else None) for k in range(300)]
    rows += [rows[7], rows[7], ("d8", "s2", "other words", "some"), ("none", "s1", None, None), ("none", "s1", "", "")]
    monkeypatch.setattr(textindex, "SLICE", 5)
    monkeypatch.setattr(textindex, "TASK", 100)
    before = spark.conf.get(textindex.CLEANUP, None)
    index = textindex.build(spark.createDataFrame(rows, "id string, session string, summary string, keywords string").repartition(4), path=f"{tmp_path}/i", buckets=8)
    assert spark.conf.get(textindex.CLEANUP, None) == before
    tf, sizes = defaultdict(float), []
    for i, s, a, b in rows:
        found = [[x for x in (t or "").split()] for t in (a, b)]
        sizes.append(sum(map(len, found)))
        for words, w in zip(found, (2.0, 1.5), strict=True):
            for x in words:
                tf[i, s, sizes[-1], x] += w
    df, avg, n = Counter(x for *_, x in tf), sum(sizes) / len(sizes), len(rows)
    want = sorted((x, i, s, math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))) for (i, s, dl, x), f in tf.items())
    got = sorted((r.term, r.id, r.session, r.score) for r in index.postings(spark).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    assert {r.term: r.n for r in index.levels(spark).groupBy("term").agg(F.sum("n").alias("n")).collect()} == df
    assert max(df.values()) > 100 and spark.read.parquet(f"{tmp_path}/i/often").where("term = 'all' AND shares > 1").count() == 1
    whole = [p.name for p in (tmp_path / "i").iterdir() if "score" in spark.read.parquet(str(p)).columns]
    assert whole == ["scored"]
