"""Rules of the engine against plain versions and fixed values."""

import math
import random
import uuid
from difflib import SequenceMatcher

import pytest

from emberlake.model import EVENT_PREFIXES, INTENTS, PREFERENCE_STABILITY
from emberlake.operators import ledger, resolution, retention, retrieval, surface, users


def test_constants():
    assert set(EVENT_PREFIXES) == {"agent", "tool", "llm", "observation", "system", "user"}
    assert PREFERENCE_STABILITY == {"communication": 720, "environment": 720, "tool": 336, "workflow": 336, "domain": 168, "style": 168}


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_fuzzy_finds_what_all_pairs_find(spark):
    rng = random.Random(1)
    known = ["kubernetes", "visual studio code", "github", "postgresql", "billing service", "zzzz quartz", "data lake"] + ["".join(rng.choice("abcdeor ") for _ in range(rng.randint(3, 16))) for _ in range(60)]
    new = ["ubernetes", "Visual Studio Codes", "gthub", "postgresqll", "biling service", "VSCode"]
    for name in known[:50]:
        letters = list(name)
        for _ in range(rng.randint(0, 2)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz")
        new.append("".join(letters))
    frame = lambda names: spark.createDataFrame([(n, "tool") for n in dict.fromkeys(names)], "name string, entity_type string")
    found = {r.name: r.confidence for r in resolution.fuzzy(frame(new), frame(known)).collect()}
    forms = lambda n: {" ".join(n.lower().split()), {"vscode": "visual studio code"}.get(n.lower(), " ".join(n.lower().split()))}
    want = {}
    for a in set(new):
        best = max(ratio(x, y) for b in known for x in forms(a) for y in forms(b))
        if best >= 0.9:
            want[a] = round(best, 4)
    assert found == want and {"ubernetes", "Visual Studio Codes", "gthub", "VSCode"} <= set(found)


def test_belief_contradictions_find_what_all_pairs_find(spark):
    rng = random.Random(2)
    words = "the deploy runs on every night and each team owns one small service here".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(40)]
    texts += ["In fact " + t for t in texts[:15]]
    rows = [(k, "x" if k % 2 else "y", t) for k, t in enumerate(texts)] + [(99, "x", texts[1])]
    found = {(r.a, r.b) for r in resolution.belief_contradictions(spark.createDataFrame(rows, "belief_id long, category string, belief_text string")).collect()}
    want = {(a, b) for a, c, t in rows for b, d, u in rows if a < b and c == d and (0.6 <= ratio(t.lower(), u.lower()) <= 0.95 or 0.6 <= ratio(u.lower(), t.lower()) <= 0.95)}
    sure = {(a, b) for a, b in want if all(0.6 <= ratio(x, y) <= 0.95 for x, y in ((dict((r[0], r[2]) for r in rows)[a].lower(), dict((r[0], r[2]) for r in rows)[b].lower()),) for x, y in ((x, y), (y, x)))}
    assert sure <= found <= want and any(not t.startswith("In fact") for t in texts)


def test_belief_winner_without_times(spark):
    rows = [("a", "b", 0.5, 0.5, None, 9, 3, 2), ("a", "b", 0.5, 0.5, 7, 9, 3, 2), ("a", "b", 0.5, 0.5, 9, 9, 3, 3), ("a", "b", 0.6, 0.5, 1, 9, 1, 2)]
    pairs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, a string, b string, a_confidence double, b_confidence double, a_us long, b_us long, a_count int, b_count int")
    assert [resolution.belief_winner(pairs.where(f"n = {k}")).first().winner for k in range(4)] == ["a", "b", "b", "a"]


def test_pages_over_ids_that_are_not_numbers(spark):
    ids = [str(uuid.UUID(int=k * 7919)) for k in range(20)]
    events = spark.createDataFrame([(i, 5 + k // 4) for k, i in enumerate(ids)], "event_id string, occurred_us long")
    order = sorted(((5 + k // 4, len(i), i) for k, i in enumerate(ids)), reverse=True)
    seen, here = [], (10**9, 0, "")
    while True:
        page = sorted(ledger.page_after(events, here[0], here[2], 6).collect(), key=lambda r: (r.occurred_us, r.event_id), reverse=True)
        seen += [r.event_id for r in page]
        if not page or not page[0].has_more:
            break
        here = (page[-1].occurred_us, 0, page[-1].event_id)
    assert seen == [x[2] for x in order]
    assert [r.event_id for r in surface.capped_ids(events, 3).orderBy("event_id").collect()] == sorted(ids)[:3]


def test_mmr_ranks_all_candidates(spark):
    rows = [("q", f"{k:04d}", k / 1000, [1.0, k / 1000]) for k in range(800)]
    top = retrieval.mmr(spark.createDataFrame(rows, "qid string, id string, relevance double, vector array<double>"), 1).first()
    assert top.id == "0799"


def test_intents_equal_a_plain_count(spark):
    import re

    texts = ["Why did it fail because of the root cause?", "timeline", "due to user order, how and when", "", None, "Likely unlike like", "time time time before"]
    found = {}
    for r in retrieval.intents(spark.createDataFrame(list(enumerate(texts)), "qid int, text string")).collect():
        found.setdefault(r.qid, {})[r.intent] = round(r.confidence, 6)
    for k, t in enumerate(texts):
        hits = {n: min(1.0, 0.4 * sum(bool(re.search(rf"\b{w}\b", (t or "").lower())) for w in ws)) for n, ws in INTENTS.items()}
        hits = {n: h for n, h in hits.items() if h}
        assert found[k] == ({n: round(h / max(hits.values()), 6) for n, h in hits.items()} if hits else {"general": 0.5})


def test_preference_score(spark):
    from pyspark.sql import functions as F

    hour = 3_600_000_000
    row = spark.range(1).select(users.preference_decay(F.lit(0), F.lit(10 * hour), F.lit("communication"), F.lit(0.5), F.lit(0.25), 730 * hour).alias("s")).first()
    assert row.s == pytest.approx(math.exp(-1) + 0.8 * 0.5 + 0.8 * 0.25)


def test_user_writes(spark):
    items = spark.createDataFrame([("user:1", "p1", "tea", ["1", "2"], None, None), ("user:1", "p1", "tea", ["2"], None, None), ("user:2", "p2", None, [], "rules", "s")], "user_entity_id string, preference_id string, about_entity string, source_event_ids array<string>, method string, session_id string")
    made = {(r.src, r.dst, r.edge_type): dict(r.properties) for r in users.preference_edges(items).collect()}
    assert set(made) == {("user:1", "p1", "HAS_PREFERENCE"), ("user:2", "p2", "HAS_PREFERENCE"), ("p1", "entity:tea", "ABOUT"), ("p1", "1", "DERIVED_FROM"), ("p1", "2", "DERIVED_FROM")}
    assert made["p1", "1", "DERIVED_FROM"] == {"method": "llm_extraction", "session_id": ""} and users.users_of(items).count() == 2
    skills = spark.createDataFrame([("user:1", "s1", None, 0.9, None, ["4"], None, "x")], "user_entity_id string, skill_id string, proficiency double, confidence double, source string, source_event_ids array<string>, method string, session_id string")
    has = {r.edge_type: dict(r.properties) for r in users.skill_edges(skills).collect()}
    assert has["HAS_SKILL"] == {"proficiency": "0.5", "confidence": "0.9", "source": "inferred"} and has["DERIVED_FROM"]["session_id"] == "x"
    wish = spark.createDataFrame([("user:1", "jazz", 0.7, "declared")], "user_entity_id string, entity_name string, weight double, source string")
    assert users.interest_edges(wish).first().dst == "entity:jazz"
    with pytest.raises(ValueError):
        users.derived_from(items, "event_id")


def test_erasure_and_export(spark):
    nodes = spark.createDataFrame([("u1", "Entity", "Ann"), ("u2", "Entity", "Bo"), ("f1", "UserProfile", "p"), ("p1", "Preference", "x"), ("p2", "Preference", "y"), ("s1", "Skill", "s"), ("b1", "BehavioralPattern", "b"), ("e1", "Entity", "e")], "id string, label string, name string")
    edges = spark.createDataFrame([("u1", "f1", "HAS_PROFILE"), ("u1", "p1", "HAS_PREFERENCE"), ("u2", "p2", "HAS_PREFERENCE"), ("u1", "s1", "HAS_SKILL"), ("u2", "s1", "HAS_SKILL"), ("u1", "b1", "EXHIBITS_PATTERN"), ("u1", "e1", "INTERESTED_IN"), ("u2", "u1", "SAME_AS"), ("p1", "9", "DERIVED_FROM"), ("p2", "8", "DERIVED_FROM")], "src string, dst string, edge_type string")
    left, kept, affected = users.erase_user(nodes, edges, "u1")
    assert {(r.id, r.name) for r in left.collect()} == {("u1", "REDACTED"), ("u2", "Bo"), ("p2", "y"), ("s1", "s"), ("e1", "e")}
    assert {tuple(r) for r in kept.collect()} == {("u2", "p2", "HAS_PREFERENCE"), ("u2", "s1", "HAS_SKILL"), ("p2", "8", "DERIVED_FROM")} and affected.first().affected == 1
    assert users.erase_user(nodes, edges, "nobody")[2].first().affected == 0
    told = {(r.kind, r.id) for r in users.export_user(nodes, edges, "u1").collect()}
    assert told == {("profile", "f1"), ("preferences", "p1"), ("skills", "s1"), ("patterns", "b1"), ("interests", "e1"), ("provenance_chains", "p1>9")}


def test_orphans_of_five_labels(spark):
    nodes = spark.createDataFrame([(label, label) for label in [*retention.ORPHAN_LABELS, "Summary", "UserProfile"]], "id string, label string")
    edges = spark.createDataFrame([("Skill", "x", "DERIVED_FROM")], "src string, dst string, edge_type string")
    assert {r.id for r in retention.orphan_sweep(nodes, edges).collect()} == {"Entity", "Preference", "Workflow", "BehavioralPattern"}


def test_stored_ledger_prunes(spark, folder):
    from emberlake.sources.ledger import Tables

    plan = Tables(spark, folder).ledger.where("event_id = '123'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,123)" in plan and "Exchange" not in plan and "Window" not in plan


def test_quotes_by_a_like_stretch(spark):
    from pyspark.sql import functions as F

    from emberlake.functions.text import inline_payload, quote_window

    def plain(q, t):
        q, t = " ".join(q.lower().split()), " ".join(t.lower().split())
        if len(q) > len(t):
            return ratio_junk(q, t) >= 0.6
        return any(ratio_junk(q, t[k : k + len(q)]) >= 0.6 for k in range(0, len(t) - len(q) + 1, max(1, len(q) // 4)))

    ratio_junk = lambda a, b: SequenceMatcher(None, a, b).ratio()
    rows = [("the depoy was slwo tdy", "we saw that the deploy was slow today at noon"), ("nothing alike zzz qqq", "we saw the deploy"), ("a very long quote that exceeds", "long quote exceed"), ("", "x"), (None, "x")]
    found = spark.createDataFrame(rows, "q string, t string").select(quote_window(F.col("q"), F.col("t")).alias("ok")).collect()
    assert [r.ok for r in found] == [plain(*rows[0]), plain(*rows[1]), plain(*rows[2]), False, False] and found[0].ok
    refs = spark.createDataFrame([('{"a": 1}',), (" {}",), ("[1]",), ("{broken",), ("s3://x",), (None,)], "r string").select(inline_payload(F.col("r")).alias("p")).collect()
    assert [r.p for r in refs] == ['{"a": 1}', " {}", None, None, None, None]
