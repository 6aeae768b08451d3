"""Decontamination against a version that compares every window with every other, and planted variants."""

import random
import re
from collections import Counter, defaultdict

import pytest

from emberlake.llm import decontam

TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff](?:[^\x09-\x0d ]*[0-9A-Za-z\x80-\U0010ffff])?")
NAMES = ["Alice", "Bob", "Carla", "Ömer", "Dmitri", "Eve", "Farid"]
PLAIN = "bought sold apples stones river and then gave half of the crate to her friend before market day with every coin left over while rain fell on quiet streets near old mills".split()


def tokens(text):
    """(lower case, form with names, form with names at sentence starts) of each token."""
    text = "".join(c if len(c.encode()) == len(c.lower().encode()) else c.lower() for c in text or "")
    out, first = [], True
    for m in TOKEN.finditer(text):
        raw, low = m[0], m[0].lower()
        kind = low
        if re.search("[0-9]", raw):
            kind = ("quantity",) if re.search(r"[A-Za-z\x80-\U0010ffff]", raw) else ("number",)
        elif low in decontam.UNITS:
            kind = ("unit",)
        capital = kind == low and raw[0] != low[0] and raw[-1] == low[-1] and len(raw.encode()) > 1
        out.append((low, ("name",) if capital and not first else kind, ("name",) if capital else kind))
        rest = text[m.end() : m.end() + 2] + "  "
        first = rest[0] in ".!?:" or (rest[0] in "\"')]" and rest[1] in ".!?:")
    return out


def plain_leaks(docs, items, window=8, literals=4, coverage=0.5, enough=12):
    slot = lambda x: isinstance(x, tuple)
    good = lambda w, f: sum(not slot(t[f]) for t in w) >= literals
    found = set()
    for doc_id, text in set(docs):
        doc = tokens(text)
        for item_id, item_text in items:
            item = tokens(item_text)
            size = min(window, len(item))
            if not size:
                continue
            places = [i for i in range(len(item) - size + 1) if good(item[i : i + size], 1)]
            poor = not places
            if poor and len(item) < literals:
                if [t[0] for t in doc] == [t[0] for t in item]:
                    found.add((doc_id, text, item_id))
                continue
            places = places or list(range(len(item) - size + 1))
            shifts = defaultdict(list)
            for i in places:
                for k in range(len(doc) - size + 1):
                    a, b = item[i : i + size], doc[k : k + size]
                    if [t[0] for t in a] == [t[0] for t in b]:
                        shifts[k - i].append((i, [(i + j, t[0], t[0]) for j, t in enumerate(a) if slot(t[1])]))
                    for f in (1, 2):
                        if not poor and [t[f] for t in a] == [t[f] for t in b] and good(a, f):
                            shifts[k - i].append((i, [(i + j, x[0], y[0]) for j, (x, y) in enumerate(zip(a, b, strict=True)) if slot(x[f])]))
            matched = set()
            for met in shifts.values():
                seen = sorted({p for _, pairs in met for p in pairs})
                votes = defaultdict(Counter)
                for _, a, b in seen:
                    votes[a][b] += 1
                best = {a: min(n, key=lambda b: (-n[b], a != b, [x[1:] for x in seen].index((a, b)))) for a, n in votes.items()}
                matched |= {i for i, pairs in met if all(best[a] == b for _, a, b in pairs)}
            if len(matched) >= coverage * len(places) or len(matched) >= enough:
                found.add((doc_id, text, item_id))
    return found


def sentence(rng, n):
    words = [rng.choice(PLAIN) for _ in range(n)]
    for k in range(2, n, 6):
        words[k] = rng.choice([rng.choice(NAMES), str(rng.randint(2, 99)), f"{rng.randint(2, 99)} kg", "{n}", "{m}"])
    return " ".join([words[0].capitalize(), *words[1:]]) + "."


def filled(template, rng):
    return template.replace("{n}", rng.choice(NAMES)).replace("{m}", str(rng.randint(100, 999)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    templates = [" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(1, 3))) for _ in range(25)]
    items = [(k, filled(t, rng)) for k, t in enumerate(templates)]
    items += [(50, "1 2 3 4 5 6 7 8 9"), (51, "Paris 7"), (52, "Alice met Bob"), (53, "Alice 3 Bob 4 Carla"), (54, "Call the river bank now")]
    around = lambda t: f"{sentence(rng, 12)} {t} {sentence(rng, 9)}"
    docs, planted = [], Counter()
    for k, t in enumerate(templates):
        plain = dict(items)[k]
        for j, (kind, text) in enumerate((("verbatim", plain), ("other values", filled(t, rng)), ("capitals", plain.upper()), ("small letters", plain.lower()), ("behind a changing letter", "Straẞe İ K. " + plain))):
            docs.append((100 * k + 1000 + j, around(text)))
            planted[kind] += 1
            planted[docs[-1]] = (k, kind)
        docs.append((100 * k + 1050, around(" ".join(plain.split()[: len(plain.split()) // 3]))))
    docs += [(k, f"{sentence(rng, 30)} {sentence(rng, 20)}") for k in range(9000, 9060)]
    docs += [(1, "x 1 2 3 4 5 6 7 8 9 y"), (2, "paris 7"), (3, "In Paris 7 came"), (4, "so Alice 3 Bob 4 Carla left"), (5, "they Call the river bank now"), (6, None), (7, ""), (8, "3 4 5 6 7 8 9 10 11 12 13 14")]
    return docs, items, planted


@pytest.mark.parametrize("bound", [500_000, 0])
def test_leaks_equal_those_of_all_windows(spark, corpus, bound):
    docs, items, _ = corpus
    rows = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, hash int, id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = dict(docs)
    found = {(r.doc_id, texts[r.doc_id], r.item_id) for r in decontam.leaks(rows, bench, filter_bound=bound).collect()}
    want = plain_leaks(docs, items)
    assert found == want
    assert {(1, 50), (2, 51), (4, 53), (5, 54)} <= {(a, c) for a, _, c in want} and not {3, 6, 7, 8} & {a for a, _, _ in want}


def test_recall_of_planted_variants(spark, corpus):
    docs, items, planted = corpus
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(rows, bench).collect()}
    caught = Counter(planted[d][1] for d in docs if d in planted and (d[0], planted[d][0]) in found)
    recall = {kind: caught[kind] / n for kind, n in planted.items() if isinstance(kind, str)}
    print(recall)
    assert all(r == 1 for kind, r in recall.items() if kind != "other values") and recall["other values"] >= 0.9


ITEM = "On Friday Alice bought 30 apples at 7 dollars each, then gave Alice half of the crate while rain fell on quiet streets near the old mills of her town."


def found_in(spark, *texts, ids=None):
    rows = spark.createDataFrame([(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string")
    return decontam.leaks(rows, spark.createDataFrame([(1, ITEM)], "item_id long, text string")), rows


def test_letters_whose_lower_case_is_longer_or_shorter(spark):
    found, _ = found_in(spark, "Straẞe. " + ITEM, "İ K Ⱥ " + ITEM)
    assert [(r.coverage, r.verbatim) for r in found.collect()] == [(1.0, True)] * 2


def test_one_edited_mention_costs_only_its_windows(spark):
    found, _ = found_in(spark, ITEM.replace("gave Alice", "gave Tim"))
    assert 0.5 <= found.first().coverage < 1


def test_names_at_sentence_starts(spark):
    item = "Alice bought 30 apples and then sold half. Alice gave the rest to her friend."
    docs = spark.createDataFrame([(1, "Bob bought 12 apples and then sold half. Bob gave the rest to her friend."), (2, "Bob bought 12 apples and then sold half. Tim gave the other crate to his father at night.")], "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.verbatim) for r in found] == [(1, False)]


def test_rows_of_one_id_and_without_id(spark):
    found, rows = found_in(spark, ITEM, ITEM.replace("30", "31"), "nothing of it", ITEM, ITEM, ids=[7, 7, 7, None, 7])
    assert sorted((r.doc_id is None, r.verbatim) for r in found.collect()) == [(False, False), (False, True), (True, True)]
    kept = decontam.decontaminated(rows, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(7, "nothing of it")]
