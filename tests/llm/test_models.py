"""Toxicity, quality, Katz scores and decontamination against plain versions and held-out accuracy."""

import math
import random
import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlake.llm import decontam, katz, quality, toxicity
from emberlake.llm import labelled as labelled_rows
from tests.llm.conftest import prose

STEMS = ["gruk", "blart", "snivex"]


@pytest.fixture(scope="session")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        text, toxic, good = prose(rng, rng.randint(20, 90)), int(rng.random() < 0.3), int(rng.random() < 0.7)
        words = text.split(" ")
        if not good:
            words = [w.upper() + "!!" for w in words[:10]] * 6
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(["", "ing", "ed"]))
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    docs += [(5000, None), (5001, ""), (5002, "gruk " * 30_000), (None, "x")]
    labels += [(5000, None, None), (None, 1, 1), (7, 0, 0), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(found, labels, name):
    rows = found.join(labels.where(f"{name} IS NOT NULL AND doc_id != 7"), "doc_id").collect()
    return np.mean([r.predicted == r[name] for r in rows if r.held_out])


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    rows = {r.doc_id: r for r in found.collect()}
    assert accuracy(found, labels, "toxic") > 0.97 and len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in rows.values())
    assert rows[5000].predicted == rows[5001].predicted == 0 and rows[5000].score == rows[5001].score and rows[5002].predicted == 1


def test_toxicity_ignores_held_out_labels(labelled, spark):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = (dict(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("false"))
    found = toxicity.score(docs.selectExpr("doc_id", "'you idiot' as text").limit(3), model).collect()
    assert all(r.predicted == 1 for r in found) and toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.score(docs.selectExpr("doc_id", "'good day' as text").limit(1), model).first().predicted == 0


def test_label_model_finds_the_reliable_voter_without_using_labels_as_votes():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.4).astype(int)
    votes = np.column_stack([np.where(rng.random(3000) < acc, y, 1 - y) for acc in (0.95, 0.6, 0.6, 0.55)]).astype(float)
    known = np.where(np.arange(3000) < 400, y, -1)
    model = toxicity.label_model(votes, known)
    p = toxicity.posterior(votes, model)
    assert 0.93 < np.mean((p > 0.5) == y) < 0.99 and np.mean((p[:400] > 0.5) == y[:400]) < 1
    flipped = toxicity.posterior(votes[:1], model)  # the same votes, the same posterior, whatever the label
    assert flipped[0] == p[0]


def plain_label_model(votes, known, parent, rounds, weight):
    """The same estimates by loops over rows and voters."""
    def m_step(p, w):
        table, rate = {}, {}
        for y in (0, 1):
            q = [wi * (pi if y else 1 - pi) for wi, pi in zip(w, p, strict=True)]
            for j in range(len(votes[0])):
                rate[y, j] = (sum(qi * v[j] for qi, v in zip(q, votes, strict=True)) + 0.1) / (sum(q) + 1)
                for b in (0, 1):
                    seen = [sum(qi for qi, v in zip(q, votes, strict=True) if parent[j] >= 0 and v[j] == a and v[parent[j]] == b) for a in (0, 1)]
                    for a in (0, 1):
                        own = rate[y, j] if a else 1 - rate[y, j]
                        table[y, j, b, a] = (seen[a] + own) / (sum(seen) + 1)
        prior = (sum(wi * pi for wi, pi in zip(w, p, strict=True)) + 1) / (sum(w) + 2)
        return prior, table

    def joint(model, y, v):
        prior, table = model
        return (prior if y else 1 - prior) * math.prod(table[y, j, v[parent[j]] if parent[j] >= 0 else 0, v[j]] for j in range(len(v)))

    p = [max(k, 0) for k in known]
    model = m_step(p, [float(k >= 0) for k in known])
    for _ in range(rounds):
        p = [k if k >= 0 else joint(model, 1, v) / (joint(model, 0, v) + joint(model, 1, v)) for k, v in zip(known, votes, strict=True)]
        model = m_step(p, [1.0 if k >= 0 else weight for k in known])
    return model, joint


def test_label_model_equals_plain_loops_and_sums_to_one():
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.5).astype(int)
    first = np.where(rng.random(200) < 0.8, y, 1 - y)
    votes = np.column_stack([first, np.where(rng.random(200) < 0.95, first, 1 - first), rng.random(200) < 0.2 + 0.5 * y, rng.random(200) < 0.3]).astype(float)
    known = np.where(np.arange(200) < 80, y, -1)
    model = toxicity.label_model(votes, known, rounds=4)
    assert model.parent[1] == 0 and (model.parent[[0, 2, 3]] == -1).all()  # the copying voter leans on the one it copies
    plain, joint = plain_label_model(votes.astype(int).tolist(), known.tolist(), model.parent.tolist(), 4, toxicity.UNLABELLED_WEIGHT)
    every = [[k >> j & 1 for j in range(4)] for k in range(16)]
    assert sum(joint(plain, c, v) for v in every for c in (0, 1)) == pytest.approx(1)
    assert np.allclose(toxicity.posterior(np.array(every, float), model), [joint(plain, 1, v) / (joint(plain, 0, v) + joint(plain, 1, v)) for v in every])
    # A voter that copies another hardly changes what is believed.
    alone = toxicity.posterior(votes[:, [0, 2, 3]], toxicity.label_model(votes[:, [0, 2, 3]], known, rounds=0))
    assert np.abs(alone - toxicity.posterior(votes, toxicity.label_model(votes, known, rounds=0))).mean() < 0.05


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "x") for k in range(2, 60)] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    for made, most in ((labelled_rows.training_sample(docs, labels, "toxic", 10), 10), (labelled_rows.unlabelled_sample(docs, labels, "toxic", 12), 12)):
        rows = made.collect()
        assert len(rows) == len({r.doc_id for r in rows}) == most and not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_not_toxic_keeps_the_callers_columns(labelled):
    docs, labels = labelled
    kept = toxicity.not_toxic(docs.selectExpr("*", "0.25 as toxicity_score"), toxicity.fit(docs, labels))
    assert kept.columns == ["doc_id", "text", "toxicity_score"] and {float(r.toxicity_score) for r in kept.collect()} == {0.25}


def test_quality_held_out(labelled):
    docs, labels = labelled
    found = quality.score(docs, quality.fit(docs, labels))
    rows = {r.doc_id: r for r in found.collect()}
    assert accuracy(found, labels, "quality") > 0.97 and rows[5000].score == rows[5001].score and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.score(docs.where("false"), None).count() == 0


def test_discriminant_equals_gaussian_densities():
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=(400, 14)), rng.normal(1, 2, (300, 14))]
    count, total, product = np.array([400.0, 300.0]), np.array([x.sum(0) for x in xs]), np.array([x.T @ x for x in xs])
    model = quality.discriminant(count, total, product, own=1.0, diagonal=0.0)
    probe = rng.normal(size=(5, 14))
    density = []
    for k, x in enumerate(xs):
        w = count[k] / (count[k] + 14)
        pooled = sum(count[j] * np.cov(xs[j].T, bias=True) for j in range(2)) / 700
        cov = w * np.cov(x.T, bias=True) + (1 - w) * pooled + 1e-4 * np.eye(14)
        d = probe - x.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(count[k]))
    assert np.allclose(quality.scores(probe, model), 1 / (1 + np.exp(density[0] - density[1])))


def plain_katz(rows):
    train = [t for _, held, t in rows if not held]
    c, pairs, heads, after = Counter(), Counter(), Counter(), defaultdict(set)
    for t in train:
        c.update(t)
        for h, w in zip([0, *t], t, strict=False):
            pairs[h, w] += 1
            heads[h] += 1
            after[h].add(w)

    def weights(counts):
        n = Counter(counts.values())
        points = [(math.log(r), math.log(n[r])) for r in range(1, 7) if n[r]]
        b = -statistics.linear_regression(*zip(*points, strict=True)).slope if len(points) > 1 else 2.0
        ratio = lambda r: (r + 1) * (r + 1) ** -max(b, 1.05) / (r * r ** -max(b, 1.05))
        whole = 6 * 6 ** -max(b, 1.05)
        return [0.0] + [r * (ratio(r) - whole) / (1 - whole) for r in range(1, 6)]

    total, wu, wb = sum(c.values()), weights(c), weights(pairs)
    cut = lambda x, w: x - katz.LARGE if x > katz.K else w[x]
    unknown = sum(x - cut(x, wu) for x in c.values()) / total
    p = lambda w: cut(c[w], wu) / total if c[w] else unknown
    alpha = {h: (1 - sum(cut(pairs[h, w], wb) for w in after[h]) / heads[h]) / (1 - sum(map(p, after[h]))) for h in after}
    prob = lambda h, w: cut(pairs[h, w], wb) / heads[h] if pairs[h, w] else alpha.get(h, 1.0) * p(w)
    for h in [*list(after)[:20], "nobody"]:
        assert sum(prob(h, w) for w in c) + alpha.get(h, 1.0) * unknown == pytest.approx(1)
    return c, total, lambda t: sum(math.log10(prob(h, w)) for h, w in zip([0, *t], t, strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=6, max_size=6))
def test_katz_weights_rise_with_counts(counts):
    w = katz.weights_of(counts)
    assert w[0] == 0 and all(0 < a < b for a, b in zip(w[1:], w[2:], strict=False)) and all(w[r] < r for r in range(1, katz.K + 1)) and w[-1] < katz.K + 1 - katz.LARGE


@pytest.mark.parametrize("block_tokens,splits", [(1 << 20, 1000), (700, 1000), (700, 10**9)])
def test_katz(docs, texts, block_tokens, splits, monkeypatch):
    monkeypatch.setattr(katz, "SPLITS", splits)
    rows = [(i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, [*(t or "").encode().lower().split(), b" end"]) for i, t in texts]
    c, total, score = plain_katz(rows)
    found = defaultdict(list)
    for r in katz.katz_scores(docs, block_tokens, 5).collect():
        found[r.doc_id].append(r)
    for i, held, t in rows:
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(t), sum(c[w] > 0 for w in t), total) and r.base_score == pytest.approx(base) and r.score == pytest.approx(score(t)) for r in found[i])
    assert sum(map(len, found.values())) == len(rows)


def test_katz_without_training(docs, empty):
    assert katz.katz_scores(empty).count() == 0
    held = [r.doc_id for r in katz.katz_scores(docs).where("held_out").collect()]
    only = docs.where(docs.doc_id.isin([i for i in held if i is not None]))
    assert {(r.train_tokens, r.n_known, r.score) for r in katz.katz_scores(only).collect()} == {(0, 0, 0.0)}


def test_leaks(spark):
    item = "On Friday Alice bought 30 apples at 7 dollars each, then gave Alice half of the 30 apples back again."
    rows = [
        (1, "Some words first. " + item + " And more."), (2, "On Monday Bob bought 12 apples at 3 euros each, then gave Bob half of the 12 apples back again."),
        (3, "On Monday Bob bought 12 apples at 3 euros each, then gave Tim half of the 15 apples back again."), (4, "on friday " + "nothing of the kind " * 3000), (5, None), (6, ""), (7, item.upper()),
        (8, "3 4 5 6 7 8 9 10 11 12 13 14"), (1, "Some words first. " + item + " And more."), (9, "we say: call the green river bank now, please"),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, hash int")
    bench = spark.createDataFrame([(7, item), (8, item), (9, "1 2 3 4 5 6 7 8 9"), (10, None), (11, ""), (12, "Call the green river bank now")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    # (7, 7): a copy in capitals is a copy
    assert set(found) == {(1, 7), (2, 7), (7, 7), (9, 12)} and found[1, 7].verbatim and not found[2, 7].verbatim and found[1, 7].coverage == 1
    unfiltered = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, filter_bound=0).collect()}
    assert unfiltered == set(found)
    assert {r.doc_id for r in decontam.decontaminated(docs, bench).collect()} == {3, 4, 5, 6, 8}
    assert decontam.leaks(docs, bench.where("false")).count() == 0 and decontam.leaks(docs.where("false"), bench).count() == 0
