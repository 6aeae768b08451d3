"""Hard negatives and vector codes against plain loops."""

import random

import numpy as np
import pytest

from emberlake.llm import exponion, hardneg

FIELDS = "vec_id long, embedding array<float>, label int, v int, score double, shard string"


def rows_of_vectors(n, seed, clusters=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(clusters)]
    rows = []
    for k in range(n):
        m = middles[k % clusters]
        rows.append((k, [float(np.float32(x + rng.gauss(0, 0.1))) for x in m], k % 10 if k % 5 else k % clusters, 1, 0.5, "x"))
    same = rows[-1][1]
    rows += [(n + k, same, 3, 1, 0.5, "x") for k in range(300)]  # a group of copies
    nan, inf = [float("nan")] * 16, [float("inf")] + [0.0] * 15
    return rows + [(n + 1000, None, 1, 1, 0.5, "x"), (n + 1001, nan, 1, 1, 0.5, "x"), (n + 1002, inf, 1, 1, 0.5, "x"), (n + 1003, [None] * 16, 1, 1, 0.5, "x"), (n + 1004, same, None, 1, 0.5, "x")]


def plain_negatives(rows):
    kept = []
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(e)).astype(int)))
    out = []
    for a, label, v in kept:
        if a % 100:
            continue
        scored = sorted((-int(w @ v), i, other == label) for i, other, w in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [(i, -t) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # several shards, blocks and levels
        for name, value in (("SHARD", 150), ("BLOCK", 4), ("LEAF", 3), ("AT_ONCE", 2)):
            monkeypatch.setattr(hardneg, name, value)
    rows = rows_of_vectors(1200, 5)
    found = hardneg.hard_negatives(spark.createDataFrame(rows, FIELDS).repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows)
    assert hardneg.hard_negatives(spark.createDataFrame([], FIELDS)).count() == 0


def test_node_intervals_hold_all_products_and_prune():
    rng = np.random.default_rng(1)
    one, other = (np.floor(256 * (rng.normal(0, 0.05, (n, 16)) + np.repeat(rng.normal(0, 1, (n // 50, 16)), 50, axis=0))) for n in (200, 2000))
    a, c = hardneg.Tree(one), hardneg.Tree(other)
    assert sorted(np.concatenate([r for r, below in zip(c.rows, c.children, strict=True) if not below])) == list(range(2000))
    for x in range(len(a.rows)):
        low, high = hardneg.intervals(a, x, c, np.arange(len(c.rows)))
        for y in range(len(c.rows)):
            products = one[a.rows[x]] @ other[c.rows[y]].T
            assert low[y] <= products.min() and products.max() <= high[y]
    every = np.tile(np.array([[hardneg.NONE + 1, -hardneg.NONE]]), (200, 1, 1))
    search = hardneg.Search(a, np.arange(200), np.zeros(200), every, c, np.arange(1000, 3000), np.zeros(2000), True, 5)
    search.run()
    assert search.pairs < 0.5 * 200 * 2000
    want = np.argsort(-(one @ other.T), axis=1, kind="stable")[:, :5] + 1000
    assert (np.sort(search.found[:, 0], axis=1) == np.sort(want, axis=1)).mean() == 1.0


def plain_codes(rows, entries=16, rounds=6):
    kept = sorted((i, np.floor(4096 * np.array(e)).astype(int), label) for i, e, label, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e))
    x = np.stack([v for _, v, _ in kept]).reshape(len(kept), 8, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if k < rounds:
            for p in range(8):
                for e in set(code[:, p].tolist()):
                    own = x[code[:, p] == e, p]
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    error = d.min(axis=2).sum(axis=1)
    labels = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        labels[label] = labels.get(label, 0) + int(e)
    digest = exponion.fingerprint(books)
    return sorted((i, "".join(f"{c:02x}" for c in row), int(e), labels[label], digest) for (i, _, label), row, e in zip(kept, code, error, strict=True))


@pytest.mark.parametrize("n", [3, 900])
def test_vector_codes(spark, monkeypatch, n):
    rows = rows_of_vectors(n, 7)
    if n == 3:
        rows = rows[:3] + rows[-5:]
    want = plain_codes(rows)
    assert sorted(tuple(r) for r in exponion.codes(spark.createDataFrame(rows, FIELDS).repartition(4)).collect()) == want
    monkeypatch.setattr(exponion, "FEW", 0)  # labels met in a shuffled join
    assert sorted(tuple(r) for r in exponion.codes(spark.createDataFrame(rows, FIELDS)).collect()) == want
    assert exponion.codes(spark.createDataFrame([], FIELDS)).count() == 0


def test_exponion_search_reads_less_and_finds_the_same():
    rng = np.random.default_rng(3)
    entries = rng.integers(-50, 50, (16, 4)) * 1000
    entries[9] = entries[2]  # equal entries: the lower index
    points = entries[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 4))
    before = rng.integers(0, 16, 4000)
    best, least = exponion.exponion(points, before, entries, exponion.neighbours(entries))
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_vectors_that_have_no_codes(spark):
    with pytest.raises(ValueError):
        exponion.codes(spark.createDataFrame([(1, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(ValueError):
        exponion.codes(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], "vec_id long, embedding array<float>, label int"))
