"""Near-duplicates by shingles against all pairs."""

import random

import numpy as np

import corpus_pipeline
from emberlake.llm import shingles
from tests.llm.conftest import prose


def plain_components(texts):
    """Smallest id reachable over pairs of five-word similarity 0.8 or more."""
    found = {}
    for i, t in texts:
        w = (t or "").lower().split()
        found[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    first = {i: i for i in found}
    changed = True
    while changed:
        changed = False
        for i, a in found.items():
            for j, b in found.items():
                if first[i] < first[j] and 5 * len(a & b) >= 4 * len(a | b):
                    first[j], changed = first[i], True
    return first


def rows():
    rng = random.Random(11)
    base = prose(rng, 150).split()
    out = [(k, prose(rng, rng.randint(1, 120))) for k in range(30)]
    for k in range(60):  # one large group whose pairs lie on both sides of the bound
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        out.append((100 + k, " ".join(w)))
    return out + [(200, None), (201, " "), (202, "One two"), (203, "one TWO")]


def test_components_equal_those_of_all_pairs(spark):
    texts = rows()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for near, block in ((8, 64), (1, 4)):
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, near, block).collect()} == plain_components(texts)


def test_pipeline_drops_edited_copies(spark):
    words = prose(random.Random(2), 300).split()
    texts = [(1, " ".join(words)), (2, " ".join(w if k % 60 else f"edit{k}" for k, w in enumerate(words))), (3, prose(random.Random(4), 300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    dropped = 0
    for size in (1, 4, 30, 500, 513, 1100, 5000):
        for share in (0.0, 0.5, 0.78, 0.8, 0.85, 0.89, 0.9, 1.0):
            kept = int(size * share)
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            y = np.unique(np.concatenate([x[: min(kept, len(x))], rng.integers(0, 2**64, rng.integers(1, size + 1), np.uint64)]))
            a, b = shingles.sketch(x), shingles.sketch(y)
            width = min(len(a), len(b))
            apart = int(shingles.bits_apart([a, b], width)[0, 1])
            assert apart == sum((p ^ q).bit_count() for p, q in zip(shingles.narrower(a, width).tolist(), shingles.narrower(b, width).tolist()))
            assert apart <= len(np.setxor1d(x, y))
            if shingles.similar(len(np.intersect1d(x, y)), len(x), len(y)):
                assert shingles.possible(apart, len(x), len(y))
            else:
                dropped += not shingles.possible(apart, len(x), len(y))
    assert dropped > 10
