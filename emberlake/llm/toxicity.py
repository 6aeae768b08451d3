"""Toxicity by weak supervision.

Voters: words and word beginnings that labelled training rows suggest, a standing list of insults,
and patterns (several hits, shouting, exclamation, address, masked words). A voter fires or
abstains. A generative label model says how often each voter fires in either class and how voters
depend on each other: within a class the votes are a tree of pairwise correlations (the spanning
tree of most conditional mutual information), so every voter may lean on one other. Its accuracies
and correlations are estimated by expectation-maximisation over labelled rows, whose class is known,
and unlabelled rows, whose class is not. The labels go no further: the posterior label of a row,
labelled or not, comes from its votes alone. A linear classifier is trained on the posterior labels,
over hit counts and pattern values, and scores every whole text in one pass without a shuffle.

Only rows outside the held-out fold are learned from, at most ``SAMPLE`` labelled and ``UNLABELLED``
others; labels, language, source and id never enter a score.

Defined results: null and empty texts have no hits and get the score of such texts; without
labelled rows of both classes the standing list alone decides; of several rows of one id one is learned
from; repeated rows each give a row; an empty table gives an empty result; other columns are ignored,
and a column of a caller that is called toxicity_score is replaced by ``with_score`` and kept by ``not_toxic``.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import shuffle_partitions, stored
from emberlake.llm.labelled import held_out, training_sample, unlabelled_sample

#: Most labelled rows that a fit reads.
SAMPLE = 20_000
#: Most unlabelled rows that a fit reads, and what one counts against a labelled row.
UNLABELLED, UNLABELLED_WEIGHT = 10_000, 0.5
#: Most mined lexicon voters.
VOTERS = 96
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

# A standing list of insults.
INSULTS = ["asshole", "bastard", "dickhead", "dumbass", "idiot", "imbecile", "moron", "scumbag", "stupid", "arschloch", "dummkopf", "vollidiot", "connard", "salope", "cabrón", "gilipollas"]
# Words that address the reader.
ADDRESS = ["you", "your", "du", "dein", "tu", "toi", "tú", "usted"]

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]\*+[^\W\d_]")
PATTERNS = 6
#: Longest word beginning that a mined entry can be.
LONGEST = 9


@dataclasses.dataclass
class Model:
    """Lexicon entries (text, is a whole word) and the linear classifier over their features."""

    entries: list[tuple[str, bool]]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def parts(text: str) -> set[str]:
    """The words of a text, marked =, and their proper beginnings of 3 to LONGEST letters."""
    words = set(WORD.findall(text.lower()))
    return {f"={w}" for w in words if len(w) < 64} | {w[:n] for w in words for n in range(3, min(LONGEST + 1, len(w)))}


def evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The log-likelihood ratio of an entry's documents against the two classes."""
    term = lambda x: x * math.log(x) if x > 0 else 0.0
    n = all_toxic + all_clean
    with_it = term(toxic) + term(clean) - term(toxic + clean)
    without = term(all_toxic - toxic) + term(all_clean - clean) - term(n - toxic - clean)
    return 2 * (with_it + without - term(all_toxic) - term(all_clean) + term(n))


def mined(sample: DataFrame, most: int = VOTERS, least: int = 5, precision: float = 0.7) -> list[tuple[str, bool]]:
    """Lexicon entries (text, is a whole word) that labelled toxic rows contain and others hardly do.

    An entry stands in at least ``least`` toxic rows, and at least ``precision`` of its rows are
    toxic. Entries with the strongest evidence come first; what an accepted sharp beginning or
    word covers isn't taken again.
    """

    def counted(toxic_ones: bool, within: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if bool(y) == toxic_ones:
                        seen.update(parts(text) if within is None else parts(text) & within)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

        return sample.mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    toxic = {r["entry"]: r["n"] for r in counted(True, None).where(F.col("n") >= least).collect()}
    if not toxic:
        return []
    clean = {r["entry"]: r["n"] for r in counted(False, set(toxic)).collect()}
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    sharp = {e: n for e, n in toxic.items() if n >= precision * (n + clean.get(e, 0))}
    weight = {e: evidence(n, clean.get(e, 0), totals.get(1, 0), totals.get(0, 0)) for e, n in sharp.items()}
    taken: list[tuple[str, bool]] = []
    for e in sorted(sharp, key=lambda e: (-weight[e], e[0] != "=", len(e), e)):
        word, whole = e.lstrip("="), e[0] == "="
        covered = any(word.startswith(x) and not is_word and clean.get(x, 0) <= 0.05 * sharp[x] for x, is_word in taken)
        same = not whole and any(x.startswith(word) and sharp["=" * is_word + x] >= 0.9 * sharp[e] for x, is_word in taken)
        if not covered and not same:
            taken.append((word, whole))
            if len(taken) == most:
                break
    return taken


def features(entries: list[tuple[str, bool]]):
    """A function from texts to a matrix: hits of each entry, then the pattern values."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, bool]]] = {}
    for k, (word, whole) in enumerate([*entries, *((w, True) for w in ADDRESS)]):
        at.setdefault(word, []).append((min(k, len(entries)), whole))
    for word, uses in at.items():
        finder.add_word(word, (len(word), uses))
    finder.make_automaton()
    n = len(entries)

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), n + PATTERNS))
        for i, text in enumerate(texts):
            row, low = out[i], text.lower()
            for end, (size, uses) in finder.iter(low):
                if end - size < 0 or not low[end - size].isalpha():
                    closed = end + 1 == len(low) or not low[end + 1].isalpha()
                    for k, whole in uses:
                        if closed or not whole:
                            row[k] += 1
            address, hits = row[n], row[:n].sum()
            plain = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
            size = len(text) + 20
            row[n:] = [hits > 0, hits, 1000 * hits / size, address, plain[65:91].sum() / size > 0.3, plain[33] / size > 0.02 or bool(plain[42] and MASKED.search(text))]
        out[:, :n] = np.log1p(out[:, :n])
        out[:, n + 1 : n + 4] = np.log1p(out[:, n + 1 : n + 4])
        return out

    return run


@dataclasses.dataclass
class LabelModel:
    """The class prior, each voter's parent (-1: none) and log P(vote | class, the parent's vote): [class, voter, parent's vote, vote]."""

    prior: float
    parent: np.ndarray
    log_p: np.ndarray


def vote_tables(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts [a, b, j, k] of voter j voting a while voter k votes b."""
    both, one, n = (votes * weight[:, None]).T @ votes, weight @ votes, weight.sum()
    mine, other = one[:, None] - both, one[None, :] - both
    return np.array([[n - both - mine - other, other], [mine, both]])


def dependencies(tables: list[np.ndarray], least: float = 60.0) -> np.ndarray:
    """Parents of a spanning forest of most conditional mutual information, given the class.

    An edge needs a log-likelihood ratio of ``least``; weaker pairs count as independent.
    """
    gain = 0.0
    for t in tables:
        t = t + 1e-9
        n = t.sum(axis=(0, 1))
        gain = gain + 2 * (t * np.log(t * n / (t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True)))).sum(axis=(0, 1))
    m = gain.shape[0]
    parent, best, source, left = np.full(m, -1), np.zeros(m), np.full(m, -1), set(range(m))
    while left:
        j = max(left, key=lambda k: (best[k], -k))
        left.discard(j)
        if best[j] >= least:
            parent[j] = source[j]
        closer = gain[j] > best
        best, source = np.where(closer, gain[j], best), np.where(closer, j, source)
    return parent


def estimated(votes: np.ndarray, p: np.ndarray, weight: np.ndarray, parent: np.ndarray | None = None) -> LabelModel:
    """The model of votes whose class is 1 with probability ``p``; small counts lean towards the voter's own rate."""
    m = votes.shape[1]
    tables = [vote_tables(votes, weight * q) for q in (1 - p, p)]
    parent = dependencies(tables) if parent is None else parent
    log_p = np.empty((2, m, 2, 2))
    for y, (t, n) in enumerate(zip(tables, ((weight * (1 - p)).sum(), (weight * p).sum()), strict=True)):
        rate = (t[1, 1].diagonal() + 0.1) / (n + 1)
        for j in range(m):
            own = np.array([1 - rate[j], rate[j]])
            for b in range(2):
                seen = t[:, b, j, parent[j]] if parent[j] >= 0 else np.zeros(2)
                log_p[y, j, b] = np.log((seen + own) / (seen.sum() + 1))
    return LabelModel(float(((weight * p).sum() + 1) / (weight.sum() + 2)), parent, log_p)


def posterior(votes: np.ndarray, model: LabelModel) -> np.ndarray:
    """P(class 1 | votes) of each row."""
    m = votes.shape[1]
    ahead = np.where(model.parent[None, :] >= 0, votes[:, model.parent], 0).astype(int)
    at = np.arange(m)[None, :]
    gain = (model.log_p[1] - model.log_p[0])[at, ahead, votes.astype(int)].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(np.log(model.prior / (1 - model.prior)) + gain, -30, 30)))


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25, unlabelled_weight: float = UNLABELLED_WEIGHT) -> LabelModel:
    """The model by expectation-maximisation; ``known``: 0 or 1, or -1 where the class isn't known."""
    told = known >= 0
    weight = np.where(told, 1.0, unlabelled_weight)
    p = np.where(told, known, 0.0).astype(float)
    model = estimated(votes, p, told.astype(float))
    for _ in range(rounds if not told.all() else 0):
        new = np.where(told, p, posterior(votes, model))
        model = estimated(votes, new, weight, model.parent)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights (the last: intercept) of a logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """The model of at most ``limit`` labelled and ``unlabelled`` other rows outside the held-out fold."""
    both = training_sample(docs, labels, "toxic", limit).unionByName(unlabelled_sample(docs, labels, "toxic", unlabelled))
    # Four passes read the sample, two the documents.
    sample = stored(both.repartition(shuffle_partitions(docs.sparkSession), "doc_id"), "toxicity-sample")
    entries = mined(sample.where("y >= 0"))
    entries += [(w, True) for w in INSULTS if not any(w == x or (w.startswith(x) and not whole) for x, whole in entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(entries)
        for b in batches:
            rows = of(b.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "x"])

    rows = sample.mapInArrow(run, "y int, x binary").toArrow()  # at most ``limit`` + ``unlabelled`` short rows
    width = len(entries) + PATTERNS
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, width).astype(float)
    y = rows.column("y").to_numpy().astype(int)
    if len(set(y.tolist()) - {-1}) < 2:
        return Model(entries, np.append(np.eye(width)[len(entries)] * 4, -3.0), np.zeros(width), np.ones(width))
    order = np.lexsort([*x.T[::-1], y])  # the same sums whatever order the rows have come in
    x, y = x[order], y[order]
    fired = np.column_stack([x[:, : len(entries)] > 0, x[:, len(entries) + 1] > 1, x[:, len(entries) + 3 :] > 0]).astype(float)
    p = posterior(fired, label_model(fired, y))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Model(entries, linear((x - mean) / scale, p), mean, scale)


def with_score(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1), in place of any of that name."""
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(model.entries)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                x = (of([t or "" for t in part.column(at).to_pylist()]) - model.mean) / model.scale
                made = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(made, 9))], [*part.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below the threshold."""
    name = "score_" + "_".join(docs.columns)  # no column of the caller's
    return with_score(docs, model, name).where(F.col(name) < THRESHOLD).drop(name)
