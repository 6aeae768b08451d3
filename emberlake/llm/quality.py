"""Quality by regularised quadratic discriminant analysis over document statistics.

Statistics of whole texts (length, letter case, symbols, repetition, word shape, lines) are
transformed towards symmetry. Class means and covariances are sums over labelled training rows,
added up where the rows are: only a few hundred numbers a task leave it. Each class covariance is
shrunk towards the pooled one and towards its own diagonal. The score is the logistic of the
difference of the Gaussian log densities, from Mahalanobis distances by Cholesky factors that are
computed once.

Only rows outside the held-out fold are learned from; labels, language, source and id never enter
a score.

Defined results: a null text counts as empty, and both get the score of a text without words;
a class without training rows, or no labels at all, gives the prior 0.5; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.labelled import held_out, training_sample

#: Most labelled rows that a fit reads.
SAMPLE = 40_000
THRESHOLD = 0.5

STATISTICS = [
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "distinct_words", "distinct_of_200", "longest_word", "words_a_line",
    "repeated_lines", "repeated_triples", "closed_sentences", "bare_words",
]


def distinct_share(words: list[str], width: int = 200) -> float:
    """The mean share of distinct words over all windows of ``width`` words, or over the text where it is shorter."""
    if len(words) <= width:
        return (len(set(words)) + 1) / (len(words) + 1)
    # A place counts in each window that holds it and doesn't hold the same word earlier.
    last: dict[str, int] = {}
    total, end = 0, len(words) - width
    for k, word in enumerate(words):
        total += max(0, min(k, end) - max(last.get(word, -1) + 1, k - width + 1, 0) + 1)
        last[word] = k
    return (total / (end + 1) + 1) / (width + 1)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(raw) + 1
    lines = [x for x in text.split("\n") if x]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum() + 1
    marks = counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - marks + counts[33]
    root = lambda x: float(x) ** 0.5
    return [
        np.log1p(n), np.log((size - n) / (n + 1) + 1), root(counts[65:91].sum() / letters), root(counts[48:58].sum() / size), root(marks / (n + 1)),
        root(symbols / (n + 1)), (len(set(words)) + 1) / (n + 1), distinct_share(words), np.log1p(max(map(len, words), default=0)),
        np.log1p(n / max(1, len(lines))), root(1 - len(set(lines)) / len(lines)) if lines else 0.0, root(1 - len(set(triples)) / len(triples)) if triples else 0.0,
        root((counts[46] + counts[63] + counts[33]) / (n + 1)), root(sum(map(str.isalpha, words)) / (n + 1)),
    ]


@dataclasses.dataclass
class Model:
    """Mean, inverse Cholesky factor and log normaliser of each class, and the log prior odds."""

    means: np.ndarray
    inverse: np.ndarray
    log_norm: np.ndarray
    odds: float


def discriminant(count: np.ndarray, total: np.ndarray, product: np.ndarray, own: float = 0.9, diagonal: float = 0.02) -> Model | None:
    """The model from class counts, sums and sums of products.

    own: weight of a class's covariance against the pooled one (in proportion to its rows);
    diagonal: weight of its diagonal against the rest.
    """
    if min(count) < 2:
        return None
    means = total / count[:, None]
    scatter = product - count[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / count.sum()
    inverse, log_norm = [], []
    for k in range(2):
        weight = own * count[k] / (count[k] + pooled.shape[0])
        cov = weight * scatter[k] / count[k] + (1 - weight) * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        log_norm.append(np.log(np.diag(factor)).sum())
    return Model(means, np.array(inverse), np.array(log_norm), float(np.log(count[1] / count[0])))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    """The model of at most ``limit`` labelled rows outside the held-out fold; None without two classes."""
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, width)
            y = b.column(2).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(sums)), pa.array(np.arange(len(sums))), pa.array(sums)], ["y", "k", "v"])

    sums = training_sample(docs, labels, "quality", limit).mapInArrow(run, "y long, k long, v double").groupBy("y", "k").agg(F.sum("v").alias("v"))
    made = np.zeros((2, 1 + width + width * width))
    for r in sums.collect():  # two classes of 1 + 14 + 196 numbers
        made[r["y"], r["k"]] = r["v"]
    return discriminant(made[:, 0], made[:, 1 : 1 + width], made[:, 1 + width :].reshape(2, width, width))


def scores(x: np.ndarray, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    density = []
    for k in range(2):
        z = (x - model.means[k]) @ model.inverse[k].T
        density.append(-0.5 * (z * z).sum(axis=1) - model.log_norm[k])
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model.odds, -30, 30)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                x = np.array([statistics(t or "") for t in part.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(scores(x, model), 6))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
