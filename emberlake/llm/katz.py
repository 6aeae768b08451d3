"""Katz backoff bigram scoring with Good-Turing discounts and exactly normalised backoff weights.

Model: c counts training tokens (words and one end a document), c(h, w) the training bigrams, with
a start symbol before the first token. Counts up to K are discounted by Good-Turing estimates from
smoothed counts of counts, so a larger count never weighs less; larger ones lose LARGE, so that something is always left. P(w | h) is the discounted c(h, w) / c(h) where the bigram is known, else
alpha(h) P(w); P(w) is the discounted c(w) / N, and what the discounts leave goes to one unknown
word. alpha(h) = (1 - mass of known bigrams) / (1 - sum of P(w) over them), so each distribution
sums to one over the vocabulary and the unknown word.

How it runs: documents are cut into blocks of a bounded number of tokens. A block numbers its
distinct words and keeps its tokens as those numbers, in a table in the shared folder. Counts live
in tables partitioned by hash: each block sends its distinct words with their counts to the word
buckets and gets numbers and totals back; then its distinct bigrams to the bigram buckets, from
which totals and the sums behind alpha come back. The block evaluates its documents token by token: the
bigram, else the weight and the unigram, else the unknown word. A bucket is the bigrams of the
histories that hash to it; a history of more than HOT training tokens is dealt out over several buckets by its second word,
and its sums meet again in a table of at most N / HOT rows.

What travels are rows of compressed number arrays, one for each block and bucket: sorted, so that
differences are short. There are as many buckets as the text needs (BUCKET_BYTES); a block sends at most a row for each
of its words or bigrams, so the rows grow with the tokens even where blocks and buckets are many. Nothing of the vocabulary reaches the driver; counts of counts, N and V do.

Words are told apart by XXH64. Defined results: a null text is empty (its end alone); repeated
rows each give a row and each count; without training rows every token has the unknown word's
probability 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import id_remainder, shuffle_partitions, stored

#: Counts up to K get Good-Turing discounts; larger ones lose LARGE of a token.
K = 5
LARGE = 0.1
BLOCK_TOKENS = 1 << 20
#: Text bytes for each bucket, at most: what a bucket's task holds is bounded, whatever the input.
BUCKET_BYTES = 1 << 24
#: A history of more than N / SPLITS training tokens is dealt out over buckets.
SPLITS = 1000
#: The start symbol's number; words have numbers from 1.
START = 0


# ---- number arrays as bytes ----


def pressed(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as bytes: each in the least width, its bytes apart by significance, then compressed."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        split = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        out.append(len(a).to_bytes(5, "little") + bytes([width]) + split.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpressed(data: bytes) -> list[np.ndarray]:
    """The arrays, as int64 (with the bits of uint64)."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 5], "little"), raw[at + 5]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 6).reshape(width, n).T
        out.append(wide.reshape(-1).view("<i8") if n else np.zeros(0, np.int64))
        at += 6 + n * width
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


# ---- blocks ----


def tokenised(docs: DataFrame, buckets: int, block_tokens: int) -> DataFrame:
    """Blocks: block, doc_ids and held_out of its documents, tokens (lengths; word numbers), words (hashes by bucket; training counts).

    The words of a block are sorted by bucket and hash, and numbered so; the last is the end.
    """
    end = xxhash.xxh64_intdigest(b" end")  # no word holds a space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        rows: list[tuple[int | None, bool, np.ndarray]] = []
        held = 0

        def made() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            hashes = np.append(hashes, np.uint64(end))
            unique, inverse = np.unique(hashes, return_inverse=True)
            order = np.lexsort((unique, unique % np.uint64(buckets)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            number = place[inverse]
            tokens = [np.append(number[r[2]], number[-1]) for r in rows]
            train = np.concatenate([t for t, r in zip(tokens, rows, strict=True) if not r[1]] or [np.zeros(0, np.int64)])
            columns = [
                pa.array([block], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())),
                pa.array([pressed(np.array([len(t) for t in tokens]), np.concatenate(tokens))], pa.binary()),
                pa.array([pressed(unique[order], np.bincount(train, minlength=len(order)))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "held_out", "tokens", "words"])

        for b in batches:
            for doc, out, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                add = known.setdefault
                rows.append((doc, out, np.fromiter((add(w, len(known)) for w in found), np.int64, len(found))))
                held += len(found) + 1
                if held >= block_tokens:
                    yield made()
                    block, held = block + 1, 0
                    known.clear()
                    rows.clear()
        if rows:
            yield made()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(10) == 0).alias("held_out"), "text")
    return picked.mapInArrow(run, "block long, doc_ids array<long>, held_out array<boolean>, tokens binary, words binary")


def dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the slice of each bucket begins, and the end."""
    return np.searchsorted(hashes.view(np.uint64) % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))


# ---- words ----


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket: bucket, block, answer (numbers and training counts of the block's words); for each bucket a row without block with its counts of counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hashes, counts = unpressed(words)
                cut = dealt(hashes, buckets).tolist()
                slices = [(k, pressed(steps(hashes[a:z].view(np.uint64)), counts[a:z])) for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in slices], pa.int32()), pa.array([block] * len(slices), pa.int64()), pa.array([s[1] for s in slices], pa.binary())], ["bucket", "block", "words"])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, read = int(key[0]), [unpressed(x) for x in rows["words"]]
        hashes = [np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in read]
        unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([x[1] for x in read]), len(unique)).astype(np.int64)
        cut = np.cumsum([0] + [len(h) for h in hashes])
        out = [(bucket, b, pressed(steps(inverse[a:z]), total[inverse[a:z]])) for b, a, z in zip(rows["block"], cut, cut[1:], strict=False)]
        rare = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]  # n_1 to n_K+1
        out.append((bucket, None, pressed(np.array([total.sum(), np.count_nonzero(total), *rare]))))
        return pd.DataFrame(out, columns=["bucket", "block", "answer"]).astype({"block": "Int64"})

    asked = blocks.select("block", "words").mapInArrow(ask, "bucket int, block long, words binary")
    return asked.groupBy("bucket").applyInPandas(answer, "bucket int, block long, answer binary")


def summed(rows: DataFrame, column: str) -> list[int]:
    """The sums of the small number arrays that each bucket has told."""
    out = np.zeros(K + 3, object)
    for r in rows.where("block IS NULL").select(column).collect():  # a row of K + 3 numbers for each bucket
        out = out + unpressed(bytes(r[0]))[0].astype(object)
    return [int(x) for x in out]


def weights_of(counts: list[int]) -> np.ndarray:
    """What counts 0 to K weigh after discounting, from n_1 to n_K+1.

    Good-Turing on smoothed counts of counts: they follow a power law n_r = A r^-b, fitted to the logarithms of
    those that aren't zero (b = 2 where there are fewer than two, and at least 1.05). A count r weighs
    (r + 1) n_r+1 / n_r of it, corrected so that the discounts fade out at K. These weights rise with r.
    """
    known = [(np.log(r), np.log(n)) for r, n in enumerate(counts, 1) if n]
    x, y = np.array(known).reshape(-1, 2).T
    power = float(((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()))) if len(known) > 1 else -2.0
    fade = min(power, -1.05) + 1
    r = np.arange(1, K + 1)
    over = float(K + 1) ** fade
    return np.concatenate([[0.0], r * ((1 + 1 / r) ** fade - over) / (1 - over)])


def weighed(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c > K, c - LARGE, weights[np.minimum(c, K)])


class Words:
    """The unigram model: N, V, discounted counts and the mass of the unknown word."""

    def __init__(self, told: list[int]) -> None:
        self.tokens, self.distinct, rare = told[0], told[1], told[2:]
        self.weights = weights_of(rare)
        self.unknown = (sum((r - self.weights[r]) * n for r, n in enumerate(rare[:K], 1)) + LARGE * (self.distinct - sum(rare[:K]))) / self.tokens if self.tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words of training counts ``c``; zero: the unknown word."""
        return np.where(c > 0, weighed(c, self.weights) / max(self.tokens, 1), self.unknown)


# ---- bigrams ----


def block_pairs(tokens: bytes, answers: list[tuple[int, bytes]], buckets: int, hot: float):
    """Of a block: document lengths, training counts of its tokens and of those before them, where each token's bigram is among the distinct ones, and these.

    The distinct bigrams, sorted by bucket: bucket, history, second word, its training count, whether the
    history is dealt out. answers: the word buckets' answers. A word's number is made of its bucket and its place there.
    """
    sizes, local = unpressed(tokens)
    numbers, counts = [], []
    for bucket, answer in sorted(answers):
        gaps, total = unpressed(answer)
        numbers.append(1 + bucket + buckets * np.cumsum(gaps))
        counts.append(total)
    word, c = np.concatenate(numbers)[local], np.concatenate(counts)[local]
    first = np.cumsum(sizes) - sizes
    before, c_before = np.roll(word, 1), np.roll(c, 1)
    before[first], c_before[first] = START, c[first + sizes - 1]  # as many starts as ends
    spread = (c_before > hot) | (before == START)
    bucket = mixed(np.where(spread, before + 31 * (1 + word % buckets), before)) % buckets
    order = np.lexsort((word, before, bucket))
    h, w = before[order], word[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return sizes, c, c_before, at, (bucket[order][new], h[new], w[new], c[order][new], spread[order][new])


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of numbers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def bigram_requests(blocks: DataFrame, answers: DataFrame, buckets: int, hot: float) -> DataFrame:
    """(bucket, block, pairs) of all blocks: histories, whether dealt out, run lengths, second words, their training counts, training counts of the bigrams."""

    def ask(key: tuple, mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, tokens, held_out in zip(mine["block"], mine["tokens"], mine["held_out"], strict=True):
            sizes, _, _, at, (b, h, w, c, spread) = block_pairs(tokens, list(zip(told["bucket"], told["answer"], strict=True)), buckets, hot)
            train = np.bincount(at, np.repeat(~np.array(held_out, bool), sizes), len(h)).astype(np.int64)
            cut = np.searchsorted(b, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                a, z = cut[k], cut[k + 1]
                begin = runs(h[a:z])
                gaps = np.diff(w[a:z], prepend=0)
                gaps[begin] = w[a:z][begin]
                out.append((k, block, pressed(steps(h[a:z][begin]), spread[a:z][begin], np.diff(np.append(begin, z - a)), gaps, c[a:z], train[a:z])))
        return pd.DataFrame(out, columns=["bucket", "block", "pairs"])

    joined = blocks.select("block", "held_out", "tokens").groupBy("block").cogroup(answers.groupBy("block"))
    return joined.applyInPandas(ask, "bucket int, block long, pairs binary")


def bigram_counts(requests: DataFrame, words: Words) -> DataFrame:
    """Per block and bucket: answer (training counts of its bigrams) and sums over the known bigrams of histories.

    Sums of a history: bigrams of each count 1 to K, those of larger counts, their tokens, sum of
    P(w). A block gets those of its histories with an unknown bigram. For each bucket a row without block has
    the counts of counts and its part of the sums of histories that are dealt out.
    """

    def opened(data: bytes) -> tuple[np.ndarray, ...]:
        gaps, spread, size, w, c, n = unpressed(data)
        ends, running = np.cumsum(size), np.cumsum(w)
        base = np.concatenate([[0], running[ends[:-1] - 1]])
        return np.repeat(np.cumsum(gaps), size), running - np.repeat(base, size), c, n, np.repeat(spread, size)

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        read = [opened(x) for x in rows["pairs"]]
        cut = np.cumsum([0] + [len(x[0]) for x in read])
        h, w, c, n, spread = (np.concatenate([x[k] for x in read]) for k in range(5))
        del read
        order = np.lexsort((w, h))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        count, first = np.bincount(at, n).astype(np.int64), order[new]
        rare = np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]
        begin = runs(h[first])
        history, dealt_out = h[first][begin], spread[first][begin] > 0
        p = np.where(count > 0, words.p(c[first]), 0.0)
        each = [count == r for r in range(1, K + 1)] + [count > K, np.where(count > K, count, 0), p]
        table = [np.add.reduceat(x, begin, dtype=x.dtype if x.dtype != bool else np.int64) for x in each]
        pick = lambda k: pressed(steps(history[k]), *(x[k] for x in table[:-1]), table[-1][k].view(np.int64))
        out = []
        for b, a, z in zip(rows["block"], cut, cut[1:], strict=False):
            mine = at[a:z]
            asks = np.unique(h[a:z][(count[mine] == 0) & (spread[a:z] == 0)])
            out.append((key[0], b, pressed(count[mine]), pick(np.searchsorted(history, asks))))
        out.append((key[0], None, pressed(np.array([0, 0, *rare])), pick(np.flatnonzero(dealt_out))))
        return pd.DataFrame(out, columns=["bucket", "block", "answer", "sums"]).astype({"block": "Int64"})

    return requests.groupBy("bucket").applyInPandas(answer, "bucket int, block long, answer binary, sums binary")


def hot_sums(counted: DataFrame) -> dict[int, list[float]]:
    """The whole sums of histories that are dealt out: at most SPLITS + 1 of them."""
    names = [f"m{k}" for k in range(K + 2)]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sums in b["sums"]:
                h, *rest = unpressed(sums)
                yield pd.DataFrame({"h": np.cumsum(h)} | dict(zip(names, rest, strict=False)) | {"p": rest[-1].view(np.float64)})

    rows = counted.where("block IS NULL").select("sums").mapInPandas(parts, "h long, " + ", ".join(f"{n} long" for n in names) + ", p double")
    return {r["h"]: [r[n] for n in [*names, "p"]] for r in rows.groupBy("h").agg(*(F.sum(n).alias(n) for n in [*names, "p"])).collect()}


def backoff(sums: np.ndarray, c_before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """alpha(h) from the sums (columns) of histories and their training counts."""
    mass = sum(weights[r] * sums[r - 1] for r in range(1, K + 1)) + sums[K + 1] - LARGE * sums[K]
    return (1 - mass / c_before) / (1 - sums[K + 2])


def scored(blocks: DataFrame, answers: DataFrame, buckets: int, hot: float, words: Words, weights: np.ndarray, hot_ones: dict[int, list[float]]) -> DataFrame:
    """Every document's row; ``answers``: those of the word buckets and, with sums, of the bigram buckets."""
    hot_h = np.array(sorted(hot_ones), np.int64)
    hot_table = np.array([hot_ones[h] for h in hot_h.tolist()], float).reshape(-1, K + 3).T

    def run(key: tuple, mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        of_words, of_pairs = told[told["sums"].isna()], told[told["sums"].notna()].sort_values("bucket")
        out = []
        for tokens, held_out, doc_ids in zip(mine["tokens"], mine["held_out"], mine["doc_ids"], strict=True):
            sizes, c, c_before, at, (_, h, _, cw, spread) = block_pairs(tokens, list(zip(of_words["bucket"], of_words["answer"], strict=True)), buckets, hot)
            count = np.concatenate([unpressed(x)[0] for x in of_pairs["answer"]])
            before = np.zeros(len(h), np.int64)
            before[at] = c_before
            alpha = np.ones(len(h))
            tables = [unpressed(x) for x in of_pairs["sums"]]
            histories = np.concatenate([np.cumsum(t[0]) for t in tables])
            sums = np.concatenate([np.array([*t[1:-1], t[-1].view(np.float64)]).reshape(K + 3, -1) for t in tables], axis=1)
            by = np.argsort(histories, kind="stable")
            for which, names, table in ((~spread, histories[by], sums[:, by]), (spread, hot_h, hot_table)):
                k = np.flatnonzero((count == 0) & (before > 0) & which)
                if len(k):
                    alpha[k] = backoff(table[:, np.searchsorted(names, h[k])], before[k], weights)
            known = weighed(count, weights) / np.maximum(before, 1)
            pair = np.log10(np.where(count > 0, known, alpha * words.p(cw)))
            base = np.log10((c + 0.1) / (words.tokens + 0.1 * (words.distinct + 1)))
            first = np.cumsum(sizes) - sizes
            out.append(pd.DataFrame({
                "doc_id": pd.array(doc_ids, "Int64"), "held_out": held_out, "n_tokens": sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "train_tokens": words.tokens,
                "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(pair[at], first),
            }))
        return pd.concat(out)

    joined = blocks.select("block", "doc_ids", "held_out", "tokens").groupBy("block").cogroup(answers.groupBy("block"))
    return joined.applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    blocks = stored(tokenised(docs, buckets, block_tokens), "katz-blocks")
    told = stored(word_counts(blocks, buckets), "katz-words")
    words = Words(summed(told, "answer"))
    of_words = told.where("block IS NOT NULL").select("bucket", "block", "answer")
    hot = words.tokens / SPLITS
    counted = stored(bigram_counts(bigram_requests(blocks, of_words, buckets, hot), words), "katz-bigrams")
    weights = weights_of(summed(counted, "answer")[2:])
    answers = of_words.withColumn("sums", F.lit(None).cast("binary")).unionByName(counted.where("block IS NOT NULL"))
    return scored(blocks, answers, buckets, hot, words, weights, hot_sums(counted))
