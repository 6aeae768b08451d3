"""Sequence packing by non-negative least squares over a length histogram.

Documents become token ids and an end id. What exceeds the window is cut into full windows and
a remainder; only the remainders need packing, and their histogram has at most ``window - 1``
bars, whatever the corpus holds. All combinations of up to three lengths that fill the window
are columns of a non-negative least squares problem whose solution says how often each is used.
Rounded down, these counts take what the histogram really has; a best-fit pass packs the rest.

The plan is a table of slots per length, of a size bounded by the window alone. Pieces find
their slots by their rank among the pieces of their length; ranks are counted per (length,
salt), so no single length is ever sorted in one task.

Defined results: a null text is empty (one piece, the end id alone); repeated rows are packed
each for itself; rows of one id and start are ordered by content; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import shuffle_partitions, stored
from emberlake.llm.tokens import encoder, vocabulary_path

WINDOW = 1024


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    path = vocabulary or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                docs, starts, sizes, sums, totals, held = [], [], [], [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids.append(end_id)
                    cut = np.array(ids, "<u4")
                    for s in range(0, len(cut), window):
                        piece = cut[s : s + window]
                        docs.append(doc)
                        starts.append(s)
                        sizes.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(cut))
                        if with_ids:
                            held.append(piece.astype(np.int32))
                columns = [pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums, totals)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def combinations(window: int) -> np.ndarray:
    """All multisets of up to three lengths that sum to ``window``, ascending, zero for none."""
    i, j = np.meshgrid(np.arange(window // 3 + 1), np.arange(window), indexing="ij")
    k = window - i - j
    fits = (i <= j) & (j <= k) & (k < window)
    return np.stack([i[fits], j[fits], k[fits]], axis=1)


def solved(histogram: np.ndarray, combos: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A counting the lengths of each combination.

    Accelerated projected gradient; A is three indices a column, so a product is a few bincounts.
    """
    n = len(histogram)
    used = [(combos[:, c], combos[:, c] > 0) for c in range(3)]

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at[on], x[on], n) for at, on in used)

    def back(r: np.ndarray) -> np.ndarray:
        return sum(np.where(on, r[at], 0.0) for at, on in used)

    v = np.random.default_rng(0).random(len(combos))
    for _ in range(30):  # the largest eigenvalue of A'A bounds the step
        v = back(made(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (norm * 1.05)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(made(y) - histogram))
        if (y - new) @ (new - x) > 0:  # momentum points uphill: start it anew
            t = 1.0
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Slots as rows (length, rank, count, sequence, offset).

    ``histogram[l]`` pieces of length l < window get the ranks 0, 1, ... Row (l, r, c, s, o):
    the pieces of ranks r to r + c - 1 go to sequences s, s + 1, ... at offset o.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(len(left), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in lengths:
            rows.append((n, int(taken[n]), times, sequence, offset))
            taken[n] += times
            left[n] -= times
            offset += n
        sequence += times

    if left.sum():
        combos = combinations(window)
        possible = combos[((combos == 0) | (left[combos] > 0)).all(axis=1)]
        if len(possible):
            x = solved(left.astype(float), possible)
            for at in np.argsort(-x, kind="stable"):
                lengths = [int(n) for n in possible[at] if n]
                most = min(int(left[n]) // lengths.count(n) for n in lengths)
                if times := min(int(x[at] + 1e-6), most):
                    use(lengths, times)
    # Best fit over what is left: the longest piece opens a sequence, the longest that fits goes on.
    while left.any():
        lengths, room, spare = [], window, left.copy()
        while room:
            fitting = np.flatnonzero(spare[: room + 1])
            if not len(fitting):
                break
            n = int(fitting[-1])
            lengths.append(n)
            spare[n] -= 1
            room -= n
        use(lengths, min(int(left[n]) // lengths.count(n) for n in set(lengths)))
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """``cut`` with rank, from 0 without gaps among the pieces of one length."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = salted.withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row")).drop("salt", "row", "before")


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most one row for each length
        counts[length] = n
    full, counts[window] = int(counts[window]), 0
    slots = plan(counts, window)
    slots[:, 3] += full  # full windows are the first sequences
    slots = np.concatenate([np.array([[window, 0, max(full, 1), 0, 0]], np.int64), slots])
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slots sorted by (length, rank): a shift by length makes both one ascending key.
        span = int((slots[:, 1] + slots[:, 2]).max()) + 1
        key = slots[:, 0] * span + slots[:, 1]
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            length, rank = b.column(at["length"]).to_numpy(), b.column(at["rank"]).to_numpy()
            row = np.searchsorted(key, length * span + rank, side="right") - 1
            sequence = slots[row, 3] + rank - slots[row, 1]
            kept = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(at[n]) for n in kept] + [pa.array(sequence), pa.array(slots[row, 4])], [*kept, "sequence_id", "offset"])

    if len(slots) > window**2:
        raise ValueError("a plan has fewer slots than the window squared")
    numbered = ranked(cut, max(8, shuffle_partitions(cut.sparkSession)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")
    return numbered.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of all documents, with its place: sequence_id, offset.

    Tokenises once: the pieces (with ids only if asked for) are written to the shared folder.
    """
    return packed(stored(pieces(docs, window, end_id, vocabulary, with_ids), "pieces"), window)
