"""Packed token-id output: best-fit-decreasing with a segment tree over capacities.

Each task packs the documents that it reads, a bounded shard of tokens at a time, so ids never
cross the network and no task holds more than a shard. Documents become ids and an end id; those
longer than a row are split without loss into full rows and a remainder. The pieces of a shard, longest first,
each go to the row with the least room that still fits; a segment tree over remaining capacities
finds it in a logarithm of the row length.

A row holds its ids in little-endian bytes (two an id where the vocabulary allows, else four),
padded with the end id, the cumulative lengths of its segments (from 0) and where positions start
anew. Row ids are made of the partition and a count in it, so a task that runs again makes the
same rows.

Defined results: a null text is empty (its end id alone); repeated rows and equal ids are packed
each for itself; a null id stays null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.tokens import encoder, vocabulary_path

LENGTH = 1024
#: Most tokens that a task packs at once.
SHARD_TOKENS = 1 << 21


class CapacityTree:
    """Rows by remaining capacity; finds the smallest capacity that is at least what is asked for."""

    def __init__(self, largest: int) -> None:
        self.leaves = 1 << largest.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the smallest capacity >= ``least``, with that capacity; the row leaves the tree."""
        counts, node = self.counts, self.leaves + least
        while not counts[node]:  # up to the first subtree on the right that holds a row
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            counts[node] -= 1
            node >>= 1
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Which pieces share a row, in the order they have come to it."""
    tree, rows = CapacityTree(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        found = tree.take(n)
        if found is None:
            rows.append([k])
            row, room = len(rows) - 1, length - n
        else:
            row, room = found[0], found[1] - n
            rows[row].append(k)
        if room:
            tree.add(row, room)
    return rows


def packed_rows(
    docs: DataFrame, length: int = LENGTH, end_id: int = 0, vocabulary: str | None = None, vocabulary_size: int = 50257, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """sequence_id, input_ids, n_tokens, cu_seqlens, position_resets, doc_ids, doc_starts of all rows."""
    path, kind = vocabulary or vocabulary_path(), "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    ints = pa.list_(pa.int32())
    schema = pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.binary()), ("n_tokens", pa.int64()), ("cu_seqlens", ints), ("position_resets", ints), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])

    def rows_of(pieces: list[tuple[int | None, int, np.ndarray]], first: int) -> pa.RecordBatch:
        made = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), length)
        out: list[list] = [[] for _ in schema]
        for k, members in enumerate(made):
            parts = [pieces[m] for m in members]
            ends = np.cumsum([0] + [len(p[2]) for p in parts])
            row = np.full(length, end_id, kind)
            row[: ends[-1]] = np.concatenate([p[2] for p in parts])
            values = (first + k, row.tobytes(), int(ends[-1]), ends.tolist(), ends[:-1].tolist(), [p[0] for p in parts], [p[1] for p in parts])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 33
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids.append(end_id)
                    whole = np.array(ids, kind)
                    for s in range(0, len(whole), length):
                        pieces.append((doc, s, whole[s : s + length]))
                        held += len(pieces[-1][2])
                        if held >= shard_tokens:
                            made = rows_of(pieces, sequence)
                            sequence += made.num_rows
                            yield made
                            pieces, held = [], 0
        if pieces:
            yield rows_of(pieces, sequence)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "sequence_id long, input_ids binary, n_tokens long, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
    )


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes the rows of all documents as Parquet."""
    packed_rows(docs, **options).write.parquet(path)
