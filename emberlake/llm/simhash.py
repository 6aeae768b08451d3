"""SimHash near-dedup with deletion-variant signatures.

Fingerprint: texts with A-Z lower-cased are split into words at ASCII white space; each run of
three words (the whole sequence where there are fewer) is hashed with XXH64, seed 42, and a bit
of the fingerprint is 1 if it is set in over half of the hashes. A text without words has
fingerprint zero.

Search: two fingerprints within 3 bits, cut into two halves, differ by at most one bit in one
half. So every half is indexed under each of its one-wildcard variants, and fingerprints that
share a variant are verified over all 64 bits. A variant that more than ``limit`` fingerprints
share isn't compared pair by pair: what differs lies within the other half, which is cut and
indexed in the same way, down to regions of 8 bits. There only 11 bits are free, so at most 2048
fingerprints share a variant. This is exact at every size.

Defined results: a null text is an empty one; equal fingerprints are one node, so copies never
meet as pairs; repeated rows each give a row; a row without id takes part and gets its group's
smallest known id (null if there is none); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import row_key, stored, without_rows
from emberlake.llm.graph import components

SEED = 42
WORDS = 3


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of all shingles of a text, repeats included; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(gaps) - words + 1] + 1]).tolist()
    ends = np.append(gaps[words - 1 :], len(joined)).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint that these hashes give."""
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, rows: bool = False) -> DataFrame:
    """doc_id, row_key if asked for, and the fingerprint's bits as a signed long."""
    names = ["doc_id"] + ["row_key"] * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t or "", words) for t in b.column(len(names)).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(made.view(np.int64))], [*names, "fp"])

    keys = [F.col("doc_id").cast("long").alias("doc_id")] + [row_key(docs).alias("row_key")] * rows
    return docs.select(*keys, "text").mapInArrow(run, "doc_id long, row_key long, fp long" if rows else "doc_id long, fp long")


def variants(rows: DataFrame, width: int) -> DataFrame:
    """(key, fp) under all one-wildcard variants of both halves of the region that is still free.

    The lowest three bits of a key hold where that region starts, in units of 8 bits. Keys are
    hashes: a clash adds candidates, which the verification rejects.
    """
    half = width // 2
    upper = (F.col("p") >= half).cast("int")
    opened = rows.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("p")).select("key", "fp", "p", upper.alias("upper"))
    low = F.col("key").bitwiseAND(7).cast("int") * 8
    cut = "(shiftrightunsigned(fp, cast(key & 7 as int) * 8 + upper * {h}) & {m}L)".format(h=half, m=(1 << half) - 1)
    masked = F.expr(f"{cut} & ~shiftleft(1L, p - upper * {half})")
    other = low + (1 - F.col("upper")) * half
    key = F.xxhash64("key", "p", masked).bitwiseAND(F.lit(~7)).bitwiseOR((other / 8).cast("long"))
    return opened.select(key.alias("key"), "fp")


def linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning star for each group of distinct fingerprints that links of at most ``bits`` bits connect."""
    left, out = fps, []
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= bits
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                todo += [np.uint64(x) for x in found]
                out += [(int(root), x) for x in found]
    return out


def compared(indexed: DataFrame, partitions: int, bits: int, limit: int) -> DataFrame:
    """Links (a, b) within the rows of each key; keys with more than ``limit`` rows come back as rows (key, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), None

        def batch(a: np.ndarray, b: np.ndarray, k: np.ndarray | None) -> pa.RecordBatch:
            gone = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([gone if k is None else pa.array(k), pa.array(a), pa.array(b) if k is None else gone], ["key", "a", "b"])

        for b in batches:
            key, fp = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([fp, b.column(1).to_numpy()])
            if over is not None:  # the rest of a key that has been passed on already
                n = int(np.searchsorted(key, over, side="right"))
                yield batch(fp[:n], fp[:n], key[:n])
                key, fp = key[n:], fp[n:]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            over = None
            if len(starts) > 1 and starts[-1] - starts[-2] > limit:
                over = key[-1]
            yield from runs(key, fp, starts if over is not None else starts[:-1], batch)
            keep = len(key) if over is not None else (starts[-2] if len(starts) > 1 else 0)
            key, fp = key[keep:], fp[keep:]
        if len(key):
            yield from runs(key, fp, np.array([0, len(key)]), batch)

    def runs(key, fp, starts, batch):
        sizes = np.diff(starts)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(sizes > 1):
            a, z = starts[i], starts[i + 1]
            if z - a > limit:
                yield batch(fp[a:z], fp[a:z], key[a:z])
            else:
                found += linked(fp[a:z].view(np.uint64), bits)
        if found:
            pairs = np.unique(np.array(found, np.uint64), axis=0).view(np.int64)
            yield batch(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), None)

    return indexed.repartition(partitions, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, a long, b long")


def links(distinct: DataFrame, bits: int = 3, limit: int = 4096) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints (column fp, distinct) lie within ``bits`` bits of each other."""
    if bits > 3 or limit < 2048:
        raise ValueError("two halves with one wildcard find at most 3 bits; the smallest regions need a limit of 2048")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found, width = distinct.select(F.lit(0).cast("long").alias("key"), "fp"), [], 64
    while True:
        made = stored(compared(variants(rows, width), parts, bits, limit), "simhash-links")
        found.append(made.where("b IS NOT NULL").select("a", "b"))
        crowded = made.where("b IS NULL").select("key", F.col("a").alias("fp"))
        width //= 2
        if crowded.isEmpty():
            break
        rows = crowded
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, words: int = WORDS, limit: int = 4096, rows: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links); with ``rows`` also row_key and root, the class."""
    marked = stored(fingerprints(docs, words, rows), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), bits, limit))
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = member.join(groups, "root").select("fp", "component_id", "root")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["row_key", "root"] * rows)


def one_of_each(docs: DataFrame, bits: int = 3, found: DataFrame | None = None) -> DataFrame:
    """One row of each near-duplicate class; ``found`` (doc_id, row_key, root) replaces the classes by fingerprints.

    The row of smallest doc_id stays (rows without id come last), of several rows with that id the one with
    the smallest ``row_key``, of rows equal in id and text any one.
    """
    found = near_duplicates(docs, bits, rows=True) if found is None else found
    counted = stored(found.groupBy("doc_id", "row_key", "root").agg(F.count("*").alias("n")), "simhash-rows")
    best = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key")).alias("best"))
    marked = counted.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key")))
    left = without_rows(docs, marked.where("NOT stays").select("doc_id", "row_key"))
    again = stored(marked.where("stays AND n > 1").select("doc_id", "row_key"), "repeated")
    if again.isEmpty():
        return left
    same = (row_key(left) == again["row_key"]) & left["doc_id"].cast("long").eqNullSafe(again["doc_id"])
    return without_rows(left, again).unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
