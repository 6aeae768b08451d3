"""Near-duplicates by exact similarity of word shingles.

A text with A-Z lower-cased is the set of XXH64 hashes of its runs of five words (the whole sequence
where there are fewer). Two texts are linked when their sets' Jaccard similarity is 0.8 or more.

Search, first by SimHash: fingerprints over the same shingles within 3 bits are found by their deletion
variants, and such pairs verified; they give most classes. Then, since pairs of similarity 0.8 often
lie further apart, by prefixes: with all hashes in one order, sets of similarity s and sizes n share a hash among the first
n - ceil(s n) + 1 of each. So only these are indexed, and no pair is missed whatever the order is;
hashes that are common in a sample come last, which keeps the lists short. Equal sets are one node.

Links: within a list each node meets the next ``near`` nodes. Lists that are longer and whose nodes
are not yet one component are compared in full, in blocks of nodes; pairs within one component
are left out, as they can't change it. The components are those of all links.

Before whole sets travel, pairs and blocks are narrowed by sketches: the parities of a set's hashes over a power of two
of bits, as many as the set has hashes or more. Two sketches differ in no more bits than the sets differ in hashes, so
what they rule out is certainly not similar, and all the rest is verified.

Defined results: a null text is an empty one, and texts without words are equal; rows without id
take part; rows of one id are told apart by ``row_key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import simhash
from emberlake.llm.common import row_key, shuffle_partitions, stored, without_rows
from emberlake.llm.graph import components

WORDS = 5
#: The similarity as a fraction, so that bounds are whole numbers.
LEAST = (4, 5)
#: What the order of hashes is taken from, and how many of the common ones come last. Neither changes a result.
SAMPLE, COMMON = 20_000, 100_000


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of sizes a and b that share so many hashes are near-duplicates."""
    return LEAST[1] * shared >= LEAST[0] * (a + b - shared)


def sketch(x: np.ndarray) -> bytes:
    """The parities of a set's hashes by their last bits, 512 of them or the next power of two from the set's size on."""
    width = 1 << max(9, (len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def narrower(raw: bytes, width: int) -> np.ndarray:
    """A sketch folded to ``width`` bytes, which is the set's sketch of that width."""
    x = np.frombuffer(raw, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def possible(apart: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of sizes a and b can be near-duplicates if sketches of one width differ in so many bits."""
    return similar((a + b - apart) // 2, a, b)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, node (a hash of the set), the SimHash fingerprint, the set as bytes, its size and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                made = [simhash.shingle_hashes(t or "", WORDS) for t in part.column(2).to_pylist()]
                prints = np.fromiter(map(simhash.folded, made), np.uint64, len(made)).view(np.int64)
                distinct = [np.unique(x) for x in made]
                held = [x.tobytes() for x in distinct]
                size, bits = pa.array([len(x) for x in distinct], pa.int64()), pa.array([sketch(x) for x in distinct], pa.binary())
                node = np.fromiter((xxhash.xxh64_intdigest(x, simhash.SEED) for x in held), np.uint64, len(held)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(node), pa.array(prints), pa.array(held, pa.binary()), size, bits], ["doc_id", "row_key", "node", "fp", "hashes", "n", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key long, node long, fp long, hashes binary, n long, bits binary")


def common(unique: DataFrame, nodes: int) -> np.ndarray:
    """Hashes that stand in five sets of a sample, the most common last; at most COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], ["key"])

    share = SAMPLE / max(1, nodes)
    picked = sets(unique.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("hashes")
    counts = picked.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n >= 5")
    return np.array([r.key for r in counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()][::-1], np.int64)


def indexed(made: DataFrame, last: np.ndarray) -> DataFrame:
    """(key, node, n) for the hashes of each set that can't be left out; those in ``last`` are the last in order."""
    order = np.argsort(last)
    names = last[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, own, sizes = [], [], []
            for node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64)
                n = len(x)
                if not n:
                    continue
                place = np.full(n, -1)
                if len(names):
                    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
                    place = np.where(names[at] == x, order[at], -1)
                first = n + (-LEAST[0] * n) // LEAST[1] + 1
                keys.append(x[np.lexsort((x, place))[:first]])
                own.append(np.full(first, node))
                sizes.append(np.full(first, n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (keys, own, sizes)], ["key", "node", "n"])

    return made.select("node", "hashes").mapInArrow(run, "key long, node long, n long")


def neighbours(index: DataFrame, near: int) -> DataFrame:
    """(a, b) of nodes at most ``near`` places apart in a list; lists that are longer come back as rows (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64)] * 3
        for b in batches:
            old = len(tail[0])
            key, node, n = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(tail))
            tail = [x[-near - 1 :] for x in (key, node, n)]
            pairs = []
            for d in range(1, min(near, len(key) - 1) + 1):
                hit = (key[d:] == key[:-d]) & (node[d:] != node[:-d]) & (np.arange(d, len(key)) >= old)
                hit &= LEAST[1] * np.minimum(n[d:], n[:-d]) >= LEAST[0] * np.maximum(n[d:], n[:-d])
                pairs.append(np.stack([node[:-d][hit], node[d:][hit]], axis=1))
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            d = near + 1
            more = np.unique(key[d:][(key[d:] == key[:-d]) & (np.arange(d, len(key)) >= old)]) if len(key) > d else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*[None] * len(found), *more.tolist()], pa.int64()), *(pa.array([*found[:, k].tolist(), *[None] * len(more)], pa.int64()) for k in (0, 1))], ["key", "a", "b"]
            )

    return index.repartition(shuffle_partitions(index.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (node, n, bits) don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, x, m, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                width = min(len(x), len(y))
                keep.append(bool(possible(int(np.bitwise_count(narrower(x, width) ^ narrower(y, width)).sum()), n, m)))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    side = lambda p: sketches.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near-duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):  # sets of long texts are large
                part, keep = b.slice(k, 256), []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    side = lambda p: nodes.select(F.col("node").alias(p), F.col("hashes").alias(f"{p}_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def shared_counts(found: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of these sets share."""
    _, at = np.unique(np.concatenate(found), return_inverse=True)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(found), len(found)), np.float32)
    step = 4096
    edges = np.searchsorted(at, np.arange(0, at[-1] + 1 + step, step))
    for k in range(len(edges) - 1):
        a, z = edges[k], edges[k + 1]
        held = np.zeros((len(found), step), np.float32)
        held[row[a:z], at[a:z] - k * step] = 1
        out += held @ held.T
    return np.rint(out).astype(np.int64)


def dealt(lists: DataFrame, block: int) -> DataFrame:
    """The nodes (key, node, root, size) of each list in blocks, once for each pair of blocks (low, high) that theirs (at) is part of."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = lists.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("key", "node", "root", "at", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"))


def open_pairs(table: pa.Table) -> np.ndarray:
    """Which rows of two blocks are still to be linked: those of two roots; within a block where the block meets itself."""
    root, at = (table.column(c).to_numpy() for c in ("root", "at"))
    hit = root[:, None] < root[None, :]
    if at.min() != at.max():
        hit &= at[:, None] != at[None, :]
    return hit


def bits_apart(found: list[bytes], width: int) -> np.ndarray:
    """In how many bits each two of these sketches differ, folded to ``width`` bytes."""
    rows = np.stack([narrower(x, width) for x in found])
    ones = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    both = np.zeros((len(found), len(found)), np.float32)
    for k in range(0, width, 512):
        part = np.unpackbits(rows[:, k : k + 512], axis=1).astype(np.float32)
        both += part @ part.T
    return ones[:, None] + ones[None, :] - 2 * np.rint(both).astype(np.int64)


def narrowed(blocks: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of :func:`dealt` that are similar to another row of their pair of blocks, as far as sketches (node, n, bits) can tell."""

    def run(table: pa.Table) -> pa.Table:
        found, n = table.column("bits").to_pylist(), table.column("n").to_numpy()
        width, hit = np.array([len(x) for x in found]), open_pairs(table)
        near = similar(np.minimum(n[:, None], n[None, :]), n[:, None], n[None, :])
        low, may = np.minimum(width[:, None], width[None, :]), np.zeros(hit.shape, bool)
        for w in np.unique(low[hit & near]).tolist():  # of sizes this close one sketch is at most twice as wide
            at = np.flatnonzero((width == w) | (width == 2 * w))
            square = np.ix_(at, at)
            may[square] |= (low[square] == w) & possible(bits_apart([found[k] for k in at], w), n[at][:, None], n[at][None, :])
        hit &= near & may
        return table.select(["key", "node", "root", "at", "low", "high"]).filter(pa.array(hit.any(axis=0) | hit.any(axis=1)))

    return blocks.join(sketches, "node").groupBy("key", "low", "high").applyInArrow(run, "key long, node long, root long, at int, low int, high int")


def compared(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of two roots that meet in a pair of blocks (of :func:`dealt`)."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        n = np.array([len(x) for x in found])
        a, b = np.nonzero(similar(shared_counts(found), n[:, None], n[None, :]) & open_pairs(table))
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return blocks.join(nodes.select("node", "hashes"), "node").groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def few(rows: DataFrame, keys: DataFrame, name: str, bound: int = 1_000_000) -> DataFrame:
    """``rows`` whose column ``name`` stands in ``keys`` (distinct); up to ``bound`` keys (8 MB) are broadcast."""
    return rows.join(F.broadcast(keys) if keys.count() <= bound else keys, name, "left_semi")


def needed(unique: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, hashes) of these nodes, stored; only where whole rows are ``repeated`` can a node come twice."""
    nodes = stored(wanted.distinct(), "shingle-wanted")
    found = few(sets(unique).select("node", "hashes"), nodes, "node")
    return stored(found.dropDuplicates(["node"]) if repeated else found, "shingle-sets")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, fp) whose fingerprints lie within 3 bits, as a spanning set: nodes of one fingerprint with the
    first of them, and the first ones of linked fingerprints."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    same = nodes.join(first, "fp").where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    lead = lambda side: first.select(F.col("fp").alias(f"{side}_fp"), F.col("lead").alias(side))
    found = simhash.links(first.select("fp")).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    return same.unionByName(found.join(lead("a"), "a_fp").join(lead("b"), "b_fp").select("a", "b"))


def near_duplicates(docs: DataFrame, near: int = 8, block: int = 64) -> DataFrame:
    """(doc_id, row_key, root, component_id): the class, and the smallest doc_id reachable over links.

    Sets are made anew from the texts wherever they are needed, since all of them would take more room than the texts.
    """
    made = stored(sets(docs).drop("hashes"), "shingles")
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key")
    nodes = stored(made.groupBy("node", "fp", "n", "bits").agg(F.min("doc_id").alias("first"), F.min(order).alias("kept")), "shingle-nodes")
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("row_key") == F.col("kept.row_key"))
    copies = made.join(nodes.select("node", "fp", "kept"), ["node", "fp"]).where(~kept).select("doc_id", "row_key").distinct()
    unique = without_rows(docs, copies)
    repeated = not made.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty()
    last = common(unique, nodes.count())
    met = stored(neighbours(indexed(sets(unique), last), near), "shingle-pairs")
    pairs = stored(met.where("key IS NULL").select("a", "b").unionByName(fingerprint_pairs(nodes.select("node", "fp"))).distinct(), "shingle-candidates")
    sketches = nodes.select("node", "n", "bits")
    pairs = stored(plausible(pairs, sketches), "shingle-plausible")
    links = stored(verified(pairs, needed(unique, pairs.select(F.explode(F.array("a", "b")).alias("node")), repeated)), "shingle-links")
    roots = components(links)
    crowded = stored(met.where("key IS NOT NULL").select("key").distinct(), "shingle-crowded")
    if not crowded.isEmpty():
        held = stored(few(indexed(sets(unique), last), crowded, "key").select("key", "node").distinct(), "shingle-lists")
        held = held.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        # Lists of the same nodes are compared once, those of one component not at all.
        lists = held.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("root").alias("low"), F.max("root").alias("high"))
        todo = lists.where("low < high").groupBy("size", "mark").agg(F.min("key").alias("key")).select("key", "size")
        blocks = stored(narrowed(dealt(held.join(todo, "key"), block), sketches), "shingle-blocks")
        links = links.unionByName(stored(compared(blocks, needed(unique, blocks.select("node"), repeated)), "shingle-links"))
        roots = components(links)
    member = nodes.groupBy("node").agg(F.min("first").alias("first")).join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    groups = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return made.join(member.join(groups, "root").select("node", "root", "component_id"), "node").select("doc_id", "row_key", "root", "component_id")
