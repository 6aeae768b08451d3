"""Vector code compression: product codes from k-means over integers, entries found by exponion search.

A row keeps the entry that it had in each part. The next round starts there: with d the distance to that entry, no entry farther than
2 d from it can be nearer, so only a beginning of its list of other entries, sorted by distance, is looked at.
All is computed with integers, so the result is that of looking at every entry, ties included.

A round reads the rows of the last one, writes them with their new entries, and sums them by part and entry inside
each task; only those sums are shuffled and only codebooks (entries times components) reach the driver. When a round is written the
rows of the one before are deleted. A lost executor repeats the tasks of one round.

Defined cases: rows with a null vector, or a null or infinite component or one that isn't a number, take no part; a null label is a label; of
equal ids the smaller vector comes first, a null id last; fewer rows than entries give fewer entries; no rows give no rows; other columns
aren't read. Vectors of different lengths, or of a length that isn't a multiple of the number of parts, and components over 2**27 after scaling are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import discarded, stored
from emberlake.llm.vectors import integers, lists, matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Most labels whose sums are broadcast.
FEW = 100_000
#: Scaled components stay within this, so that squared distances stay within a long.
LARGEST = 1 << 27
ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())), ("codes", pa.list_(pa.int8())), ("error", pa.int64())])
ROWS_DDL = "vec_id long, label long, v array<int>, codes array<tinyint>, error long"


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: all entries by squared distance from it, itself first, and those distances."""
    apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    keyed = apart.copy()
    np.fill_diagonal(keyed, -1)
    order = np.argsort(keyed, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def exponion(points: np.ndarray, before: np.ndarray, entries: np.ndarray, lists_of: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lowest index of equals, and its squared distance; ``before`` is the entry to start from.

    An entry j with d(x, j) <= d(x, a) has d(a, j) <= 2 d(x, a): squared, a list is read while its distance is at most 4 d(x, a)**2.
    """
    order, apart = lists_of
    best, least = before.astype(np.int64), ((points - entries[before]) ** 2).sum(axis=1)
    for a in np.unique(before):
        own = np.flatnonzero(before == a)
        reach = np.searchsorted(apart[a], 4 * least[own], side="right")
        own, reach = own[far := np.argsort(-reach, kind="stable")], reach[far]
        for k in range(1, len(entries)):
            n = int(np.searchsorted(-reach, -k, side="left"))  # those that read more than k places
            if not n:
                break
            rows, j = own[:n], order[a, k]
            d = ((points[rows] - entries[j]) ** 2).sum(axis=1)
            nearer = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = j, d[nearer]
    return best, least


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with the nearest entry of ``books`` (part, entry, position) in each part, and the squared distances' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [neighbours(b) for b in books]
        for batch in filter(len, batches):
            v, codes = matrix(batch["v"]).astype(np.int64), matrix(batch["codes"])
            pieces = v.reshape(len(v), len(books), -1)
            new, error = np.empty_like(codes), np.zeros(len(v), np.int64)
            for p, book in enumerate(books):
                new[:, p], d = exponion(pieces[:, p], codes[:, p], book, found[p])
                error += d
            yield pa.record_batch([batch["vec_id"], batch["label"], batch["v"], lists(new), pa.array(error)], schema=ROWS)

    return rows.mapInArrow(run, ROWS_DDL)


def sums(rows: DataFrame, parts: int, entries: int) -> DataFrame:
    """(part, entry, position, total, n) of assigned rows: components added up, in each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in filter(len, batches):
            v, codes = matrix(batch["v"]).astype(np.int64), matrix(batch["codes"])
            pieces = v.reshape(len(v), parts, -1)
            if total is None:
                total, count = np.zeros((parts, entries, pieces.shape[2]), np.int64), np.zeros((parts, entries), np.int64)
            for p in range(parts):
                by, piece = np.argsort(codes[:, p], kind="stable"), pieces[:, p]
                kinds, at, n = np.unique(codes[by, p], return_index=True, return_counts=True)
                total[p, kinds] += np.add.reduceat(piece[by], at, axis=0)
                count[p, kinds] += n
        if total is not None:
            part, entry, position = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
            yield pa.record_batch({"part": part, "entry": entry, "position": position, "total": total.ravel(), "n": np.broadcast_to(count[:, :, None], total.shape).ravel()})

    told = rows.mapInArrow(run, "part int, entry int, position int, total long, n long")
    return told.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moved(books: np.ndarray, added: DataFrame) -> np.ndarray:
    """``books`` with each used entry replaced by its rows' mean, rounded down."""
    out = books.copy()
    for r in added.where("n > 0").collect():  # at most one row for each number in the codebooks
        out[r.part, r.entry, r.position] = r.total // r.n
    return out


def compressed(rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, codes, error) of ``rows`` (vec_id, embedding, label), and the codebooks (part, entry, position)."""
    kept = whole(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")))
    own = kept.select("vec_id", "label", integers(F.col("embedding"), scale).alias("v"))
    checked = own.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("m")).first()  # one row
    if checked.a is not None and (checked.a != checked.b or checked.a % parts or not checked.a):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    if checked.m is not None and checked.m > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST} after scaling by {scale}")
    now = stored(own.select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), F.array_repeat(F.lit(0).cast("tinyint"), parts).alias("codes"), F.lit(0).cast("long").alias("error")), "codes")
    first = [r.v for r in now.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]  # the entries to begin with
    if not first:
        return now, np.zeros((parts, 0, 0), np.int64)
    books = np.ascontiguousarray(np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    for k in range(rounds + 1):
        before, now = now, stored(assigned(now, books), "codes")
        discarded(before)
        if k < rounds:
            books = moved(books, sums(now, parts, len(first)))
    return now, books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, in decimal with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of each row of :func:`compressed`."""
    found, books = compressed(rows)
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = stored(by_label.withColumnRenamed("label", "of_label"), "label-errors")
    told = found.join(F.broadcast(by_label) if by_label.count() <= FEW else by_label, F.col("label").eqNullSafe(F.col("of_label")))
    hexed = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")), ""))
    return told.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def codes_sql() -> str:
    """SQL for the rows of :func:`codes` over ``embeddings``, round by round."""
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})"""
    near = "SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (SELECT vec_id, label, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN {0} USING (p)) GROUP BY ALL"
    for k in range(ROUNDS):
        out += f""",
a{k} AS MATERIALIZED ({near.format(f"b{k}")}),
m{k} AS MATERIALIZED (SELECT p, e, list(CAST(floor_div AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS floor_div
  FROM (SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
    return out + f""",
last AS MATERIALIZED ({near.format(f"b{ROUNDS}")}),
told AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM told"""
