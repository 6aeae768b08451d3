"""Hard-negative mining by dual-tree search.

Candidates are dealt to shards of a bounded size by a hash of their id, anchors to blocks of a bounded size; a shard and a block meet in
one task (the anchors are a stated query set against all rows, in blocks). There both get a tree: nodes are cut midway between two far
rows (at the median where that would leave under an eighth on one side), and hold the smallest and largest value of each component and a ball. From two nodes follows an interval that
holds all their inner products: the sums over components of the least and greatest products of the ends, which are whole numbers,
cut with what the balls allow. A pair of nodes is left out at once, with all its anchors, if its interval can't reach what
any of them still takes: the best score so far of the last place, and for negatives the bands around their positives' scores.
Pairs of leaves are scored exactly, and each task gives its own best rows only, of which the best of all shards are taken.

Positives come first, since negatives depend on their scores. Both runs use one search: each anchor asks for the ``k`` best rows in
some ranges of scores, of its own or of another label.

Defined cases: rows without an id, label or vector, or with a null or infinite component or one that isn't a number, take no part; rows are
told apart by their id, so an anchor is never its own partner, and of rows that share an anchor's id the one of the smallest label and vector
is the anchor; other repeated ids count as often as they stand; equal scores go by the smaller id; an anchor without positives or negatives gives no rows; no rows
give no rows; other columns aren't read. Vectors of different lengths, and scores over 2**52, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import shuffle_partitions, stored
from emberlake.llm.vectors import integers, matrix, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies within these hundredths of the positive's.
BAND = (30, 90)
#: Candidates of a shard and anchors of a block, about; rows of a leaf; most leaves that are scored before bounds are looked at again.
SHARD, BLOCK, LEAF, AT_ONCE = 16_384, 2_048, 64, 32
#: Fewer candidates than this aren't cut further to keep all tasks at work.
FEWEST = 512
#: Below every score, above every id.
NONE, LAST = -(1 << 62), np.iinfo(np.int64).max


class Tree:
    """Rows of ``v`` in leaves of up to ``LEAF``; nodes level by level, so that a node's children are known by its number."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, self.rows, self.children = v, [np.arange(len(v))], [()]
        at = 0
        while at < len(self.rows):
            own = self.rows[at]
            if len(own) > LEAF:
                farthest = lambda x, own=own: v[own[((v[own] - x) ** 2).sum(axis=1).argmax()]]
                one = farthest(v[own[0]])
                two = farthest(one)
                along = v[own] @ (two - one)
                by, cut = own[np.argsort(along, kind="stable")], int((2 * along <= (one + two) @ (two - one)).sum())
                cut = cut if min(cut, len(by) - cut) * 8 >= len(by) else len(by) // 2
                self.children[at] = (len(self.rows), len(self.rows) + 1)
                self.rows += [by[:cut], by[cut:]]
                self.children += [(), ()]
            at += 1
        self.low = np.stack([v[r].min(axis=0) for r in self.rows])
        self.high = np.stack([v[r].max(axis=0) for r in self.rows])
        self.middle = np.stack([v[r].mean(axis=0) for r in self.rows])
        self.radius = np.array([np.sqrt(((v[r] - m) ** 2).sum(axis=1).max()) for r, m in zip(self.rows, self.middle, strict=True)])
        self.length = np.sqrt((self.middle**2).sum(axis=1))


def intervals(one: Tree, a: int, other: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that rows of node ``a`` can have with rows of each of ``nodes``."""
    ends = [x * y for x in (one.low[a], one.high[a]) for y in (other.low[nodes], other.high[nodes])]
    low, high = np.minimum.reduce(ends).sum(axis=1), np.maximum.reduce(ends).sum(axis=1)
    centre = other.middle[nodes] @ one.middle[a]
    about = one.radius[a] * other.length[nodes] + other.radius[nodes] * one.length[a] + one.radius[a] * other.radius[nodes]
    slack = 1 + 1e-9 * (np.abs(centre) + about)  # for what floating point rounds
    return np.maximum(low, np.floor(centre - about - slack)), np.minimum(high, np.ceil(centre + about + slack))


class Search:
    """The best ``k`` candidates of each anchor within each of its ranges of scores, over one shard."""

    def __init__(self, anchors: Tree, ids: np.ndarray, labels: np.ndarray, ranges: np.ndarray, candidates: Tree, their_ids: np.ndarray, their_labels: np.ndarray, same: bool, k: int) -> None:
        self.a, self.ids, self.labels, self.ranges = anchors, ids, labels, ranges  # ranges: (anchor, range, from and to), empty if from is over to
        self.c, self.their_ids, self.their_labels, self.same, self.k = candidates, their_ids, their_labels, same, k
        n = (len(ids), ranges.shape[1], k)
        self.score, self.found = np.full(n, NONE, np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
        self.pairs = 0

    def reach(self, rows: np.ndarray) -> tuple[float, float]:
        """The least and the greatest score that some anchors still take: within a range, and no worse than its last place."""
        open_ = np.maximum(self.ranges[rows, :, 0], self.score[rows, :, -1])
        wanted = open_ <= self.ranges[rows, :, 1]
        return (open_[wanted].min(), self.ranges[rows, :, 1][wanted].max()) if wanted.any() else (np.inf, -np.inf)

    def scored(self, rows: np.ndarray, theirs: np.ndarray) -> None:
        """Exact scores of some anchors with some candidates; the best are kept."""
        self.pairs += len(rows) * len(theirs)
        theirs = theirs[np.argsort(self.their_ids[theirs], kind="stable")]
        products = (self.a.v[rows] @ self.c.v[theirs].T).astype(np.int64)
        may = ((self.their_labels[theirs][None, :] == self.labels[rows][:, None]) == self.same) & (self.their_ids[theirs][None, :] != self.ids[rows][:, None])
        for b in range(self.ranges.shape[1]):
            low, high = np.maximum(self.ranges[rows, b, 0], self.score[rows, b, -1]), self.ranges[rows, b, 1]
            inside = may & (products >= low[:, None]) & (products <= high[:, None])
            some = np.flatnonzero(inside.any(axis=1))
            if not len(some):
                continue
            value = np.where(inside[some], products[some], NONE)
            both = np.concatenate([self.score[rows[some], b], value], axis=1)
            names = np.concatenate([self.found[rows[some], b], np.where(inside[some], self.their_ids[theirs][None, :], LAST)], axis=1)
            if both.shape[1] > 4 * self.k:  # what is below the last of the best isn't sorted; equals are
                last = -np.partition(-both, self.k - 1, axis=1)[:, self.k - 1]
                keep = np.where(both >= last[:, None], both, NONE)
                width = max(self.k, int((keep > NONE).sum(axis=1).max()))
                at = np.argsort(-keep, axis=1, kind="stable")[:, :width]
                both, names = np.take_along_axis(keep, at, axis=1), np.take_along_axis(names, at, axis=1)
            order = np.lexsort((names, -both), axis=1)[:, : self.k]
            self.score[rows[some], b], self.found[rows[some], b] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)

    def leaves(self, a: int, nodes: np.ndarray) -> None:
        """An anchor leaf against candidate nodes: down to the leaves that can matter, best first."""
        rows, todo, ready = self.a.rows[a], nodes, []
        while len(todo):
            low, high = intervals(self.a, a, self.c, todo)
            least, most = self.reach(rows)
            todo, high = todo[(high >= least) & (low <= most)], high[(high >= least) & (low <= most)]
            ends = np.array([not self.c.children[x] for x in todo], bool)
            ready += list(zip(high[ends].tolist(), todo[ends].tolist(), strict=True))
            todo = np.array([y for x in todo[~ends] for y in self.c.children[x]], np.int64)
        ready.sort(reverse=True)
        at, step = 0, 1
        while at < len(ready):
            some = [x for high, x in ready[at : at + step] if high >= self.reach(rows)[0]]
            if not some:
                return
            self.scored(rows, np.concatenate([self.c.rows[x] for x in some]))
            at, step = at + step, min(2 * step, AT_ONCE)

    def visit(self, a: int, nodes: np.ndarray) -> None:
        """An anchor node against candidate nodes; those out of reach go for all its anchors at once."""
        low, high = intervals(self.a, a, self.c, nodes)
        least, most = self.reach(self.a.rows[a])
        nodes = nodes[(high >= least) & (low <= most)]
        if not len(nodes):
            return
        if not self.a.children[a]:
            return self.leaves(a, nodes)
        below = np.array([y for x in nodes for y in (self.c.children[x] or (x,))], np.int64)
        for child in self.a.children[a]:
            self.visit(child, below)

    def run(self) -> None:
        """First each anchor leaf with the candidate leaf whose middle is nearest, which gives all nodes bounds; then both trees from the top."""
        ends = np.array([x for x, below in enumerate(self.c.children) if not below])
        for a, below in enumerate(self.a.children):
            if not below:
                self.scored(self.a.rows[a], self.c.rows[ends[int((self.c.middle[ends] @ self.a.middle[a]).argmax())]])
        # Those bounds stay as the ranges' lower ends, and places are filled anew, so that no pair counts twice.
        self.ranges = np.stack([np.maximum(self.ranges[:, :, 0], self.score[:, :, -1]), self.ranges[:, :, 1]], axis=2)
        self.score[:], self.found[:] = NONE, np.iinfo(np.int64).max
        self.visit(0, np.array([0]))


def searched(candidates: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, range, id, score, rank): the ``k`` best of ``candidates`` (vec_id, label, v) in each range of ``anchors`` (anchor_id, label, v, ranges).

    ranges: an array of arrays of two scores, from and to. same: partners of the anchor's label, else of another.
    """
    n, blocks = candidates.count(), max(1, -(-anchors.count() // BLOCK))
    shards = max(1, -(-n // SHARD), min(shuffle_partitions(candidates.sparkSession), n // FEWEST))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    rows = candidates.select("vec_id", "label", "v", dealt("vec_id", shards).alias("shard"), numbers(blocks).alias("block"))
    asked = anchors.select("anchor_id", "label", "v", "ranges", dealt("anchor_id", blocks).alias("block"), numbers(shards).alias("shard"))

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list = [[], [], [], []]
        if len(ours) and len(theirs):
            a, c = (matrix(x["v"]).astype(np.float64) for x in (ours, theirs))
            if a.shape[1] != c.shape[1]:
                raise ValueError("the vectors have different lengths")
            if np.abs(a).max() * np.abs(c).max() * a.shape[1] > 2**52:
                raise ValueError("scores exceed 2**52")  # up to there doubles are exact
            ids, ranges = ours["anchor_id"].to_numpy(), ours["ranges"].combine_chunks()
            wide = np.diff(ranges.offsets.to_numpy())
            bounds = np.tile(np.array([1, 0], np.int64), (len(ids), int(wide.max()), 1))
            values = ranges.flatten().flatten().to_numpy().reshape(-1, 2)
            which = np.repeat(np.arange(len(ids)), wide), np.concatenate([np.arange(n) for n in wide])
            bounds[which] = values
            search = Search(Tree(a), ids, ours["label"].to_numpy(), bounds, Tree(c), theirs["vec_id"].to_numpy(), theirs["label"].to_numpy(), same, k)
            search.run()
            row, band, place = np.nonzero(search.score > NONE)
            out = [ids[row], band, search.found[row, band, place], search.score[row, band, place]]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("anchor_id", "range", "id", "score"), out, strict=True)})

    met = asked.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInArrow(run, "anchor_id long, range long, id long, score long")
    order = Window.partitionBy("anchor_id", "range").orderBy(F.col("score").desc(), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of ``rows`` (vec_id, label, v: integers)."""
    first = F.min(F.struct("label", "v")).alias("one")
    anchors = rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(first).select("anchor_id", "one.*")
    anchors = stored(anchors, "anchors")
    every = F.array(F.array(F.lit(NONE + 1).cast("long"), F.lit(-NONE).cast("long")))
    near = searched(rows, anchors.withColumn("ranges", every), True, positives)
    near = stored(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
    down = lambda x: f"({x} - pmod({x}, 100)) div 100"  # noqa: E731  rounds down, without floating point
    ends = F.array(-F.expr(down(f"(-{band[0]} * positive_score)")), F.expr(down(f"({band[1]} * positive_score)")))
    ranges = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", ends.alias("ends")))), lambda x: x["ends"]).alias("ranges"))
    far = searched(rows, anchors.join(ranges, "anchor_id"), False, negatives)
    told = far.withColumn("place", F.col("range") + 1).join(near, ["anchor_id", "place"])
    return told.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, anchor_every: int = 100) -> DataFrame:
    """:func:`mined` over ``rows`` (vec_id, embedding, label), with every id divisible by ``anchor_every`` as an anchor; labels of ids divisible by 7 move on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = whole(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL")
    ready = stored(known.select("vec_id", moved.alias("label"), integers(F.col("embedding"), SCALE).alias("v")), "mined-rows")
    return mined(ready, F.col("vec_id") % anchor_every == 0)


MINED_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM kept a JOIN kept c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
near AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND {BAND[0]} * positive_score <= 100 * score AND 100 * score <= {BAND[1]} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
