"""The mix against plain versions of sharing, highest quotients and block selection."""

import heapq
import random

from pyspark.sql import functions as F

from emberlake.llm import mixture


def shared(sizes, weights, most):
    """Excess over ``most`` times a size goes to the others by weight, again and again."""
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        open_ = [s for s in sizes if s not in full]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else share[s] for s in sizes}
        full |= over


def seats_of(votes, most, seats):
    """One seat after the other to the highest quotient."""
    got, heap = dict.fromkeys(votes, 0), [(-v, k) for k, v in votes.items() if v and most[k]]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


def test_targets_share_the_excess(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 9):
        sizes = {f"s{k}": rng.choice([0, 1, 7, 100, 5000, 10**12]) for k in range(n)}
        sizes[None] = 3
        found = {r.source: r for r in mixture.targets(spark.createDataFrame([(s, z, 1) for s, z in sizes.items()], "source string, source_size long, docs long")).collect()}
        order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
        want = shared(sizes, {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(order)}, mixture.MOST)
        assert [found[s].no for s in order] == list(range(1, n + 2))
        assert all(abs(found[s].target - want[s]) <= 1e-9 * max(1, want[s]) for s in order)


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(2)
    for n, seats in ((1, 5), (7, 3), (7, 0), (30, 500), (40, 41), (12, 10_000)):
        votes = {k: rng.choice([0, 1, 3, 10, 999, 100_000]) for k in range(n)}
        most = {k: rng.choice([1, 5, 20_000]) for k in range(n)} if n > 20 else dict.fromkeys(range(n), 20_000)
        seats = min(seats, sum(m for k, m in most.items() if votes[k]))
        most = {k: max(m, -(-votes[k] * seats // max(1, sum(votes.values())))) for k, m in most.items()}  # as in a mix, a fair share fits
        rows = spark.createDataFrame([("g", k, votes[k], most[k], seats) for k in votes] + [("h", 1, 5, 9, 4)], "g string, k long, votes long, most long, seats long")
        found = {(r.g, r.k): r.quota for r in mixture.apportioned(rows, ["g"], "k").collect()}
        assert found.pop(("h", 1)) == 4
        assert {k: q for (_, k), q in found.items()} == seats_of(votes, most, seats)


def test_places_blocks_and_spans(spark, docs, empty):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]) if k % 3 else "a", " ".join("w" * rng.choice([1, 1, 40])) if k % 11 else None) for k in range(3000)]
    mixed = mixture.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    out, source = mixed.collect(), {k: s for k, s, _ in rows}
    assert len(out) == len(rows) and all(r.size == len((rows[r.doc_id][2] or "").split()) for r in out)
    shards, totals = {}, {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
        totals.setdefault(source[r.doc_id], []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in shards.values():
        end, times = 0, []
        n, quota, turn = own[0].blocks, own[0].quota, own[0].turn
        once = [(k + 1) * (quota % n) + turn for k in range(n)] if n else []
        times = [quota // n + x // n - (x - quota % n) // n for x in once]
        assert sum(times) == quota <= 3 * n
        for r in sorted(own, key=lambda r: (r.start, r.size)):
            assert r.start == end
            end += r.size
            assert r.taken == sum(times[w // mixture.BLOCK] for w in range(r.start, r.start + r.size))
    for own in totals.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 2 * mixture.BLOCK
    spans = mixture.spans(mixed).groupBy("doc_id").agg(F.sum(F.col("words") * F.col("times")).alias("n")).collect()
    assert {r.doc_id: r.n for r in spans} == {r.doc_id: r.taken for r in out if r.taken}
    assert sorted(map(tuple, mixture.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    assert mixture.mixture(docs).count() == docs.count() and mixture.mixture(empty).count() == 0


def test_a_full_source_is_taken_whole(spark):
    rows = [(k, "a", "x y z") for k in range(5)] + [(k, "b", "q " * 500) for k in range(5, 20)]
    out = mixture.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.taken for r in out if r.size == 3} == {9} and {r.target for r in out if r.size == 3} == {45.0}
