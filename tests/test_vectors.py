"""Nearest vectors and similar pairs against all products; the stored ledger against its files."""

import random
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import emberlake.plans.features  # noqa: F401  registers more queries
import emberlake.plans.lifecycle  # noqa: F401  registers more queries
from emberlake.operators import graph, vectors
from emberlake.plans.catalogue import ORACLE_SQL, QUERIES, flagship
from emberlake.sources.ledger import Tables
from tests.conftest import TABLES, oracle_rows, rows_of


def clustered(n, seed, width=24, spread=0.25):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(max(1, n // 8), width))
    return (middles[rng.integers(0, len(middles), n)] + rng.normal(scale=spread, size=(n, width))).astype(np.float32)


def test_search_equals_all_products_whichever_way(spark):
    v = clustered(500, 1)
    v[7] = v[8]  # equals go by id
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24)]
    table = spark.createDataFrame(rows + odd, "id int, vector array<float>").repartition(5)
    asked = table.where("id % 7 = 0 or id >= 900").selectExpr("id as qid", "vector as q")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near, want = np.round(u @ u.T, 6), []
    for q in range(0, 500, 7):
        best = sorted((-near[q, k], k) for k in range(500) if near[q, k] >= 0.3)[:4]
        want += [(q, k, -s, rank) for rank, (s, k) in enumerate(best, 1)]
    for bytes_ in (vectors.SENT_BYTES, 0):
        found = vectors.vector_search(table, asked, 4, 0.3, sent_bytes=bytes_)
        assert sorted(map(tuple, found.select("qid", "id", "similarity", "rank").collect())) == sorted(want)
    assert vectors.vector_search(table.where("false"), asked, 4, 0.3).count() == 0
    assert vectors.vector_search(table, asked.where("false"), 4, 0.3).count() == 0


def test_similar_pairs_without_a_block(spark):
    for threshold, n in ((0.85, 900), (0.6, 400)):
        v = clustered(n, int(threshold * 100))
        rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
        u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
        near = np.round(u @ u.T, 6)
        want = {(a, b): near[a, b] for a, b in zip(*np.nonzero(near >= threshold), strict=True) if a < b}
        table = spark.createDataFrame(rows, "id int, vector array<float>")
        found = [tuple(r) for r in vectors.similar_pairs(table, threshold).collect()]
        assert len(found) == len({(a, b) for a, b, _ in found})  # no pair twice
        assert all(want[a, b] == s for a, b, s in found) and len(found) >= 0.995 * len(want)
        crowded = [tuple(r) for r in vectors.similar_pairs(table, threshold, crowd=5).collect()]
        assert sorted(crowded) == sorted(found)
    assert vectors.similar_pairs(table.where("false"), 0.9).count() == 0


def test_copies_are_one_node(spark):
    rng = random.Random(2)
    one = [rng.gauss(0, 1) for _ in range(8)]
    near = [x + 0.01 for x in one]
    table = spark.createDataFrame([(k, one) for k in range(2000)] + [(5000, near), (5001, None), (5002, [0.0] * 8)], "id long, vector array<double>")
    found = sorted((r.a, r.b) for r in vectors.similar_pairs(table, 0.9).collect())
    assert found == sorted([(0, k) for k in range(1, 2000)] + [(0, 5000)])


def test_the_stored_ledger_follows_its_files(spark, folder, tmp_path):
    here = str(tmp_path)
    shutil.copy(f"{folder}/events.parquet", f"{here}/events.parquet")
    whole = QUERIES["ledger_count"](spark, here).first().events
    assert whole == spark.read.parquet(f"{folder}/events.parquet").count()
    assert QUERIES["ledger_count"](spark, here).first().events == whole
    few = spark.read.parquet(f"{folder}/events.parquet").where(F.col("event_id") < 10)
    few.coalesce(1).write.parquet(f"{here}/few")
    shutil.rmtree(f"{here}/events.parquet", ignore_errors=True)
    (tmp_path / "events.parquet").unlink(missing_ok=True)
    shutil.move(f"{here}/few", f"{here}/events.parquet")
    assert QUERIES["ledger_count"](spark, here).first().events == few.count()
    assert {r.event_id for r in QUERIES["newest_by_position"](spark, here).collect()} == {str(r.event_id) for r in few.collect()}


def test_similar_pairs_are_all_pairs_at_a_low_threshold_and_travel_a_few_times(spark):
    """No pair is left to chance, and a row goes to as many tasks as there are cells."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1200, 16)).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = np.round(u @ u.T, 6)
    want = {(f"n{a:04d}", f"n{b:04d}"): near[a, b] for a, b in zip(*np.nonzero(near >= 0.3), strict=True) if a < b}
    table = spark.createDataFrame([(f"n{k:04d}", [float(x) for x in row]) for k, row in enumerate(v)], "id string, vector array<float>")
    for crowd in (vectors.CROWD, 300):
        found = vectors.similar_pairs(table, 0.3, crowd=crowd)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and {(a, b) for a, b, _ in rows} == set(want)
        assert all(abs(want[a, b] - s) < 2e-6 for a, b, s in rows)


def test_many_queries_are_multiplied_in_tiles():
    """A worker's memory doesn't grow with queries times rows of a step."""
    import tracemalloc

    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(4096, 8)), rng.normal(size=(9000, 8))
    tracemalloc.start()
    best = vectors.Nearest(np.arange(9000), q, 3, 0.5)
    best.add(np.arange(4096), v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all products of a step at once: 147 MB, and as much again for each copy
    near = np.round(vectors.unit(v) @ vectors.unit(q[8990:]).T, 6)
    for k in range(8990, 9000):
        want = sorted((-s, i) for i, s in enumerate(near[:, k - 8990]) if s >= 0.5)[:3]
        got = best.held[best.held["q"] == k]
        assert list(got["id"]) == [i for _, i in want]


def test_every_copy_has_all_of_its_pairs_if_asked(spark, monkeypatch):
    """Equal vectors, in classes larger than a share, and ids that stand in several rows."""
    monkeypatch.setattr(vectors, "GROUP", 7)
    v = clustered(120, 3, width=8)
    v[40:70], v[90:94], v[110] = v[40], v[2], v[110] * 0 + v[111]
    ids = [*range(118), 5, 41]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = np.round(u @ u.T, 6)
    for name, kind in ((int, "int"), (lambda k: f"n{k:03d}", "string")):
        want = sorted((name(ids[x]), name(ids[y])) for x in range(120) for y in range(120) if ids[x] < ids[y] and near[x, y] >= 0.7)
        table = spark.createDataFrame([(name(k), [float(x) for x in row]) for k, row in zip(ids, v, strict=True)] + [(None, [1.0] * 8)], f"id {kind}, vector array<float>")
        for crowd in (vectors.CROWD, 30):
            found = vectors.similar_pairs(table, 0.7, crowd=crowd, copies=True).collect()
            assert sorted((r.a, r.b) for r in found) == want
            assert all(r.similarity == 1.0 for r in found if 40 <= int(str(r.a).strip("n")) < 70 and 42 <= int(str(r.b).strip("n")) < 70)


@pytest.fixture(scope="module")
def with_copies(folder, tmp_path_factory):
    """The smallest tables, where every second embedding is the one before it, and DuckDB over them."""
    here = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        whole = f"SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        if name == "embeddings":
            whole = f"SELECT x.vec_id, y.embedding, x.label FROM ({whole}) x JOIN ({whole}) y ON y.vec_id = x.vec_id - x.vec_id % 2"
        con.sql(f"COPY ({whole}) TO '{here}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{here}/{name}.parquet')")
    return str(here), con


@pytest.mark.parametrize("name", ["entity_cluster_3hop", "event_counts", "forgetting_applied", "same_as_components", "same_as_stars", "seed_similar_cluster", "semantic_resolution", "similar_edge_prune", "similar_to_edges", "similar_vectors", "subgraph_edges", "subgraph_flagship"])
def test_queries_on_copies_equal_their_sql(name, spark, with_copies):
    here, con = with_copies
    assert rows_of(QUERIES[name](spark, here)) == oracle_rows(con, ORACLE_SQL[name])


def test_all_edges_of_a_seed_are_followed(spark, folder, tmp_path):
    """One session whose events name eight entities, of which some are alike, so that seeds have hundreds of edges."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        whole = f"SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        if name == "events":
            whole = f"SELECT * REPLACE (5 AS user_id, '{{\"k\": ' || event_id % 8 || '}}' AS props) FROM ({whole})"
        con.sql(f"COPY ({whole}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    found = rows_of(QUERIES["subgraph_edges"](spark, str(tmp_path)))
    assert found == oracle_rows(con, ORACLE_SQL["subgraph_edges"])
    assert "rn <= 50" not in ORACLE_SQL["subgraph_edges"]
    t = Tables(spark, str(tmp_path))
    assert set(found[1]) != set(rows_of(flagship(t, 50)[1])[1])  # what the first fifty edges of each seed would give
    edges = spark.createDataFrame([("s", f"d{k}", "FOLLOWS") for k in range(70)], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("s",), ("t",)], "id string")
    assert graph.neighbours(edges, seeds).count() == 71 and graph.neighbours(edges, seeds, 50).count() == 51
