"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

import emberlake.plans.features  # noqa: F401  registers more queries
import emberlake.plans.lifecycle  # noqa: F401  registers more queries
import emberlake.plans.streams  # noqa: F401  registers more queries
import emberlake.plans.surface  # noqa: F401  registers more queries
from emberlake.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, duck, folder):
    assert rows_of(QUERIES[name](spark, folder)) == oracle_rows(duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


def test_streamed_follows_equal_batch(spark, folder):
    batch = QUERIES["follows_edges"](spark, folder).select("src", "dst", "delta_ms")
    streamed = QUERIES["stream_follows"](spark, folder).select("src", "dst", "delta_ms")
    assert batch.exceptAll(streamed).isEmpty() and streamed.exceptAll(batch).isEmpty()
