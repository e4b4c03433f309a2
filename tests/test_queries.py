"""Every registered query of the engine against its DuckDB form, over whole tables."""

import functools

import pytest
from compare import oracle_rows, spark_rows

from provisio import queries, queries_graph
from provisio.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def made_once():
    """Chunks and typed tables are made once for all queries that read them."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("_chunks", "order_provisions"):
            kept = functools.cache(getattr(queries_graph, name))
            for module in (queries, queries_graph):
                m.setattr(module, name, kept, raising=False)
        yield


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == oracle_rows(ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
