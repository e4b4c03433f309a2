"""Each registered query of the corpus operators runs over the smallest tables: a row for each row of its table."""

import pytest

from provisio.llm import queries

SF = "/root/testdata/sf0.001"
TABLE = {"op10_html_extraction": ("pages", 1), "op12_embedding_whitening": ("embeddings", 16)}


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op") and n[2:].split("_")[0] not in ("1", "2", "11", "12", "13")))
def test_query(spark, name):
    table, each = TABLE.get(name, ("documents", 1))
    rows = queries.QUERIES[name](spark, SF).collect()
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    have = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in rows) == sorted(have * each)
