"""What plans shuffle and write: a document's lines never leave its row, and an order's lines meet once."""

import os
import re

import pytest

from provisio import queries, queries_graph
from provisio.operators import changes, graph, reads, segment, semantics
from provisio.plans.corpus import statutory_corpus
from provisio.plans.provisions import order_provisions

SF = "/root/testdata/sf0.001"
CHUNKED = ("seg_chunk_counts", "seg_paragraphs", "seg_article_rollup_hash", "seg_cross_refs", "seg_qualifications", "seg_hierarchy", "seg_chunks_json", "sem_annex_refs", "sem_definitions", "sem_domain", "sem_terms_longest_first", "graph_cites")


def stored(spark):
    """Names of the tables that were written so far."""
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/provisio-tables"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def exchanges(df) -> int:
    """Exchanges of rows in the plan, those of one kind of rows that two branches share counted once."""
    return len(re.findall(r"^.*\bExchange (?:hash|range|single|round)", df._jdf.queryExecution().executedPlan().toString(), re.M | re.I))


def test_segmentation_shuffles_and_writes_nothing(spark):
    docs = spark.createDataFrame([(1, "A", "Article 1\nScope\n1. One.\n2. Two.\nArticle 2\nMore\nArticle 2\nAgain\n1. Three.")], "doc_id long, short_name string, text string")
    before = stored(spark)
    out = segment.chunks(docs)
    assert exchanges(out) == 0
    rows = {(r.ord, r.id): r.children_ids for r in out.collect()}
    # articles of one number share their paragraphs
    assert rows[4, "A:art:2"] == rows[5, "A:art:2"] == ["A:art:2:para:1"] and len(rows) == 6
    assert stored(spark) == before


@pytest.mark.parametrize("name", CHUNKED)
def test_chunk_queries_store_nothing(spark, name):
    before = stored(spark)
    out = queries.QUERIES[name](spark, SF)
    assert stored(spark) == before
    # orders, line items by part and by order, parts; the last two only where parts are too many to be broadcast
    assert exchanges(out) <= 4 + (name == "graph_cites")


def test_corpus_shuffles_lines_once(spark):
    assert exchanges(statutory_corpus(spark, SF)) <= 4


def test_obligations_meet_discovered_roles_alone(spark):
    text = "Article 1\nDuties\nThe Site Inspector shall keep all records.\nGoods must be kept by the site inspector and the importer."
    docs = spark.createDataFrame([(1, "A", text)], "doc_id long, short_name string, text string")
    c = segment.chunks(docs)
    assert [r.role for r in semantics.obligations(c).orderBy("pos").collect()] == [r.role for r in semantics.obligations(c, semantics.roles(c)).orderBy("pos").collect()]
    plan = semantics.obligations(c)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"^\W*Union", plan, re.M)


def test_ontology_reads_chunks_once(spark):
    docs = spark.createDataFrame([(1, "A", "Article 1\nScope\nMedical goods.")], "doc_id long, short_name string, text string")
    out = semantics.ontology(segment.chunks(docs))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().domain == "Medical & Healthcare Regulation"


def test_citations_within_documents(spark):
    docs = spark.createDataFrame([(1, "A", "Article 1\nScope\nSee Article 2 and 2, and Article 9.\nArticle 2\nMore\nSee Article 1 of it."), (2, "B", "Article 1\nScope\nSee Article 2.")], "doc_id long, short_name string, text string")
    assert {tuple(r) for r in graph.citations(segment.chunks(docs)).collect()} == {("A:art:1", "A:art:2"), ("A:art:2", "A:art:1")}


def test_diff_looks_vectors_up_for_modified_articles_alone(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "vec_id long, embedding array<float>")
    side = lambda *rows: spark.createDataFrame(rows, "number string, text string, embedding long")
    old, new = side(("1", "a", 0), ("2", "b", 0), ("3", "c", 1)), side(("1", "a", 1), ("2", "x", 1), ("3", "y", None))
    by_id = changes.article_diff(old, new, vectors)
    assert {r.number: (r.status, r.similarity) for r in by_id.collect()} == {"1": ("unchanged", None), "2": ("modified", 0.6), "3": ("modified", 1.0)}


def test_typed_graph_stores_lines_alone_and_shuffles_no_vectors(spark):
    before = stored(spark)
    t = order_provisions(spark, SF)
    assert [n.split("-")[0] for n in stored(spark) - before] == ["lines"]
    assert exchanges(t["Article"]) == exchanges(t["Paragraph"]) == 0


def test_new_versions_reuse_stored_lines(spark):
    before = stored(spark)
    _, new = queries_graph._versions(spark, SF)
    assert len(stored(spark) - before) == 1 and exchanges(new["Article"]) == exchanges(new["Paragraph"]) == 0


def test_manifests_are_distinct_where_ids_met(spark):
    plan = reads.manifests(order_provisions(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(document_id#\w+, kind", plan)
