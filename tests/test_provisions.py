"""Typed tables: literal cases of reads, updates, search and evidence."""

import json

import pytest
from pyspark.sql import functions as F

from provisio.operators import changes, evidence, graph, reads, search
from provisio.plans import updates
from provisio.plans.provisions import SCHEMAS, empty_tables
from provisio.sources import documents


@pytest.fixture(scope="module")
def act(spark):
    """The seed act: one document, recitals, articles with paragraphs, terms and references."""
    t = empty_tables(spark)
    put = lambda name, rows, cols: t[name].unionByName(spark.createDataFrame(rows, cols), allowMissingColumns=True)
    t["Document"] = put("Document", [("doc:ACT", "An Act on Things", "ACT", "regulation", "h1")], "id string, title string, short_name string, document_type string, content_hash string")
    t["Article"] = put("Article", [("ACT:art:1", "1", "Scope", "All things."), ("ACT:art:2", "2", "Duties", "Makers shall label."), ("ACT:art:10", "10", "End", "Ends.")], "id string, number string, title string, full_text string")
    t["Paragraph"] = put("Paragraph", [("ACT:art:2:para:10", "10", "Tenth."), ("ACT:art:2:para:2", "2", "Second.")], "id string, number string, text string")
    t["Recital"] = put("Recital", [("ACT:recital:1", "1", "Whereas things.")], "id string, number string, text string")
    rows = [("doc:ACT", "HAS_ARTICLE", f"ACT:art:{n}") for n in (1, 2, 10)] + [("ACT:art:2", "HAS_PARAGRAPH", f"ACT:art:2:para:{n}") for n in (2, 10)] + [("doc:ACT", "HAS_RECITAL", "ACT:recital:1"), ("ACT:art:2", "CITES", "ACT:art:1"), ("ACT:art:2", "INTERPRETED_BY", "ACT:recital:1")]
    t["edges"] = spark.createDataFrame(rows, SCHEMAS["edges"])
    return t


def test_reads(spark, act):
    assert [r.number for r in reads.document_articles(act).orderBy("rank").collect()] == ["1", "10", "2"]
    two = reads.with_paragraphs(act).where("id = 'ACT:art:2'").first()
    assert two.text == "Makers shall label." and two.paragraphs == ["Tenth.", "Second."]
    c = reads.context(act).where("id = 'ACT:art:2'").first()
    assert (c.parent_title, c.recitals, c.cited, c.terms) == ("An Act on Things", ["Whereas things."], ["ACT:art:1"], [])
    assert {r.key for r in reads.resolve(act["Document"], spark.createDataFrame([("ACT",), ("doc:ACT",), ("x",)], "key string")).collect()} == {"ACT", "doc:ACT"}
    assert reads.find_documents(act["Document"], title="Things", short_name="ACT").count() == 1 and reads.find_document(act["Document"], content_hash="no").count() == 0
    with pytest.raises(ValueError):
        reads.find_documents(act["Document"])
    assert reads.query_views(spark, "SELECT count(*) AS n FROM arts WHERE number = :n", {"n": "2"}, arts=act["Article"]).first().n == 1


def test_updates(spark, act):
    doc = lambda df: df.withColumn("document_id", F.lit("doc:ACT"))
    arts = doc(act["Article"].where("number <> '10'").withColumn("full_text", F.when(F.col("number") == "2", "Changed.").otherwise(F.col("full_text")))).withColumn("content_hash", F.sha2("full_text", 256)).withColumn("parent_id", F.col("document_id"))
    stored = dict(act, Article=act["Article"].withColumn("content_hash", F.sha2("full_text", 256)))
    none = lambda name: doc(act[name].limit(0)).withColumn("parent_id", F.lit("x"))
    orphan = arts.limit(1).withColumn("id", F.lit("X:art:1")).withColumn("parent_id", F.lit("doc:X"))
    new = {"Article": arts.union(orphan), "Paragraph": none("Paragraph"), "Recital": none("Recital")}
    status = {r.id: r.status for r in updates.changed(stored, new).collect()}
    assert status == {"ACT:art:1": "unchanged", "ACT:art:2": "updated", "X:art:1": "added"}
    out = updates.take_in(stored, new)
    assert {r.id: r.full_text for r in out["Article"].collect()} == {"ACT:art:1": "All things.", "ACT:art:2": "Changed.", "ACT:art:10": "Ends."}
    known = spark.createDataFrame([("doc:ACT", "ACT", True), ("doc:N", "N", False)], "document_id string, short_name string, existing boolean")
    said = {r.document_id: (r.status, r.message) for r in updates.counters(updates.changed(stored, {**new, "Article": arts}), known).collect()}
    assert said["doc:ACT"] == ("updated_document", "Updated 'ACT': 1 articles modified, 0 articles added, 1 unchanged.")
    assert said["doc:N"] == ("new_document", "Successfully indexed 'N': 0 articles, 0 recitals, 0 paragraphs with vector embeddings.")


def test_roles_merge_by_name(spark, act):
    roles = spark.createDataFrame([("Importer", "role:old")], SCHEMAS["ActorRole"])
    new = spark.createDataFrame([("Importer", "role:importer"), ("Maker", None)], SCHEMAS["ActorRole"])
    assert {tuple(r) for r in graph.upsert(roles, new, "name").collect()} == {("Importer", "role:importer"), ("Maker", None)}


def test_article_similarity(spark):
    old = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "same", None), ("3", "b", [1.0, 0.0])], "number string, text string, embedding array<double>")
    new = spark.createDataFrame([("1", "c", [0.0, 1.0]), ("2", " same ", None), ("3", "d", None), ("4", "e", None), ("", "no number", None)], old.schema)
    got = {r.number: (r.status, r.similarity, r.change_level) for r in changes.article_diff(old, new).collect()}
    assert got == {"1": ("modified", 0.0, "major_rewrite"), "2": ("unchanged", None, None), "3": ("modified", 1.0, "formatting_or_minor"), "4": ("added", None, None)}
    t = changes.diff_totals(changes.article_diff(old, new)).first()
    assert (t.total_added, t.total_removed, t.total_modified, t.unchanged_count) == (1, 0, 2, 1)


def test_bad_bytes_are_replaced(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"ab\xff\xfec")), ("", bytearray("é".encode()))], "filename string, content binary")
    got = {(r.title, r.text) for r in documents.parse_text(df).collect()}
    assert got == {("a.txt", "ab��c"), ("Text Input", "é")}


def test_records_and_bundles(spark):
    one = {"provision_id": "A", "document": "D", "article_title": "T", "text": "x" * 2000, "score": 0.5, "cited_articles": ["B"]}
    two = {"provision_id": "C", "text": "short"}
    rows = [(1, json.dumps({"status": "success", "data": [two, one]})), (2, json.dumps([one, two])), (3, json.dumps(one)), (4, "no json"), (5, None)]
    got = evidence.records(spark.createDataFrame(rows, "q int, output string"), "q", "output")
    assert {q: n for q, n in got.where("provision_id IS NOT NULL").groupBy("q").count().collect()} == {1: 2, 2: 2, 3: 1}
    texts = {r.q: r.bundle for r in evidence.bundles(got, "q").collect()}
    assert texts[1] == texts[2] and texts[1].startswith("=== PROVISION: A | D | T ===\n") and texts[1].index("PROVISION: A") < texts[1].index("PROVISION: C | Document ===")
    assert evidence.TRUNCATED in texts[1] and "Cross-References Cited: B" in texts[1] and texts[4] == texts[5] == evidence.NOTHING


def test_budget_of_a_large_group(spark):
    df = spark.range(5000).select(F.lit("s").alias("g"), "id", (F.col("id") % 97 + 1).alias("size")).repartition(7)
    got = [r.id for r in evidence.within_budget(df, ["g"], [F.desc("size"), F.col("id")], F.col("size"), 1000, True).collect()]
    want, total = [], 0
    for i in sorted(range(5000), key=lambda i: (-(i % 97 + 1), i)):
        total += i % 97 + 1
        if total > 1000:
            break
        want.append(i)
    assert sorted(got) == sorted(want)


def test_phrases_by_position(spark):
    rows = spark.createDataFrame([("a", "one two three"), ("b", "two one"), ("c", "one x two one two")], "id string, text string")
    assert {r.id for r in search.keyword_scores(search.keyword_index(rows, "text"), {"one two": 1.0}).collect()} == {"a", "c"}
    v = spark.createDataFrame([("",), (None,), ("word word",)], "t string").select(search.hash_embedding(F.col("t")).alias("v"))
    assert sorted(round(sum(x * x for x in r.v), 6) for r in v.collect()) == [0.0, 0.0, 1.0]
