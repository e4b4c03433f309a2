"""Literal cases of the other operators, and the streaming ingest."""

import base64

from pyspark.sql import functions as F

from provisio.functions.text import content_hash, cosine, slug
from provisio.operators import changes, evidence, graph, metadata, retrieval
from provisio.plans.corpus import ingest
from provisio.sources import documents
from provisio.streaming.ingest import event_windows, read_manifest, stream_ingest


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([3.0, 0.0, 4.0], [2.0, 0.0], 0.6)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.select(cosine("a", "b").alias("got"), "want").collect())


def test_hash_and_slug(spark):
    r = one(spark, a=" Test content \n", b="Test content").select(content_hash("a").alias("x"), content_hash("b").alias("y"), slug(F.lit(" Notified  Body! ")).alias("s")).first()
    assert r.x == r.y and len(r.x) == 64 and r.s == "notified_body"


def test_fusion(spark):
    lists = spark.createDataFrame([(0, "p", 0, 0.9), (4, "q", 0, 5.0), (4, "r", 1, 4.0), (4, "p", 2, 3.0)], "list_no int, provision_id string, rank int, score double")
    rows = retrieval.fuse(lists, (0, 1, 2, 3), 15).collect()
    assert rows[0].provision_id == "p" and rows[0].score == 0.3023 and [r.provision_id for r in rows] == ["p", "q", "r"]


def test_keyword_query(spark):
    q = 'Does Article 10 exempt a "custom made" importer under Annex XIII from the anti-doping rules?'
    got = retrieval.keyword_query(one(spark, text=q)).first().fulltext
    assert got == '"custom made"^3.0 OR "Article 10"^2.5 OR "Annex XIII"^2.5 OR "exempt"^2.0 OR "importer"^1.0 OR Article^0.8 OR custom^0.8 OR made^0.8 OR Annex^0.8 OR XIII^0.8 OR anti\\-doping^0.8 OR rules^0.8'


def test_metadata(spark):
    r = one(spark, t="— x\nshort\n  A long enough title \r\nrest", f="My.Law_act.pdf").select(metadata.title(F.col("t"), F.col("f")).alias("title"), metadata.short_name(F.lit("T"), F.col("f")).alias("name"), metadata.short_name(F.lit("The quick, brown fox jumps"), F.lit("")).alias("other")).first()
    assert (r.title, r.name, r.other) == ("A long enough title", "MY_LAW", "THE_QUICK_BROWN_FOX")


def test_history_and_intent(spark):
    m = spark.createDataFrame([(1, t, "x" * 400) for t in range(3)], "conv_id int, turn int, text string")
    assert sorted(r.turn for r in evidence.trim_history(m, 250).collect()) == [1, 2]
    texts = {"Hello!": "greeting", "please upload this": "upload", "compare the versions": "diff", "What is due?": "question", "": "question"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.i for r in df.select("t", evidence.intent(F.col("t")).alias("i")).collect()} == texts


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "Document"), ("b", "Article"), ("c", "Article"), ("z", "ActorRole"), ("o", "Document")], "id string, label string")
    edges = spark.createDataFrame([("a", "HAS_ARTICLE", "b"), ("b", "CITES", "c"), ("c", "CITES", "b"), ("c", "APPLIES_TO", "z"), ("o", "CITES", "c")], "src_id string, rel_type string, dst_id string")
    left, kept, gone = graph.cascade_delete(nodes, edges, nodes.where("id = 'a'"))
    assert {r.id for r in gone.collect()} == {"a", "b", "c", "z"} and {r.id for r in left.collect()} == {"o"} and kept.count() == 0
    assert {r.id for r in graph.cascade_delete(nodes, edges, nodes.where("id = 'a'"), ("APPLIES_TO",))[2].collect()} == {"a", "b", "c"}
    stored = spark.createDataFrame([(1, "x", "y")], "id int, p string, q string")
    new = spark.createDataFrame([(1, None, "n", 0), (1, "m", None, 1), (2, "k", None, 2)], "id int, p string, q string, ord int")
    assert {tuple(r) for r in graph.upsert(stored, new, "id").collect()} == {(1, "m", "n"), (2, "k", None)}
    bad = edges.union(spark.createDataFrame([("a", "NO_SUCH", "b"), ("a", "CITES", "missing")], edges.schema))
    assert graph.guarded(bad, nodes, nodes).count() == 5


def test_changes(spark):
    docs = spark.createDataFrame([("h1", "A"), ("h2", "B")], "content_hash string, short_name string")
    status = lambda *a, **k: changes.exists_check(docs, *a, **k).first().status
    assert status("h1") == "identical" and status("h9", "B") == "not_found" and status(None, "B") == "different_version" and status("h9", parity=True) == "different_version"
    para = changes.numbered_paragraphs(spark.createDataFrame([("a", "1. one\n2. two\n2. again"), ("b", "x\n\n y ")], "article_id string, text string"))
    assert {tuple(r) for r in para.collect()} == {("a", "1", "one"), ("a", "2", "again"), ("b", "1", "x"), ("b", "2", "y")}


def test_sources(spark, tmp_path):
    rows = [("a.txt", base64.b64encode(b" text ").decode()), ("b.bin", base64.b64encode(b"%PDF-1.4").decode()), ("c.txt", base64.b64encode(b"\xff\xfe").decode())]
    got = {r.filename: (r.text, r.status) for r in documents.parse_base64(spark.createDataFrame(rows, "filename string, content_base64 string")).collect()}
    assert got == {"a.txt": ("text", "ok"), "b.bin": (None, "pdf"), "c.txt": (None, "error")}
    (tmp_path / "x.pdf").write_bytes(b"%PDF page")
    pdf = documents.parse_pdf(documents.read_landing(spark, str(tmp_path)), lambda c: [c.decode(), "y" * 60]).first()
    assert pdf.page_count == 2 and not pdf.is_scanned and pdf.text.startswith("%PDF page\n")


def test_streaming(spark, tmp_path):
    land, manifest, check = (str(tmp_path / x) for x in ("land", "manifest", "check"))
    (tmp_path / "land").mkdir()
    run = lambda: stream_ingest(spark, land, manifest, check).awaitTermination(120)
    (tmp_path / "land/one.txt").write_text("A first statute about things")
    (tmp_path / "land/empty.txt").write_text(" \n")
    run()
    (tmp_path / "land/copy.txt").write_text("A first statute about things")
    run()
    run()
    assert {(r.filename, r.status) for r in read_manifest(spark, manifest).collect()} == {("one.txt", "new_document"), ("empty.txt", "error"), ("copy.txt", "identical")}


def test_equal_files_of_one_batch(spark):
    files = spark.createDataFrame([("b.txt", "A statute about things", "h"), ("a.txt", "A statute about things", "h"), ("c.txt", " ", "e"), ("d.txt", "", "e")], "filename string, text string, content_hash string")
    stored = spark.createDataFrame([], "short_name string, content_hash string")
    got = {r.filename: r.status for r in ingest(stored, files).collect()}
    assert got == {"a.txt": "new_document", "b.txt": "identical", "c.txt": "error", "d.txt": "error"}


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    out = event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").count() == event_windows(events).count()


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
