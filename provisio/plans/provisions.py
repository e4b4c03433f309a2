"""Typed tables of the property graph: their schemas, empty tables, and one graph made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.tables import written
from provisio.plans.corpus import order_lines, tables

#: The node tables and the columns of each; the first column is its key.
SCHEMAS = {
    "Document": "id string, title string, short_name string, document_type string, content_hash string, version string, eli_uri string, publication_date timestamp, indexed_at timestamp",
    "Chapter": "id string, number string, title string",
    "Article": "id string, number string, title string, full_text string, content_hash string, embedding array<float>",
    "Paragraph": "id string, number string, text string, content_hash string, embedding array<float>",
    "Recital": "id string, number string, text string, embedding array<float>",
    "Annex": "id string, number string, title string, text string, embedding array<float>",
    "DefinedTerm": "id string, term string, normalized_term string, definition string",
    "Obligation": "id string, modality string, description string",
    "ActorRole": "name string, id string",
    "OntologySchema": "document_id string, domain string, description string, node_types array<string>, relationship_types array<string>, updated_at timestamp",
    "edges": "src_id string, rel_type string, dst_id string",
}


#: Vectors that are broadcast (about 10 MB of 64 numbers each); more are joined.
FEW_VECTORS = 40_000


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """One empty table for each label, and one of edges; making them again changes nothing."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def provision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items that the typed graph is made of, stored."""
    return written(order_lines(spark, sf_dir).select("l_orderkey", "n", "l_partkey", "l_suppkey", "l_returnflag", "p_name", "p_type", F.col("l_quantity").cast("int").alias("quantity")), "lines")


def line_articles(lines: DataFrame) -> DataFrame:
    """l_orderkey, n, id, number, title, full_text, l_partkey (which deals out its vector): an article for each line."""
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    n = F.col("n").cast("string")
    return lines.select(
        "l_orderkey", "n", text("ORD", F.col("l_orderkey").cast("string"), ":art:", n).alias("id"), n.alias("number"), text("Delivery ", F.col("l_returnflag")).alias("title"), text("Delivery of ", F.col("p_name"), " as part ", F.col("l_partkey").cast("string"), ".").alias("full_text"), "l_partkey"
    )


def line_paragraphs(lines: DataFrame) -> DataFrame:
    """l_orderkey, n, parent_id, id, number, text, dealt (the number that deals out its vector): the paragraphs of each line's article."""
    art = F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"), F.lit(":art:"), F.col("n").cast("string"))
    row = lambda number, text, dealt: ("l_orderkey", "n", art.alias("parent_id"), F.concat(art, F.lit(f":para:{number}")).alias("id"), F.lit(number).alias("number"), text.alias("text"), dealt.alias("dealt"))
    first = lines.select(*row("1", F.concat(F.lit("The supplier shall deliver "), F.col("quantity").cast("string"), F.lit(" units of "), "p_name", F.lit(".")), F.col("l_partkey") + F.col("l_suppkey")))
    return first.union(lines.where("l_returnflag = 'R'").select(*row("2", F.lit("Returned goods are exempt."), F.col("l_suppkey"))))


def dealt_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vectors (vec_id, ...), broadcast where they are few, and their number."""
    n = vectors.count()
    return F.broadcast(vectors) if n <= FEW_VECTORS else vectors, n


def order_provisions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """The typed graph of the order tables: an act for each order, an article for each line item under a chapter for each return flag.

    Vectors are those of the table embeddings, dealt out by part. Lines are written once; all tables but those of orders, parts and suppliers are made of them by row, so that
    they are not stored: what reads one kind of edges makes no others.
    """
    orders, part, supplier, vectors = tables(spark, sf_dir, "orders", "part", "supplier", "embeddings")
    few, n_vectors = dealt_vectors(vectors.select("vec_id", "embedding"))
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    c = lambda name: F.col(name).cast("string")
    with_vector = lambda df, by: df.join(few, F.pmod(by, F.lit(n_vectors)) == F.col("vec_id")).drop("vec_id")
    lines = provision_lines(spark, sf_dir) if lines is None else lines  # those of provision_lines, where they are at hand
    sn = text("ORD", c("l_orderkey"))
    art = text(sn, ":art:", c("n"))
    articles = with_vector(line_articles(lines), F.col("l_partkey"))
    paragraphs = with_vector(line_paragraphs(lines), F.col("dealt")).select("id", "number", "text", F.sha2("text", 256).alias("content_hash"), "embedding")
    act = text("ORD", c("o_orderkey"))
    doc = text("doc:", act)
    recitals = orders.where("o_orderstatus = 'O'").select("o_orderkey", act.alias("sn"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    recitals = with_vector(recitals, F.col("o_orderkey") + F.col("k")).select(text(F.col("sn"), ":recital:", c("k")).alias("id"), c("k").alias("number"), text("Recital ", c("k"), " of order ", c("o_orderkey"), ".").alias("text"), "embedding")
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    annexes = with_vector(urgent, F.col("o_orderkey") * 3).select(text(act, ":annex:IV").alias("id"), F.lit("IV").alias("number"), F.lit("Urgent orders").alias("title"), text("Order ", c("o_orderkey"), " is urgent.").alias("text"), "embedding")
    documents = orders.select(
        doc.alias("id"), text("Order ", c("o_orderkey"), " ", F.col("o_orderpriority")).alias("title"), act.alias("short_name"), F.lit("regulation").alias("document_type"), F.sha2(text(c("o_orderkey"), F.col("o_orderstatus")), 256).alias("content_hash"),
        F.lit("1").alias("version"), F.lit(None).cast("string").alias("eli_uri"), F.col("o_orderdate").alias("publication_date"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )
    chapter = text(sn, ":chap:", F.col("l_returnflag"))
    chapters = lines.select(chapter.alias("id"), F.col("l_returnflag").alias("number"), text("Chapter ", F.col("l_returnflag")).alias("title")).distinct()
    terms = part.select(text("term:", c("p_partkey")).alias("id"), F.col("p_name").alias("term"), F.lower("p_name").alias("normalized_term"), F.col("p_type").alias("definition"))
    owed = lines.select(text(art, ":obl:1").alias("id"), F.lit("shall").alias("modality"), text("Deliver ", c("quantity"), " units.").alias("description"))
    roles = supplier.select(F.col("s_name").alias("name"), text("role:", c("s_suppkey")).alias("id"))
    edge = lambda df, a, rel, b: df.select(a.alias("src_id"), F.lit(rel).alias("rel_type"), b.alias("dst_id"))
    d = text("doc:", sn)
    named = lines.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    edges = [
        edge(lines, d, "HAS_CHAPTER", chapter).distinct(), edge(lines, d, "HAS_ARTICLE", art), edge(lines, chapter, "HAS_ARTICLE", art), edge(lines, art, "HAS_PARAGRAPH", text(art, ":para:1")),
        edge(lines.where("l_returnflag = 'R'"), art, "HAS_PARAGRAPH", text(art, ":para:2")), edge(lines.where("n > 1"), art, "CITES", text(sn, ":art:1")),
        edge(lines, art, "USES_TERM", text("term:", c("l_partkey"))), edge(lines, art, "IMPOSES", text(art, ":obl:1")), edge(named, text(art, ":obl:1"), "APPLIES_TO", F.col("s_name")),
        edge(orders.where("o_orderstatus = 'O'").select("o_orderkey", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("k")), doc, "HAS_RECITAL", text(act, ":recital:", F.col("k"))),
        edge(urgent, doc, "HAS_ANNEX", text(act, ":annex:IV")), edge(lines.join(urgent.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"), art, "REFERENCES_ANNEX", text(sn, ":annex:IV")),
        edge(lines.join(orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").where("n <= 2"), art, "INTERPRETED_BY", text(sn, ":recital:", c("n"))),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    articles = articles.withColumn("content_hash", F.sha2("full_text", 256)).select("id", "number", "title", "full_text", "content_hash", "embedding")
    return {"Document": documents, "Chapter": chapters, "Article": articles, "Paragraph": paragraphs, "Recital": recitals, "Annex": annexes, "DefinedTerm": terms, "Obligation": owed, "ActorRole": roles, "edges": every}
