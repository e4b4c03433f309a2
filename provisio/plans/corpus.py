"""Plans: a statutory corpus made from the order tables, the graph of these tables, and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions.tables import written, written_all
from provisio.functions.text import strip
from provisio.operators import changes, graph, metadata, segment, semantics


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with p_name, p_type, p_brand and n, their number in the order by all columns."""
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    total = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    joined = lineitem.join(part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*total)))


def statutory_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, short_name, text: one act for each order. Article 1 defines its parts; each line item is an article; urgent orders have an annex."""
    (orders,) = tables(spark, sf_dir, "orders")
    lines = order_lines(spark, sf_dir)
    article = F.concat(
        F.lit("Article "), (F.col("n") + 1).cast("string"), F.lit("\nDelivery "), "l_returnflag", F.lit("\n1. The manufacturer shall deliver "), F.col("l_quantity").cast("int").cast("string"), F.lit(" units of "), "p_name",
        F.lit(" under Annex IV."), F.when(F.col("l_returnflag") == "R", "\n2. Article 1 shall not apply to returned goods.").otherwise(""),
    )
    # an order's lines meet once, for their numbers, and both lists are made of them there
    own = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", article.alias("t"), F.struct("l_partkey", "p_name", "p_type", "p_brand").alias("p")))).alias("x"))
    parts = F.array_sort(F.array_distinct(F.transform("x", lambda x: x["p"])))
    defined = F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". '"), p["p_name"], F.lit("' means part type "), p["p_type"], F.lit(" of brand "), p["p_brand"], F.lit(";")))
    own = own.select("l_orderkey", F.array_join(defined, "\n").alias("definitions"), F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("articles"))
    both = orders.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat_ws(
        "\n", F.when(F.col("o_orderstatus") == "O", "(1) This order is open.\n(2) It shall be served in time."), F.lit("Page 1 of 2"), F.lit("Article 1\nDefinitions"), "definitions", "articles",
        F.when(F.col("o_orderpriority") == "1-URGENT", "ANNEX IV\nUrgent orders\nUrgent orders are served first."),
    )
    return both.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("short_name"), text.alias("text"))


#: Shapes that varied_corpus deals out: headings (with what stands below), words of domains, verbs, supplements.
HEADINGS = ("Article 1\nScope", "Art. 1 Scope", "Section 1\nScope", "Sec. 1 Scope", "Clause 1\nScope", "Clause 1 Scope")
SUBJECTS = ("medical goods", "personal data", "artificial intelligence", "patent files", "securities", "fees", "goods")
VERBS = ("shall", "must", "may not")
SUPPLEMENTS = ("ANNEX IV", "SCHEDULE A", "EXHIBIT 2", "APPENDIX C", "")


def varied_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, short_name, text: an act for each part, with another heading, subject, verb, qualification and supplement from act to act."""
    (part,) = tables(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), F.pmod(k, F.lit(len(words))).cast("int"))
    body = F.concat(F.lit("Quality Auditor "), pick(VERBS), F.lit(" inspect all "), pick(SUBJECTS), F.lit(" of "), "p_brand", F.lit("."))
    rule = F.concat(F.lit("1. Records are kept "), pick(segment.QUALIFIERS), F.lit(" by law."))
    supplement = F.when(pick(SUPPLEMENTS) != "", F.concat(pick(SUPPLEMENTS), F.lit("\nLists\nA list of parts.")))
    return part.select(k.alias("doc_id"), F.concat(F.lit("P"), k.cast("string")).alias("short_name"), F.concat_ws("\n", F.lit("Page 1 of 3"), pick(HEADINGS), body, rule, supplement).alias("text"))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) and edges of regions, nations, customers, orders and line items."""
    region, nation, customer, orders, lineitem = tables(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    node = lambda df, prefix, c, label: df.select(name(prefix, c).alias("id"), F.lit(label).alias("label"))
    item = F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    nodes = node(region, "r:", "r_regionkey", "Region").union(node(nation, "n:", "n_nationkey", "Nation")).union(node(customer, "c:", "c_custkey", "Customer")).union(node(orders, "o:", "o_orderkey", "Document"))
    nodes = nodes.union(lineitem.select(item.alias("id"), F.lit("Article").alias("label")).distinct())
    edge = lambda df, a, rel, b: df.select(a.alias("src_id"), F.lit(rel).alias("rel_type"), b.alias("dst_id"))
    edges = edge(nation, name("r:", "n_regionkey"), "CONTAINS", name("n:", "n_nationkey")).union(edge(customer, name("n:", "c_nationkey"), "CONTAINS", name("c:", "c_custkey"))).union(edge(orders, name("c:", "o_custkey"), "CONTAINS", name("o:", "o_orderkey")))
    return nodes, edges.union(edge(lineitem, name("o:", "l_orderkey"), "HAS_ARTICLE", item).distinct())


def extract_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """All tables of one ingest: chunks, the documents' record, terms, roles, obligations, and the edges whose both ends exist."""
    chunks = written(segment.chunks(docs), "chunks")  # read by every extractor below
    found = written_all({"terms": semantics.definitions(chunks), "roles": semantics.roles(chunks)})  # each extractor runs once
    terms, roles, refs = found["terms"], found["roles"], semantics.annex_references(chunks)
    owed = written(semantics.obligations(chunks, roles), "owed")
    edge = lambda df, a, rel, b: df.select(F.col(a).alias("src_id"), F.lit(rel).alias("rel_type"), F.col(b).alias("dst_id"))
    kinds = {"article": "HAS_ARTICLE", "recital": "HAS_RECITAL", "annex": "HAS_ANNEX"}
    own = chunks.where(F.col("chunk_type").isin(*kinds)).withColumn("_d", F.concat(F.lit("doc:"), "short_name")).withColumn("_r", F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("chunk_type")))
    edges = own.select(F.col("_d").alias("src_id"), F.col("_r").alias("rel_type"), F.col("id").alias("dst_id"))
    edges = edges.union(edge(chunks.where("chunk_type = 'paragraph'"), "parent_id", "HAS_PARAGRAPH", "id")).union(edge(terms, "article_id", "DEFINES", "term_id")).union(edge(semantics.uses_term(chunks, terms), "paragraph_id", "USES_TERM", "term_id"))
    edges = edges.union(edge(owed, "article_id", "IMPOSES", "obligation_id")).union(edge(owed.where("role IS NOT NULL"), "obligation_id", "APPLIES_TO", "role")).union(edge(refs, "article_id", "REFERENCES_ANNEX", "annex_id"))
    edges = edges.union(chunks.where("chunk_type = 'article'").select(F.col("id").alias("src_id"), F.lit("CITES").alias("rel_type"), F.explode("cross_references").alias("dst_id")))
    nodes = chunks.select("id", F.initcap("chunk_type").alias("label")).union(docs.select(F.concat(F.lit("doc:"), "short_name"), F.lit("Document"))).union(terms.select("term_id", F.lit("DefinedTerm")))
    nodes = written(nodes.union(owed.select("obligation_id", F.lit("Obligation"))).union(roles.select("name", F.lit("ActorRole"))).distinct(), "nodes")
    return {"chunks": chunks, "terms": terms, "obligations": owed, "roles": roles, "nodes": nodes, "edges": graph.guarded(edges, nodes, nodes)}


def ingest(stored: DataFrame, files: DataFrame) -> DataFrame:
    """files (filename, text, content_hash) with short_name, title, document_type and status against the stored documents (short_name, content_hash).

    identical: the same hash is stored; updated_document: the same name under another hash; error: no text; else new_document.
    """
    t = metadata.title(F.col("text"), F.col("filename"))
    new = files.withColumn("title", t).withColumn("short_name", metadata.short_name(F.col("title"), F.col("filename"))).withColumn("document_type", metadata.graph_type(metadata.document_type(F.col("text"), F.col("title"))))
    same = stored.select(F.col("content_hash")).distinct().withColumn("_same", F.lit(True))
    named = stored.select("short_name").distinct().withColumn("_named", F.lit(True))
    # of equal files that come together the first by name is new, as if they came one by one
    new = new.withColumn("_copy", F.row_number().over(Window.partitionBy("content_hash").orderBy("filename")) > 1)
    status = F.when(F.coalesce(strip("text"), F.lit("")) == "", "error").when(F.col("_same") | F.col("_copy"), "identical").when(F.col("_named"), "updated_document").otherwise("new_document")
    return new.join(same, "content_hash", "left").join(named, "short_name", "left").withColumn("status", status).drop("_same", "_named", "_copy")


__all__ = ["changes", "extract_graph", "ingest", "order_graph", "order_lines", "statutory_corpus", "tables"]
