"""Reads of the typed graph: documents, provisions, their context, manifests. Each works on all rows or on those asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions.text import optional_equal
from provisio.operators.graph import reach_pairs

#: Labels that count as provisions, and relations from a parent to its provisions.
PROVISION_LABELS = ("Article", "Section", "Provision", "Recital", "Annex")
PARENT_RELATIONS = ("HAS_ARTICLE", "HAS_SECTION", "CONTAINS")


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def query_views(spark: SparkSession, text: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A SELECT with parameters over these tables as views; only reading is possible."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def find_documents(documents: DataFrame, title: str | None = None, short_name: str | None = None) -> DataFrame:
    """Documents whose title holds a text and whose short name is equal; at least one of both must be given."""
    if title is None and short_name is None:
        raise ValueError("title or short_name must be given")
    found = documents.where(F.col("title").contains(title)) if title is not None else documents
    return optional_equal(found, short_name=short_name)


def find_document(documents: DataFrame, content_hash: str | None = None, short_name: str | None = None) -> DataFrame:
    """The one document (of smallest id) with this hash, or with this name; no row if there is none."""
    return optional_equal(documents, content_hash=content_hash, short_name=short_name).orderBy("id").limit(1)


def resolve(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key) with the document that the key names: by id, by short name, or by an id without its prefix."""
    names = documents.select(F.col("id"), F.explode(F.array_distinct(F.array("id", "short_name", F.expr("substring(id, 5)")))).alias("key")).where("key IS NOT NULL AND key <> ''")
    return wanted.join(names, "key").distinct()


def provisions(graph: dict[str, DataFrame]) -> DataFrame:
    """id, label, number, title, text of all provisions, whatever their label; text is full_text, else text."""
    out = None
    for label in PROVISION_LABELS:
        if label not in graph:
            continue
        have = lambda c, t=graph[label]: F.col(c) if c in t.columns else F.lit(None).cast("string")
        rows = graph[label].select("id", F.lit(label).alias("label"), have("number").alias("number"), have("title").alias("title"), F.coalesce(have("full_text"), have("text")).alias("text"))
        out = rows if out is None else out.union(rows)
    return out.where("id IS NOT NULL AND id <> ''")


def with_paragraphs(graph: dict[str, DataFrame]) -> DataFrame:
    """provisions() with paragraphs: the texts of a provision's paragraphs, by number as text."""
    own = graph["edges"].where("rel_type = 'HAS_PARAGRAPH'").join(graph["Paragraph"].select(F.col("id").alias("dst_id"), "number", "text"), "dst_id")
    texts = own.groupBy(F.col("src_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]).alias("paragraphs"))
    return provisions(graph).join(texts, "id", "left").withColumn("paragraphs", F.coalesce("paragraphs", _no_texts()))


def _targets(graph: dict[str, DataFrame], relations: tuple[str, ...], column: str, value: Column, label: str | None = None) -> DataFrame:
    """id, column: the distinct values of what an id's relations lead to, sorted; aggregated before it is joined, so branches don't multiply."""
    e = graph["edges"].where(F.col("rel_type").isin(*relations))
    if label:
        key = "name" if label == "ActorRole" else "id"
        e = e.join(graph[label].withColumnRenamed(key, "dst_id"), "dst_id")
    return e.groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set(value)).alias(column))


def context(graph: dict[str, DataFrame]) -> DataFrame:
    """Each provision with chapter and parent titles, recitals, cited ids, defined terms, annexes, and obligations with the roles they bind."""
    out = with_paragraphs(graph)
    parents = graph["edges"].where(F.col("rel_type").isin(*PARENT_RELATIONS)).select("src_id", F.col("dst_id").alias("id"))
    titles = graph["Document"].select(F.col("id").alias("src_id"), "title").withColumn("kind", F.lit("document")).union(graph["Chapter"].select("id", "title", F.lit("chapter")))
    above = parents.join(titles, "src_id").groupBy("id").agg(F.max(F.when(F.col("kind") == "document", F.col("title"))).alias("parent_title"), F.max(F.when(F.col("kind") == "chapter", F.col("title"))).alias("chapter_title"))
    owed = graph["edges"].where("rel_type = 'IMPOSES'").join(graph["Obligation"].withColumnRenamed("id", "dst_id"), "dst_id")
    rules = owed.groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set(F.concat("modality", F.lit(": "), "description"))).alias("obligations"))
    bound = owed.select(F.col("src_id").alias("id"), F.col("dst_id").alias("src_id")).join(graph["edges"].where("rel_type = 'APPLIES_TO'"), "src_id").groupBy("id").agg(F.array_sort(F.collect_set("dst_id")).alias("actors"))
    branches = [
        _targets(graph, ("INTERPRETED_BY",), "recitals", F.col("text"), "Recital"), _targets(graph, ("CITES",), "cited", F.col("dst_id")), _targets(graph, ("REFERENCES_ANNEX",), "annexes", F.col("dst_id")),
        _targets(graph, ("USES_TERM",), "terms", F.concat("term", F.lit(": "), "definition"), "DefinedTerm"), rules, bound,
    ]
    out = out.join(above, "id", "left")
    for b in branches:
        out = out.join(b, "id", "left")
    lists = ("recitals", "cited", "annexes", "terms", "obligations", "actors")
    return out.select("id", "label", "number", "title", "text", "paragraphs", "parent_title", "chapter_title", *[F.coalesce(c, _no_texts()).alias(c) for c in lists])


def document_articles(graph: dict[str, DataFrame]) -> DataFrame:
    """document_id, rank, id, number: a document's articles, directly or below chapters and containers at any depth, by number as text ('10' before '2')."""
    pairs = reach_pairs(graph["edges"], graph["Document"], ("HAS_ARTICLE", "CONTAINS", "HAS_CHAPTER"))
    found = pairs.select(F.col("root").alias("document_id"), "id").join(graph["Article"].select("id", "number"), "id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("number", "id")) - 1).select("document_id", "rank", "id", "number")


def manifests(graph: dict[str, DataFrame]) -> DataFrame:
    """document_id, kind, id, hash: of a document's articles and paragraphs the content hash, of its recitals the text."""
    e = graph["edges"]
    own = graph["Document"].select(F.col("id").alias("src_id")).join(e.where("rel_type = 'HAS_ARTICLE'"), "src_id").select(F.col("src_id").alias("document_id"), F.col("dst_id").alias("id"))
    articles = own.join(graph["Article"].select("id", F.col("content_hash").alias("hash")), "id").select("document_id", F.lit("article").alias("kind"), "id", "hash")
    below = own.withColumnRenamed("id", "src_id").join(e.where("rel_type = 'HAS_PARAGRAPH'"), "src_id").select("document_id", F.col("dst_id").alias("id"))
    paragraphs = below.join(graph["Paragraph"].select("id", F.col("content_hash").alias("hash")), "id").select("document_id", F.lit("paragraph"), "id", "hash")
    recitals = e.where("rel_type = 'HAS_RECITAL'").select(F.col("src_id").alias("document_id"), F.col("dst_id").alias("id")).join(graph["Recital"].select("id", F.col("text").alias("hash")), "id").select("document_id", F.lit("recital"), "id", "hash")
    # each kind by itself, where its ids have met: no hash is shuffled once more
    return articles.distinct().union(paragraphs.distinct()).union(recitals.distinct())


def active_schema(graph: dict[str, DataFrame]) -> DataFrame:
    """kind, name, detail: the labels and relations in use, and of each document's ontology record its domain."""
    out = graph["edges"].select(F.lit("relationship").alias("kind"), F.col("rel_type").alias("name"), F.lit(None).cast("string").alias("detail")).distinct()
    for label, table in graph.items():
        if label != "edges":
            out = out.union(table.limit(1).select(F.lit("label"), F.lit(label), F.lit(None).cast("string")))
    return out.union(graph["OntologySchema"].select(F.lit("schema"), "document_id", "domain")) if "OntologySchema" in graph else out
