"""Semantic extraction from provisions: domain, annexes, definitions, term use, roles, obligations."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.text import EXACT, contains_any, slug, strip

#: Roles that every document has, in order.
BASE_ROLES = (
    "Manufacturer",
    "Authorised Representative",
    "Importer",
    "Distributor",
    "Notified Body",
    "Health Institution",
    "Competent Authority",
)
#: Domains and the substrings that decide for them, first match first.
DOMAINS = (
    ("Medical & Healthcare Regulation", ("medical", "device", "implant", "clinical")),
    ("Data Protection & Privacy", ("personal data", "controller", "processor", "privacy")),
    ("Artificial Intelligence & Technology Regulation", ("artificial intelligence", "ai system", "model")),
    ("Intellectual Property Law", ("patent", "copyright", "trademark", "intellectual property")),
    ("Financial & Securities Regulation", ("shares", "securities", "investor", "capital")),
    ("Commercial Contract / Licensing", ("license", "services", "fees", "deliverables", "agreement")),
)
DEFAULT_DOMAIN = "General Statutory / Regulatory Law"
#: Patterns of definitions, numbered and standing alone at a line's start.
NUMBERED_DEFINITION = r"(?isuUd)(?:(?:\(([0-9]+[a-z]?)\)|([0-9]+)\.))\s*[‘'\"“]([^'\"”’]+)[’'\"”]\s+(?:means|shall\s+mean|refers\s+to|is\s+defined\s+as)\s+(.*?)(?=(?:\n\s*(?:\([0-9]+[a-z]?\)|[0-9]+\.)\s*[‘'\"“])|\z)"
PLAIN_DEFINITION = r"(?ismuUd)^[‘'\"“]([^'\"”’]+)[’'\"”]\s+(?:means|shall\s+mean|refers\s+to|is\s+defined\s+as|has\s+the\s+meaning)\s+(.*?)(?=(?:\n[‘'\"“])|\z)"
SUPPLEMENT_REFERENCE = r"(?diuU)\b(?:Annex|Schedule|Exhibit|Appendix)\s+([IVXLCDM0-9]+|[A-Z])\b"
ROLE = EXACT + r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s+(?:shall|must|is\s+liable|shall\s+not|may)\b"
#: Words that are no role, nor begin one.
NO_ROLE = (
    "The", "This", "That", "These", "Those", "A", "An", "In", "On", "If", "When", "Where",
    "Nothing", "Any", "All", "Each", "Every", "Neither", "Either", "Member", "State",
    "Union", "Commission", "Court", "Paragraph", "Article", "Section", "Chapter", "Annex",
    "However", "Notwithstanding", "Provided", "Unless", "Subject", "Order",
)
#: Substrings of sentences that oblige, and articles that define.
MODALS = ("shall", "must", "is liable", "jointly and severally", "shall not", "may not", "exempt", "derogation", "statement referred to")
DEFINING_NUMBERS = ("1", "2", "3", "101")
#: Types that a document's ontology names; sets, so without order.
NODE_TYPES = ("Annex", "ActorRole", "DefinedTerm", "Document", "Obligation", "Paragraph", "Provision")
RELATION_TYPES = ("APPLIES_TO", "DEFINES", "HAS_PARAGRAPH", "HAS_PROVISION", "IMPOSES", "REFERENCES_ANNEX", "USES_TERM")


def _domain(sample: Column) -> Column:
    out = F.lit(DEFAULT_DOMAIN)
    for name, words in reversed(DOMAINS):
        out = F.when(contains_any(sample, words), F.lit(name)).otherwise(out)
    return out


def _samples(chunks: DataFrame) -> DataFrame:
    """doc_id, short_name (the least), sample: in lower case, the first 200 characters of a document's first 15 provisions."""
    numbered = chunks.select("doc_id", "short_name", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("_n"))
    first = F.collect_list(F.when(F.col("_n") <= 15, F.struct("_n", F.substring("text", 1, 200).alias("t"))))
    return numbered.groupBy("doc_id").agg(F.min("short_name").alias("short_name"), F.lower(F.array_join(F.transform(F.sort_array(first), lambda x: x["t"]), " ")).alias("sample"))


def domains(chunks: DataFrame) -> DataFrame:
    """doc_id, domain: from the first 200 characters of a document's first 15 provisions."""
    return _samples(chunks).select("doc_id", _domain(F.col("sample")).alias("domain"))


def ontology(chunks: DataFrame) -> DataFrame:
    """document_id, domain, node_types, relationship_types, description: one record a document."""
    return _samples(chunks).select("short_name", _domain(F.col("sample")).alias("domain")).select(
        F.concat(F.lit("doc:"), "short_name").alias("document_id"),
        "domain",
        F.array_sort(F.array(*map(F.lit, NODE_TYPES))).alias("node_types"),
        F.array_sort(F.array(*map(F.lit, RELATION_TYPES))).alias("relationship_types"),
        F.format_string("Autonomous legal ontology discovered for %s (%s).", "short_name", "domain").alias("description"),
    )


def annexes(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_type = 'annex'").select("doc_id", "id", "number", "title", "text")


def first_and_last(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key with the first and the last value by order: what a lookup finds that stops at the first match, and one that lets later entries win."""
    kind = value.removesuffix("_id")
    return rows.groupBy(key).agg(F.min_by(value, order).alias(f"first_{kind}"), F.max_by(value, order).alias(f"last_{kind}"))


def _placed(pattern: int):
    return lambda x, i: F.struct(F.lit(pattern).alias("pattern"), i.alias("pos"), x["term"].alias("term"), x["body"].alias("body"))


def definitions(chunks: DataFrame) -> DataFrame:
    """doc_id, article_id, term_id, term, normalized_term, definition, ord: the first definition of each term of a document."""
    articles = chunks.where((F.col("chunk_type") == "article") & (F.lower(F.coalesce("title", F.lit(""))).contains("definition") | F.col("number").isin(*DEFINING_NUMBERS)))
    each = []
    for k, (pattern, term, body) in enumerate(((NUMBERED_DEFINITION, 3, 4), (PLAIN_DEFINITION, 1, 2))):
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(term)).alias("term"), F.regexp_extract_all("text", F.lit(pattern), F.lit(body)).alias("body"))
        each.append(F.transform(pairs, _placed(k)))
    found = articles.select("doc_id", "short_name", F.col("id").alias("article_id"), "ord", F.explode(F.concat(*each)).alias("p")).select("doc_id", "short_name", "article_id", "ord", "p.pattern", "p.pos", "p")
    terms = found.select("doc_id", "short_name", "article_id", "ord", "pattern", "pos", strip("p.term").alias("term"), strip(F.regexp_replace("p.body", r"(?U)\s+", " ")).alias("definition"))
    terms = terms.withColumn("normalized_term", F.lower("term")).where((F.col("term") != "") & (F.length("term") <= 80))
    first = Window.partitionBy("doc_id", "normalized_term").orderBy("ord", "pattern", "pos")
    return terms.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", "article_id", F.concat("short_name", F.lit(":term:"), slug("term")).alias("term_id"), "term", "normalized_term", "definition", "ord", "pattern", "pos")


#: Paragraphs, and terms, of a document that one comparison takes together.
PARAGRAPH_BLOCK, TERM_BLOCK = 256, 20_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """paragraph and term, by their places in their blocks, of each block pair: one automaton of the terms reads each paragraph once."""
    last, automaton = None, None
    for batch in batches:
        for row, (paragraphs, terms, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("texts", "terms", "key")), strict=True)):
            if key != last:
                last, automaton, whole = key, ahocorasick.Automaton(), []
                for k, t in enumerate(terms):
                    if t:
                        automaton.add_word(t, (*automaton.get(t, ()), k))
                    else:
                        whole.append(k)  # the empty text stands in every other
                automaton.make_automaton()
            at, which = [], []
            for i, text in enumerate(paragraphs):
                hit = {k for _, found in automaton.iter(text) for k in found} if len(automaton) and text else set()
                hit.update(whole)
                at += [i] * len(hit)
                which += sorted(hit)
            if at:
                ids, names, ords = (batch.column(c)[row].values for c in ("ids", "term_ids", "ords"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1).take(pa.array([0] * len(at))), ords.take(pa.array(at)), ids.take(pa.array(at)), names.take(pa.array(which))], names=["doc_id", "ord", "paragraph_id", "term_id"])


def uses_term(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, ord, paragraph_id, term_id for each term of the document that a paragraph contains.

    Paragraphs and terms of a document meet in blocks of bounded size, and each block of terms is an automaton that reads a paragraph once, however many terms it has.
    """
    number = lambda size, *by: F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)) - 1) / size)
    paragraphs = chunks.where("chunk_type = 'paragraph'").select("doc_id", "ord", F.col("id").alias("paragraph_id"), F.lower("text").alias("t"))
    texts = paragraphs.withColumn("block", number(PARAGRAPH_BLOCK, "ord")).groupBy("doc_id", "block").agg(F.collect_list(F.struct("ord", "paragraph_id", "t")).alias("p"))
    words = terms.withColumn("part", number(TERM_BLOCK, "term_id", "normalized_term")).groupBy("doc_id", "part").agg(F.collect_list(F.struct("term_id", F.col("normalized_term").alias("t"))).alias("w"))
    pairs = texts.join(words, "doc_id").select("doc_id", "p.ord", "p.paragraph_id", "p.t", "w.term_id", F.col("w.t").alias("terms"), F.concat_ws(":", "doc_id", "part").alias("key"))
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    chunks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row has two blocks
    return pairs.toDF("doc_id", "ords", "ids", "texts", "term_ids", "terms", "key").mapInArrow(_found, f"doc_id {kind['doc_id']}, ord {kind['ord']}, paragraph_id string, term_id string")


def _discovered(chunks: DataFrame) -> DataFrame:
    """doc_id, slug, f (ord, pos, name), rank: the roles of a document beside the base ones, by first appearance."""
    hits = chunks.where("chunk_type = 'article'").select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(ROLE), F.lit(1))).alias("pos", "raw")).withColumn("name", strip("raw"))
    word = F.get(F.split("name", r"(?U)\s+"), F.lit(0))
    hits = hits.where(~F.col("name").isin(*NO_ROLE) & ~word.isin(*NO_ROLE) & (F.length("name") > 2)).withColumn("slug", slug("name"))
    hits = hits.where(~F.col("slug").isin(*[r.lower().replace(" ", "_") for r in BASE_ROLES]))
    return hits.groupBy("doc_id", "slug").agg(F.min(F.struct("ord", "pos", "name")).alias("f")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("f")) + len(BASE_ROLES) - 1)


def roles(chunks: DataFrame) -> DataFrame:
    """doc_id, role_id, name, rank: base roles first, then discovered ones by first appearance."""
    base = F.posexplode(F.array(*map(F.lit, BASE_ROLES)))
    fixed = chunks.select("doc_id").distinct().select("doc_id", base.alias("rank", "name")).select("doc_id", F.concat(F.lit("role:"), slug("name")).alias("role_id"), "name", "rank")
    return fixed.union(_discovered(chunks).select("doc_id", F.concat(F.lit("role:"), "slug"), "f.name", "rank"))


def annex_references(chunks: DataFrame) -> DataFrame:
    """doc_id, article_id, annex_id in order of the text, repetitions included."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(SUPPLEMENT_REFERENCE), F.lit(1)))
    return chunks.where("chunk_type = 'article'").select("doc_id", "short_name", F.col("id").alias("article_id"), found.alias("pos", "n")).select("doc_id", "article_id", "pos", F.concat("short_name", F.lit(":annex:"), F.upper("n")).alias("annex_id"))


def _suffix(low: Column, k: Column) -> Column:
    return (
        F.when(low.contains("jointly and severally"), F.lit("obl:joint_liability"))
        .when(low.contains("ce marking") & low.contains("shall not"), F.lit("obl:ce_marking_exemption"))
        .when(low.contains("statement") & low.contains("annex xiii"), F.lit("obl:annex_xiii_statement"))
        .when(low.contains("exempt") | low.contains("shall not apply"), F.concat(F.lit("obl:exemption_"), k.cast("string")))
        .otherwise(F.concat(F.lit("obl:"), k.cast("string")))
    )


def obligations(chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, article_id, obligation_id, modality, description, role: sentences of articles that oblige, permit or exempt.

    role is the first of the document's roles (found, where they are at hand) whose name stands in the sentence. Only documents with obligations meet their roles,
    joined on the document.
    """
    sentences = chunks.where("chunk_type = 'article'").select("doc_id", "short_name", "ord", F.col("id").alias("article_id"), "number", F.posexplode(F.split("text", r"(?<=[.!?])(?U)\s+")).alias("pos", "raw"))
    said = sentences.withColumn("s", strip("raw")).withColumn("low", F.lower("s")).where(contains_any(F.col("low"), MODALS) & (F.length("s") >= 20))
    k = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("pos"))
    low = F.col("low")
    modality = F.when(low.contains("may") & ~low.contains("shall"), F.lit("may")).when(low.contains("must"), F.lit("must")).otherwise(F.lit("shall"))
    own = said.withColumn("k", k).select(
        "doc_id", "ord", "pos", "article_id", F.concat("short_name", F.lit(":art:"), slug("number"), F.lit(":"), _suffix(low, F.col("k"))).alias("obligation_id"), modality.alias("modality"), F.substring("s", 1, 500).alias("description"), "low"
    )
    # every document has the base roles, which come first: only the others have to be met
    others = _discovered(chunks).select("doc_id", "rank", "f.name") if found is None else found.where(F.col("rank") >= len(BASE_ROLES))
    names = others.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("roles"))
    base = F.coalesce(*[F.when(low.contains(r.lower()), F.lit(r)) for r in BASE_ROLES])
    other = F.get(F.filter("roles", lambda r: low.contains(F.lower(r["name"]))), F.lit(0))["name"]
    return own.join(names, "doc_id", "left").withColumn("role", F.coalesce(base, other)).drop("low", "roles")
