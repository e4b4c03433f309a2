"""Registered queries of the legal-text engine and their DuckDB equivalents. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.functions.text import content_hash, cosine, optional_equal
from provisio.operators import changes, evidence, graph, metadata, retrieval, segment, semantics
from provisio.plans.corpus import extract_graph, order_graph, order_lines, statutory_corpus, tables
from provisio.streaming.ingest import event_windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- hashes, duplicates, lookups -------------------------------------------------------------------------------------------------
WHITE = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query("content_hash", f"SELECT doc_id, sha256({WHITE}) AS content_hash, length(text) AS n FROM documents")
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.select("doc_id", content_hash("text").alias("content_hash"), F.length("text").cast("long").alias("n"))


@query("exact_duplicates", f"SELECT sha256({WHITE}) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.groupBy(content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query("optional_filter_lookup", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') AND p_brand = 'Brand#13'")
def _(spark, d):
    (part,) = tables(spark, d, "part")
    return optional_equal(part.where(F.col("p_name").contains("red")), p_brand="Brand#13", p_type=None).select("p_partkey", "p_name")


DOCUMENT_HASHES = "SELECT sha256(text) AS content_hash, source AS short_name FROM documents"
FIRST_HASH = "(SELECT sha256(text) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents))"
STATUS = "CASE WHEN count(*) = 0 THEN 'not_found' WHEN max((content_hash = h)::INT) = 1 THEN 'identical' ELSE 'different_version' END AS status, count(*) AS n_found"


def _exists(spark, d, parity: bool) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    h = docs.orderBy("doc_id").select(F.sha2("text", 256)).first()[0]
    return changes.exists_check(docs.select(F.sha2("text", 256).alias("content_hash"), F.col("source").alias("short_name")), h, None, parity)


@query("exists_check_fixed", f"SELECT {STATUS} FROM (SELECT *, {FIRST_HASH} AS h FROM ({DOCUMENT_HASHES})) WHERE content_hash = h")
def _(spark, d):
    return _exists(spark, d, False)


@query("exists_check_parity", f"SELECT {STATUS} FROM (SELECT *, {FIRST_HASH} AS h FROM ({DOCUMENT_HASHES}))")
def _(spark, d):
    return _exists(spark, d, True)


# --- retrieval -------------------------------------------------------------------------------------------------------------------
SCORES = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("vector_topk", f"SELECT b.vec_id, round({SCORES}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {SCORES} DESC, b.vec_id LIMIT 25")
def _(spark, d):
    (vectors,) = tables(spark, d, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    return retrieval.vector_top_k(vectors, q, 25).select("vec_id", F.round("score", 5).alias("score"))


@query(
    "vector_topk_batch",
    f"SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {SCORES} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank < 5",
)
def _(spark, d):
    (vectors,) = tables(spark, d, "embeddings")
    return retrieval.vector_top_k_batch(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(
    "cosine_levels",
    f"SELECT vec_id, round(s, 5) AS similarity, CASE WHEN s >= 0.95 THEN 'formatting_or_minor' WHEN s >= 0.8 THEN 'moderate' ELSE 'major_rewrite' END AS change_level FROM (SELECT a.vec_id, {SCORES} AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)",
)
def _(spark, d):
    (v,) = tables(spark, d, "embeddings")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").withColumn("s", cosine("embedding", "other"))
    return pairs.select("vec_id", F.round("s", 5).alias("similarity"), changes.article_level(F.col("s")).alias("change_level"))


@query("tokenise_counts", "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    t = docs.select("doc_id", retrieval.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


#: Query of the keyword leg: words and a phrase with boosts.
KEYWORDS = {"thand": 1.0, "tion": 2.0, "keit": 1.0, "of the": 3.0}


def _bm25_oracle(limit: int) -> str:
    t = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents"
    cols = ", ".join(
        f"(length(p) - length(replace(p, ' {w} ', ' '))) // {len(w) + 1} AS tf{i}" if " " in w else f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(KEYWORDS)
    )
    dfs = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(KEYWORDS)))
    score = " + ".join(f"{b}::DOUBLE * ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * 2.2::DOUBLE * tf{i} / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i, b in enumerate(KEYWORDS.values()))
    return f"""WITH c AS (SELECT doc_id, len(t) AS dl, {cols} FROM (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS p FROM ({t}))),
        g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {dfs} FROM c), s AS (SELECT doc_id, {score} AS score FROM c, g)
        SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {limit}"""


@query("bm25_topk", f"SELECT doc_id, rank, round(score, 4) AS score FROM ({_bm25_oracle(20)})")
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    top = retrieval.ranked(retrieval.bm25(docs, KEYWORDS), 0, 20, "doc_id")
    return top.select(F.col("provision_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(
    "rrf_hybrid",
    f"""WITH v AS (SELECT b.vec_id AS id, {SCORES} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, id LIMIT 15),
        l AS (SELECT 0 AS list_no, id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, score FROM v UNION ALL SELECT 1, doc_id, rank, score FROM ({_bm25_oracle(15)})),
        f AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS rrf, max(CASE WHEN list_no = 0 THEN score END) AS sim, min(list_no * 1000 + rank) AS first FROM l GROUP BY id)
        SELECT id AS provision_id, round(rrf, 6) AS rrf, round(rrf + 0.3::DOUBLE * coalesce(sim, 0::DOUBLE), 4) AS score FROM f ORDER BY score DESC, first LIMIT 30""",
)
def _(spark, d):
    docs, vectors = tables(spark, d, "documents", "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    lists = retrieval.ranked(retrieval.vector_top_k(vectors, q, 15), 0, 15, "vec_id").union(retrieval.ranked(retrieval.bm25(docs, KEYWORDS), 1, 15, "doc_id"))
    return retrieval.fuse(lists, (0,), 15).select("provision_id", F.round("rrf", 6).alias("rrf"), "score")


@query("phrase_matches", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(regexp_extract_all(b.text, '[^\\s]+')) >= 7")
def _(spark, d):
    docs, items = tables(spark, d, "documents", "benchmark")
    return retrieval.phrase_matches(docs, items)


@query("keyword_query_terms")
def _(spark, d):
    (messages,) = tables(spark, d, "conversations")
    return retrieval.keyword_query(messages.select("conv_id", "turn", "text")).drop("text")


def _chunks(spark, d) -> DataFrame:
    """The statutory corpus in chunks. They are not stored: what reads them takes the columns that it needs, where a document's lines have met."""
    return segment.chunks(statutory_corpus(spark, d))


# --- segmentation of the statutory corpus ----------------------------------------------------------------------------------------
LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"
PARTS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey, p_name, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey))"
SN = "'ORD' || o_orderkey"


@query(
    "seg_chunk_counts",
    f"""WITH l AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, count(*) AS n FROM {PARTS} GROUP BY 1)
        SELECT o_orderkey AS doc_id, 1 + coalesce(l.n, 0) AS n_articles, (coalesce(p.n, 0) + coalesce(l.n, 0) + coalesce(l.r, 0))::BIGINT AS n_paragraphs, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END::BIGINT AS n_recitals, (o_orderpriority = '1-URGENT')::BIGINT AS n_annexes
        FROM orders LEFT JOIN l ON o_orderkey = l.l_orderkey LEFT JOIN p ON o_orderkey = p.l_orderkey""",
)
def _(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("doc_id").agg(*[F.count(F.when(F.col("chunk_type") == k, 1)).alias(n) for k, n in (("article", "n_articles"), ("paragraph", "n_paragraphs"), ("recital", "n_recitals"), ("annex", "n_annexes"))])


@query(
    "seg_paragraphs",
    f"""SELECT 'ORD' || l_orderkey || ':art:1:para:' || k AS id, 'ORD' || l_orderkey || ':art:1' AS parent_id, '''' || p_name || ''' means part type ' || p_type || ' of brand ' || p_brand || ';' AS text FROM {PARTS}
        UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:1', 'ORD' || l_orderkey || ':art:' || (n + 1), 'The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' FROM {LINES}
        UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:2', 'ORD' || l_orderkey || ':art:' || (n + 1), 'Article 1 shall not apply to returned goods.' FROM {LINES} WHERE l_returnflag = 'R'""",
)
def _(spark, d):
    return _chunks(spark, d).where("chunk_type = 'paragraph'").select("id", "parent_id", "text")


@query(
    "seg_article_rollup_hash",
    f"""WITH a AS (SELECT l_orderkey, '1' AS num, string_agg(k || '. ''' || p_name || ''' means part type ' || p_type || ' of brand ' || p_brand || ';', chr(10) || chr(10) ORDER BY k) AS t FROM {PARTS} GROUP BY 1
            UNION ALL SELECT l_orderkey, (n + 1)::VARCHAR, '1. The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' || CASE WHEN l_returnflag = 'R' THEN chr(10) || chr(10) || '2. Article 1 shall not apply to returned goods.' ELSE '' END FROM {LINES}
            UNION ALL SELECT o_orderkey, '1', 'Definitions' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
        SELECT 'ORD' || l_orderkey || ':art:' || num AS id, sha256(t) AS content_hash FROM a""",
)
def _(spark, d):
    return _chunks(spark, d).where("chunk_type = 'article'").select("id", F.sha2("text", 256).alias("content_hash"))


@query("seg_cross_refs", f"SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:2' AS id, 'ORD' || l_orderkey || ':art:1' AS target FROM {LINES} WHERE l_returnflag = 'R'")
def _(spark, d):
    return _chunks(spark, d).select("id", F.explode("cross_references").alias("target"))


@query("seg_qualifications", f"SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS id, 'shall not apply,shall not' AS terms FROM {LINES} WHERE l_returnflag = 'R'")
def _(spark, d):
    c = _chunks(spark, d).where("has_qualifications AND chunk_type = 'article'")
    return c.select("id", F.array_join("qualification_terms", ",").alias("terms"))


@query(
    "seg_hierarchy",
    f"""WITH l AS (SELECT l_orderkey, n, 1 + (l_returnflag = 'R')::INT + 1 AS c FROM {LINES}), p AS (SELECT l_orderkey, count(*) AS c FROM {PARTS} GROUP BY 1)
        SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS parent_id, c::BIGINT AS n_children FROM l
        UNION ALL SELECT {SN} || ':art:1', (1 + coalesce(c, 0))::BIGINT FROM orders LEFT JOIN p ON o_orderkey = l_orderkey
        UNION ALL SELECT {SN} || ':root', 2 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT {SN} || ':annex:IV', 1 FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def _(spark, d):
    return segment.hierarchy(_chunks(spark, d)).select("parent_id", F.size("children").cast("long").alias("n_children"))


# --- metadata --------------------------------------------------------------------------------------------------------------------
@query(
    "meta_documents",
    """WITH t AS (SELECT *, coalesce(list_filter(list_transform(string_split_regex(text, '[\\n\\r\\x0B\\x0C]'), lambda x: trim(x)), lambda x: length(x) > 10 AND NOT starts_with(x, '—'))[1], 'Legal Document') AS title FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(regexp_replace(title, '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS ws, lower(title || ' ' || left(text, 1500)) AS low FROM t)
        SELECT doc_id, title, CASE WHEN len(ws) > 0 THEN upper(array_to_string(ws[1:4], '_')) ELSE 'LEGAL_DOC' END AS short_name,
        CASE WHEN contains(low, 'statute') OR contains(low, 'u.s.c.') OR contains(low, 'united states code') THEN 'statute' WHEN contains(low, 'contract') OR contains(low, 'agreement') OR contains(low, 'master services') THEN 'contract'
        WHEN contains(low, 'policy') THEN 'policy' WHEN contains(low, 'regulation') OR contains(low, 'cfr') OR contains(low, 'code of federal regulations') THEN 'regulation' WHEN contains(low, 'directive') THEN 'directive'
        WHEN contains(low, 'decision') THEN 'decision' WHEN contains(low, 'treaty') OR contains(low, 'convention') THEN 'treaty' WHEN contains(low, 'standard') OR contains(low, 'iso') OR contains(low, 'nist') THEN 'standard'
        WHEN contains(low, 'act') THEN 'act' ELSE 'legislation' END AS document_type FROM w""",
)
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    t = docs.withColumn("title", metadata.title(F.col("text"), F.lit("")))
    return t.select("doc_id", "title", metadata.short_name(F.col("title"), F.lit("")).alias("short_name"), metadata.document_type(F.col("text"), F.col("title")).alias("document_type"))


# --- semantics -------------------------------------------------------------------------------------------------------------------
FIRST_TERMS = f"(SELECT * FROM {PARTS} QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_name ORDER BY k) = 1)"


@query("sem_definitions", f"SELECT 'ORD' || l_orderkey || ':art:1' AS article_id, 'ORD' || l_orderkey || ':term:' || replace(p_name, ' ', '_') AS term_id, p_name AS term, 'part type ' || p_type || ' of brand ' || p_brand || ';' AS definition FROM {FIRST_TERMS}")
def _(spark, d):
    return semantics.definitions(_chunks(spark, d)).select("article_id", "term_id", "term", "definition")


@query(
    "sem_uses_term",
    f"""WITH t AS (SELECT l_orderkey AS o, p_name AS term FROM {FIRST_TERMS}), p AS (SELECT l_orderkey AS o, ':art:1:para:' || k AS id, p_name || ' means part type ' || p_type || ' of brand ' || p_brand AS s FROM {PARTS}
            UNION ALL SELECT l_orderkey, ':art:' || (n + 1) || ':para:1', 'units of ' || p_name || ' under' FROM {LINES})
        SELECT 'ORD' || p.o || p.id AS paragraph_id, 'ORD' || p.o || ':term:' || replace(term, ' ', '_') AS term_id FROM p JOIN t ON p.o = t.o AND contains(lower(p.s), lower(t.term))""",
)
def _(spark, d):
    c = _chunks(spark, d)
    return semantics.uses_term(c, semantics.definitions(c)).select("paragraph_id", "term_id")


@query("sem_roles", "SELECT o_orderkey AS doc_id, unnest(['Manufacturer', 'Authorised Representative', 'Importer', 'Distributor', 'Notified Body', 'Health Institution', 'Competent Authority']) AS name FROM orders")
def _(spark, d):
    return semantics.roles(_chunks(spark, d)).select("doc_id", "name")


@query(
    "sem_obligations",
    f"""SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':obl:1' AS obligation_id, 'shall' AS modality, 'The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' AS description, 'Manufacturer' AS role FROM {LINES}
        UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':obl:exemption_2', 'shall', 'Article 1 shall not apply to returned goods.', NULL FROM {LINES} WHERE l_returnflag = 'R'""",
)
def _(spark, d):
    return semantics.obligations(_chunks(spark, d)).select("obligation_id", "modality", "description", "role")


@query("sem_annex_refs", f"SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS article_id, 'ORD' || l_orderkey || ':annex:IV' AS annex_id FROM {LINES}")
def _(spark, d):
    return semantics.annex_references(_chunks(spark, d)).select("article_id", "annex_id")


@query("sem_domain", "SELECT o_orderkey AS doc_id, 'General Statutory / Regulatory Law' AS domain FROM orders")
def _(spark, d):
    return semantics.domains(_chunks(spark, d))


# --- graph -----------------------------------------------------------------------------------------------------------------------
ITEMS = "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"


@query(
    "graph_stats",
    f"""WITH s AS (SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer UNION ALL SELECT 'node', 'Document', count(*) FROM orders
            UNION ALL SELECT 'node', 'Article', count(*) FROM {ITEMS} UNION ALL SELECT 'edge', 'HAS_ARTICLE', count(*) FROM {ITEMS} UNION ALL SELECT 'edge', 'CONTAINS', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders))
        SELECT kind, name, n FROM s UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM s GROUP BY kind""",
)
def _(spark, d):
    return graph.stats(*order_graph(spark, d))


@query("graph_schema", "SELECT unnest(['label', 'label', 'label', 'label', 'label', 'relationship', 'relationship']) AS kind, unnest(['Region', 'Nation', 'Customer', 'Document', 'Article', 'CONTAINS', 'HAS_ARTICLE']) AS name")
def _(spark, d):
    return graph.schema_of(*order_graph(spark, d))


@query("graph_documents_list", "SELECT 'o:' || o_orderkey AS id, count(DISTINCT l_linenumber) AS n_articles FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, d):
    nodes, edges = order_graph(spark, d)
    return graph.listed(nodes.where("label = 'Document'").select("id"), edges, {"n_articles": "HAS_ARTICLE"})


@query(
    "graph_cascade_delete",
    """WITH gone AS (SELECT 'r:' || r_regionkey AS id FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
            UNION ALL SELECT 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
            UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)
        SELECT id FROM gone""",
)
def _(spark, d):
    nodes, edges = order_graph(spark, d)
    # a cycle back to the region must not keep the walk from ending
    cyclic = edges.union(edges.where("src_id = 'r:0'").select(F.col("dst_id").alias("src_id"), F.lit("CITES").alias("rel_type"), F.col("src_id").alias("dst_id")))
    return graph.cascade_delete(nodes, cyclic, nodes.where("id = 'r:0'"))[2]


@query(
    "graph_upsert_merge",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer
        UNION ALL SELECT max(c_custkey) + 1, 'New', NULL FROM customer""",
)
def _(spark, d):
    (customer,) = tables(spark, d, "customer")
    stored = customer.select("c_custkey", "c_name", "c_mktsegment")
    new = stored.select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).alias("c_mktsegment"))
    extra = customer.agg((F.max("c_custkey") + 1).alias("c_custkey")).select("c_custkey", F.lit("New").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return graph.upsert(stored, new.union(extra), "c_custkey")


@query(
    "graph_guarded_edges",
    "SELECT DISTINCT 'o:' || o_orderkey AS src_id, 'USES_TERM' AS rel_type, 'p:' || p_partkey AS dst_id FROM lineitem JOIN orders ON l_orderkey + 1 = o_orderkey JOIN part ON l_partkey + 5 = p_partkey",
)
def _(spark, d):
    lineitem, orders, part = tables(spark, d, "lineitem", "orders", "part")
    key = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    edges = lineitem.select(key("o:", F.col("l_orderkey") + 1).alias("src_id"), F.lit("USES_TERM").alias("rel_type"), key("p:", F.col("l_partkey") + 5).alias("dst_id"))
    return graph.guarded(edges, orders.select(key("o:", F.col("o_orderkey")).alias("id")), part.select(key("p:", F.col("p_partkey")).alias("id")))


@query(
    "graph_provision_context",
    """SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS parents, coalesce(string_agg(DISTINCT p_name || ': ' || p_type, '|' ORDER BY p_name || ': ' || p_type), '') AS terms
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_custkey""",
)
def _(spark, d):
    nodes, edges = order_graph(spark, d)
    lineitem, part = tables(spark, d, "lineitem", "part")
    p = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    uses = lineitem.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src_id"), F.lit("USES_TERM").alias("rel_type"), p("l_partkey").alias("dst_id")).distinct()
    texts = part.select(p("p_partkey").alias("id"), F.concat("p_name", F.lit(": "), "p_type").alias("text"))
    out = graph.context(nodes.where("label = 'Document'").select("id"), edges.union(uses), texts)
    return out.select("id", F.array_join("parents", "|").alias("parents"), F.array_join("terms", "|").alias("terms"))


@query("graph_cites", f"SELECT DISTINCT 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:2' AS src_id, 'ORD' || l_orderkey || ':art:1' AS dst_id FROM {LINES} WHERE l_returnflag = 'R'")
def _(spark, d):
    return graph.citations(_chunks(spark, d))


@query(
    "graph_extracted_edges",
    f"""SELECT 'HAS_ARTICLE' AS rel_type, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT 'HAS_RECITAL', 2 * count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'HAS_ANNEX', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'HAS_PARAGRAPH', (SELECT count(*) FROM {PARTS}) + (SELECT count(*) + sum((l_returnflag = 'R')::INT) FROM lineitem)::BIGINT UNION ALL SELECT 'DEFINES', count(*) FROM {FIRST_TERMS}
        UNION ALL SELECT 'IMPOSES', (count(*) + sum((l_returnflag = 'R')::INT))::BIGINT FROM lineitem UNION ALL SELECT 'APPLIES_TO', count(*) FROM lineitem
        UNION ALL SELECT 'REFERENCES_ANNEX', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'USES_TERM', count(*) FROM ({ORACLES["sem_uses_term"]})""",
)
def _(spark, d):
    return extract_graph(statutory_corpus(spark, d))["edges"].where("rel_type <> 'CITES'").groupBy("rel_type").agg(F.count("*").alias("n"))


# --- changes ---------------------------------------------------------------------------------------------------------------------
MUTATED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 1 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 13 = 0)"


def _mutated(docs: DataFrame) -> DataFrame:
    """A later version of the documents: some changed, some gone, some new."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    return docs.where("doc_id % 11 <> 1").select("doc_id", text.alias("text")).union(docs.where("doc_id % 13 = 0").select(-1 - F.col("doc_id"), "text"))


@query(
    "manifest_changes",
    f"SELECT n.doc_id AS id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'updated' END AS status FROM {MUTATED} n LEFT JOIN documents o ON n.doc_id = o.doc_id",
)
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    manifest = lambda x: x.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return changes.manifest_changes(manifest(docs), manifest(_mutated(docs))).select("id", "status")


@query(
    "doc_diff",
    f"""SELECT coalesce(o.doc_id, n.doc_id) AS number, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN sha256({WHITE.replace("text", "o.text")}) = sha256({WHITE.replace("text", "n.text")}) THEN 'unchanged' ELSE 'modified' END AS status,
        length(o.text) AS old_length, length(n.text) AS new_length FROM documents o FULL JOIN {MUTATED} n ON o.doc_id = n.doc_id""",
)
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    number = lambda x: x.select(F.col("doc_id").alias("number"), "text")
    return changes.article_diff(number(docs), number(_mutated(docs))).select("number", "status", F.col("old_length").cast("long"), F.col("new_length").cast("long"))


@query(
    "para_diff",
    f"""SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS article_id, '1' AS number, CASE WHEN n % 2 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM {LINES}
        UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1), '2', 'removed' FROM {LINES} WHERE l_returnflag = 'R' UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1), '3', 'added' FROM {LINES}""",
)
def _(spark, d):
    lines = order_lines(spark, d).withColumn("article_id", F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"), F.lit(":art:"), (F.col("n") + 1).cast("string")))
    first = F.concat(F.lit("Deliver "), "p_name", F.lit("."))
    old = lines.select("article_id", F.lit("1").alias("number"), first.alias("text")).union(lines.where("l_returnflag = 'R'").select("article_id", F.lit("2"), F.lit("Goods are returned.")))
    new = lines.select("article_id", F.concat(F.lit("1. "), first, F.when(F.col("n") % 2 == 0, " Soon.").otherwise(""), F.lit("\n3. A new rule.")).alias("text"))
    return changes.paragraph_diff(old, new).select("article_id", "number", "status")


@query(
    "merkle_rollup",
    "SELECT l_orderkey AS article_id, sha256(o_orderpriority || string_agg(h, '' ORDER BY h)) AS merkle FROM (SELECT l_orderkey, sha256(l_linenumber || ':' || l_partkey) AS h FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderpriority UNION ALL SELECT o_orderkey, sha256(o_orderpriority) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(spark, d):
    orders, lineitem = tables(spark, d, "orders", "lineitem")
    return changes.merkle(orders.select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("title")), lineitem.select(F.col("l_orderkey").alias("article_id"), F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")).alias("text")))


# --- evidence --------------------------------------------------------------------------------------------------------------------
@query(
    "evidence_budget",
    f"""WITH e AS (SELECT source, doc_id, n_chars, 30 + length(doc_id::VARCHAR) + 1 + CASE WHEN n_chars > 1500 THEN 1500 + {len(evidence.TRUNCATED)} ELSE n_chars END + 1 AS size FROM (SELECT source, doc_id, length(trim(text)) AS n_chars FROM documents))
        SELECT source, doc_id, size FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS total, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM e) WHERE total <= 7500 OR rn = 1""",
)
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    none = F.array().cast("array<string>")
    entry = evidence.evidence_entry(F.col("doc_id").cast("string"), F.lit(""), F.lit(""), F.col("text"), none, none)
    e = docs.select("source", "doc_id", F.length("text").alias("n_chars"), F.length(entry).cast("long").alias("size"))
    return evidence.within_budget(e, ["source"], [F.desc("n_chars"), F.col("doc_id")], F.col("size"), evidence.EVIDENCE_CHARS, True).select("source", "doc_id", "size")


@query(
    "history_trim",
    "SELECT conv_id, turn FROM (SELECT *, sum(length(text) // 4 + 10) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM conversations) WHERE total <= 250",
)
def _(spark, d):
    (messages,) = tables(spark, d, "conversations")
    return evidence.trim_history(messages, 250).select("conv_id", "turn")


@query(
    "intent_route",
    """WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS clean FROM conversations), b AS (SELECT *, regexp_replace(clean, '[!.,?]+$', '') AS bare FROM c), w AS (SELECT *, list_filter(string_split_regex(bare, '\\s+'), lambda x: x <> '') AS ws FROM b)
        SELECT conv_id, turn, CASE WHEN bare IN ('hi', 'hello', 'hey', 'good morning', 'good afternoon', 'good evening', 'greetings', 'hi there', 'hello there', 'howdy', 'thanks', 'thank you', 'bye', 'goodbye') OR (len(ws) <= 3 AND list_has_any(ws, ['hi', 'hello', 'hey', 'greetings'])) THEN 'greeting'
        WHEN contains(clean, 'upload') OR contains(clean, 'index') OR contains(clean, 'add document') OR contains(clean, 'parse pdf') THEN 'upload' WHEN contains(clean, 'diff') OR contains(clean, 'compare') OR contains(clean, 'difference') OR contains(clean, 'version') OR contains(clean, 'amendment') THEN 'diff' ELSE 'question' END AS intent FROM w""",
)
def _(spark, d):
    (messages,) = tables(spark, d, "conversations")
    return messages.select("conv_id", "turn", evidence.intent(F.col("text")).alias("intent"))


@query("citation_extract", f"SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS id, 'node' AS kind, 'ORD' || l_orderkey || ':art:' || (n + 1) AS citation FROM {LINES} UNION ALL SELECT 'ORD' || l_orderkey || ':art:' || (n + 1), 'act', 'Directive ' || l_linenumber || '/42/EC' FROM {LINES}")
def _(spark, d):
    lines = order_lines(spark, d).withColumn("id", F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"), F.lit(":art:"), (F.col("n") + 1).cast("string")))
    answers = lines.select("id", F.concat(F.lit("See ["), "id", F.lit("] and Directive "), F.col("l_linenumber").cast("string"), F.lit("/42/EC.")).alias("text"))
    return evidence.citations(answers, "id")


@query(
    "xref_expansion",
    """WITH l AS (SELECT l_orderkey, n, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS n FROM lineitem) WHERE n < 2)
        SELECT DISTINCT l_orderkey, 'article' AS kind, 'p' || l_partkey AS target FROM l UNION ALL SELECT DISTINCT l_orderkey, 'annex', 's' || l_suppkey FROM l""",
)
def _(spark, d):
    lines = order_lines(spark, d)
    tag = lambda p, c: F.array(F.concat(F.lit(p), F.col(c).cast("string")))
    hits = lines.select("l_orderkey", (F.col("n") - 1).alias("rank"), F.concat(F.lit("line"), F.col("n").cast("string")).alias("provision_id"), tag("p", "l_partkey").alias("cites"), tag("s", "l_suppkey").alias("annex_ids"))
    return evidence.expand_references(hits, "l_orderkey")


# --- windows over events (batch form of the streaming aggregation) ---------------------------------------------------------------
@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    (events,) = tables(spark, d, "events")
    return event_windows(events).withColumn("total", F.round("total", 2))
