"""Registered queries over the typed graph: reads, search, taking in new versions, evidence. Each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from provisio.functions.tables import shared_dir, written, written_all
from provisio.operators import changes, evidence, graph, metadata, reads, search, segment, semantics
from provisio.operators.index import build_indexes
from provisio.plans import updates
from provisio.plans.corpus import SUBJECTS, SUPPLEMENTS, VERBS, order_lines, tables, varied_corpus
from provisio.plans.provisions import SCHEMAS, dealt_vectors, empty_tables, line_articles, line_paragraphs, order_provisions, provision_lines
from provisio.queries import LINES, SCORES, _chunks, query

LN = f"(SELECT l_orderkey AS o, n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, p_name, p_type, l_quantity::INT AS q, 'ORD' || l_orderkey AS sn, 'ORD' || l_orderkey || ':art:' || n AS art FROM {LINES})"
N_VECTORS = "(SELECT count(*) FROM embeddings)"
ARTICLES = f"(SELECT art AS id, n::VARCHAR AS number, 'Delivery ' || f AS title, 'Delivery of ' || p_name || ' as part ' || p || '.' AS text, p % {N_VECTORS} AS v, o, n, sn, f FROM {LN})"
PARAGRAPHS = f"""(SELECT art || ':para:1' AS id, '1' AS number, 'The supplier shall deliver ' || q || ' units of ' || p_name || '.' AS text, (p + s) % {N_VECTORS} AS v, art, sn, o, n FROM {LN}
    UNION ALL SELECT art || ':para:2', '2', 'Returned goods are exempt.', s % {N_VECTORS}, art, sn, o, n FROM {LN} WHERE f = 'R')"""
RECITALS = f"(SELECT 'ORD' || o_orderkey || ':recital:' || k AS id, k::VARCHAR AS number, 'Recital ' || k || ' of order ' || o_orderkey || '.' AS text, (o_orderkey + k) % {N_VECTORS} AS v, o_orderkey AS o, k FROM orders, (SELECT unnest([1, 2]) AS k) WHERE o_orderstatus = 'O')"
ANNEXES = f"(SELECT 'ORD' || o_orderkey || ':annex:IV' AS id, 'IV' AS number, 'Urgent orders' AS title, 'Order ' || o_orderkey || ' is urgent.' AS text, o_orderkey * 3 % {N_VECTORS} AS v, o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT')"


# --- reads -----------------------------------------------------------------------------------------------------------------------
@query("read_documents_found", "SELECT 'doc:ORD' || o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title FROM orders WHERE contains(o_orderpriority, 'URGENT')")
def _(spark, d):
    return reads.find_documents(order_provisions(spark, d)["Document"], title="URGENT").select("id", "title")


@query("read_document_by_name", "SELECT 'doc:ORD' || min(o_orderkey) AS id, sha256(min(o_orderkey) || min_by(o_orderstatus, o_orderkey)) AS content_hash FROM orders")
def _(spark, d):
    docs = order_provisions(spark, d)["Document"]
    (orders,) = tables(spark, d, "orders")
    return reads.find_document(docs, short_name=f"ORD{orders.agg(F.min('o_orderkey')).first()[0]}").select("id", "content_hash")


@query("read_documents_resolved", "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'ORD' ELSE 'doc:ORD' END || o_orderkey AS key, 'doc:ORD' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    (orders,) = tables(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    wanted = orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("none:"), k)).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ORD"), k)).otherwise(F.concat(F.lit("doc:ORD"), k)).alias("key"))
    return reads.resolve(order_provisions(spark, d)["Document"], wanted)


@query(
    "read_provisions",
    f"""WITH p AS (SELECT art, string_agg(text, '|' ORDER BY number, text) AS t FROM {PARAGRAPHS} GROUP BY art)
        SELECT id, 'Article' AS label, text, coalesce(t, '') AS paragraphs FROM {ARTICLES} LEFT JOIN p ON id = art UNION ALL SELECT id, 'Recital', text, '' FROM {RECITALS} UNION ALL SELECT id, 'Annex', text, '' FROM {ANNEXES}""",
)
def _(spark, d):
    return reads.with_paragraphs(order_provisions(spark, d)).select("id", "label", "text", F.array_join("paragraphs", "|").alias("paragraphs"))


@query(
    "read_provision_context",
    f"""SELECT art AS id, 'Order ' || o || ' ' || o_orderpriority AS parent_title, 'Chapter ' || f AS chapter_title, CASE WHEN o_orderstatus = 'O' AND n <= 2 THEN 'Recital ' || n || ' of order ' || o || '.' ELSE '' END AS recitals, CASE WHEN n > 1 THEN sn || ':art:1' ELSE '' END AS cited,
        CASE WHEN o_orderpriority = '1-URGENT' THEN sn || ':annex:IV' ELSE '' END AS annexes, p_name || ': ' || p_type AS terms, 'shall: Deliver ' || q || ' units.' AS obligations, s_name AS actors FROM {LN} JOIN orders ON o = o_orderkey JOIN supplier ON s = s_suppkey""",
)
def _(spark, d):
    out = reads.context(order_provisions(spark, d)).where("label = 'Article'")
    return out.select("id", "parent_title", "chapter_title", *[F.array_join(c, "|").alias(c) for c in ("recitals", "cited", "annexes", "terms", "obligations", "actors")])


@query("read_document_articles", f"SELECT 'doc:' || sn AS document_id, art AS id, row_number() OVER (PARTITION BY o ORDER BY n::VARCHAR, art) - 1 AS rank FROM {LN}")
def _(spark, d):
    return reads.document_articles(order_provisions(spark, d)).select("document_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "read_manifests",
    f"SELECT 'doc:' || sn AS document_id, 'article' AS kind, id, sha256(text) AS hash FROM {ARTICLES} UNION ALL SELECT 'doc:' || sn, 'paragraph', id, sha256(text) FROM {PARAGRAPHS} UNION ALL SELECT 'doc:ORD' || o, 'recital', id, text FROM {RECITALS}",
)
def _(spark, d):
    return reads.manifests(order_provisions(spark, d))


@query(
    "read_documents_listed",
    f"""SELECT 'doc:ORD' || o_orderkey AS id, coalesce(a, 0) AS n_articles, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END::BIGINT AS n_recitals, strftime(o_orderdate, '%Y-%m') AS month
        FROM orders LEFT JOIN (SELECT o, count(*) AS a FROM {LN} GROUP BY o) ON o = o_orderkey""",
)
def _(spark, d):
    t = order_provisions(spark, d)
    out = graph.listed(t["Document"].select("id", F.date_format("publication_date", "yyyy-MM").alias("month")), t["edges"], {"n_articles": "HAS_ARTICLE", "n_recitals": "HAS_RECITAL"})
    return out.select("id", "n_articles", "n_recitals", "month")


@query("read_by_sql", f"SELECT f AS number, count(*) AS n FROM {LN} WHERE n >= 2 GROUP BY f")
def _(spark, d):
    t = order_provisions(spark, d)
    sql = "SELECT c.number, count(*) AS n FROM chapters c JOIN graph_edges e ON c.id = e.src_id JOIN articles a ON a.id = e.dst_id WHERE CAST(a.number AS INT) >= :least GROUP BY c.number"
    return reads.query_views(spark, sql, {"least": 2}, chapters=t["Chapter"], graph_edges=t["edges"], articles=t["Article"])


@query("graph_typed_stats", f"SELECT 'Article' AS name, count(*) AS n FROM {LN} UNION ALL SELECT 'Annex', count(*) FROM {ANNEXES} UNION ALL SELECT 'Recital', count(*) FROM {RECITALS} UNION ALL SELECT 'Paragraph', count(*) FROM {PARAGRAPHS} UNION ALL SELECT 'OntologySchema', 0")
def _(spark, d):
    """Counts of typed tables beside an empty one of the declared schemas."""
    t = {**empty_tables(spark), **order_provisions(spark, d)}
    assert set(SCHEMAS) == set(t)
    out = None
    for name in ("Article", "Annex", "Recital", "Paragraph", "OntologySchema"):
        row = t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


# --- search ----------------------------------------------------------------------------------------------------------------------
#: Words and a phrase with boosts.
TERMS = {"supplier": 1.0, "units of": 3.0, "exempt": 2.0, "urgent": 1.5, "delivery": 1.0, "red": 2.0}
VECTOR = f"(SELECT b.vec_id, {SCORES} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)"


def _vector_leg(source: str, k: int = 15) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, score FROM {source} JOIN {VECTOR} ON v = vec_id ORDER BY score DESC, id LIMIT {k}"


def _keyword_leg(source: str, text: str, k: int = 15) -> str:
    cols = ", ".join(f"(length(p) - length(replace(p, ' {w} ', ' '))) // {len(w) + 1} AS tf{i}" if " " in w else f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
    dfs = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"{b}::DOUBLE * ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * 2.2::DOUBLE * tf{i} / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i, b in enumerate(TERMS.values()))
    return f"""WITH c AS (SELECT id, len(t) AS dl, {cols} FROM (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS p FROM (SELECT id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {source}))),
        g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {dfs} FROM c), s AS (SELECT id, {score} AS score FROM c, g)
        SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT {k}"""


LEG_SQL = {
    "paragraph": _vector_leg(PARAGRAPHS), "article": _vector_leg(ARTICLES), "annex": _vector_leg(ANNEXES), "recital": _vector_leg(RECITALS),
    "article_ft": _keyword_leg(ARTICLES, "title || ' ' || text"), "paragraph_ft": _keyword_leg(PARAGRAPHS, "text"), "annex_ft": _keyword_leg(ANNEXES, "title || ' ' || text"),
}


def _question(spark, d) -> list[float]:
    (vectors,) = tables(spark, d, "embeddings")
    return vectors.where("vec_id = 0").first()["embedding"]


def _leg(name: str) -> None:
    @query(f"search_{name}", f"SELECT id, rank, round(score, 4) AS score FROM ({LEG_SQL[name]})")
    def _(spark, d):
        out = search.leg(order_provisions(spark, d), name, _question(spark, d), TERMS, 15)
        return out.select(F.col("provision_id").alias("id"), F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


for _name in LEG_SQL:
    _leg(_name)

LISTS = " UNION ALL ".join(f"SELECT {i} AS list_no, id, rank, score FROM ({sql})" for i, sql in enumerate(LEG_SQL.values()))


@query(
    "hybrid_search",
    f"""WITH l AS ({LISTS}), f AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS rrf, max(CASE WHEN list_no < 4 THEN score END) AS sim, min(list_no * 1000 + rank) AS first FROM l GROUP BY id),
        b AS (SELECT id, round(rrf + 0.3::DOUBLE * coalesce(sim, 0::DOUBLE), 4) AS score FROM f ORDER BY round(rrf + 0.3::DOUBLE * coalesce(sim, 0::DOUBLE), 4) DESC, first LIMIT 30),
        c AS (SELECT id, 'article' AS type, id AS article_id, title AS article_title, sn AS document, 'Chapter ' || f AS chapter_title, CASE WHEN n > 1 THEN sn || ':art:1' ELSE '' END AS cited, o FROM {ARTICLES}
            UNION ALL SELECT p.id, 'paragraph', p.art, a.title, p.sn, 'Chapter ' || a.f, CASE WHEN p.n > 1 THEN p.sn || ':art:1' ELSE '' END, p.o FROM {PARAGRAPHS} p JOIN {ARTICLES} a ON p.art = a.id
            UNION ALL SELECT id, 'annex', id, title, 'ORD' || o, '', '', NULL FROM {ANNEXES} UNION ALL SELECT id, 'recital', id, 'Recital (' || number || ')', 'ORD' || o, '', '', NULL FROM {RECITALS})
        SELECT b.id AS provision_id, score, type, article_id, article_title, document, chapter_title, cited AS cited_articles, CASE WHEN o_orderpriority = '1-URGENT' THEN document || ':annex:IV' ELSE '' END AS referenced_annexes
        FROM b JOIN c ON b.id = c.id LEFT JOIN orders ON o = o_orderkey""",
)
def _(spark, d):
    t = written_all(order_provisions(spark, d))
    indexes = build_indexes(spark, f"{shared_dir(spark)}/provisio-indexes/{uuid.uuid4().hex}", t)
    out = search.hybrid_search(t, _question(spark, d), TERMS, indexes=indexes)
    return out.select("provision_id", "score", "type", "article_id", "article_title", "document", "chapter_title", F.array_join("cited_articles", "|").alias("cited_articles"), F.array_join("referenced_annexes", "|").alias("referenced_annexes"))


@query(
    "embed_messages",
    """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), h AS (SELECT conv_id, turn, ('0x' || md5(w)[1:8])::BIGINT AS h FROM t),
        s AS (SELECT conv_id, turn, h % 64 AS dim, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL)
        SELECT s.conv_id, s.turn, dim, round(v / norm, 5) AS value FROM s JOIN n ON s.conv_id = n.conv_id AND s.turn = n.turn WHERE v <> 0""",
)
def _(spark, d):
    (messages,) = tables(spark, d, "conversations")
    e = messages.select("conv_id", "turn", F.posexplode(search.hash_embedding(F.col("text"))).alias("dim", "value"))
    return e.where("value <> 0").select("conv_id", "turn", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


@query("vector_upsert", "SELECT CASE WHEN v.vec_id IS NULL THEN 'missing' WHEN c.conv_id IS NULL THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM embeddings v FULL JOIN (SELECT DISTINCT conv_id FROM conversations) c ON v.vec_id = c.conv_id GROUP BY 1")
def _(spark, d):
    vectors, messages = tables(spark, d, "embeddings", "conversations")
    texts = messages.groupBy(F.col("conv_id").alias("id")).agg(F.min("text").alias("text"))
    return search.upsert_vectors(vectors.select(F.col("vec_id").alias("id"), "embedding"), texts).groupBy("status").agg(F.count("*").alias("n"))


# --- taking in new versions ------------------------------------------------------------------------------------------------------
def _versions(spark, d) -> tuple[dict, dict]:
    """The stored graph, and new versions of all documents: every third article has another text, every fifth act one article more, some recitals changed."""
    lines = provision_lines(spark, d)
    t = order_provisions(spark, d, lines)
    act = F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"))
    document = F.concat(F.lit("doc:"), act).alias("document_id")
    articles = line_articles(lines).select("id", "number", "title", F.when(F.col("n") % 3 == 0, F.concat("full_text", F.lit(" Amended."))).otherwise(F.col("full_text")).alias("full_text"), document)
    more = lines.where("n = 1 AND l_orderkey % 5 = 0").select(F.concat(act, F.lit(":art:new")).alias("id"), F.lit("new").alias("number"), F.lit("New").alias("title"), F.lit("A new article.").alias("full_text"), F.concat(F.lit("doc:"), act).alias("document_id"))
    articles = articles.unionByName(more).withColumn("content_hash", F.sha2("full_text", 256)).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("parent_id", F.col("document_id"))
    said = F.when((F.col("n") % 2 == 0) & (F.col("number") == "1"), F.concat("text", F.lit(" Soon."))).otherwise(F.col("text"))
    para = line_paragraphs(lines).select("parent_id", "id", "number", said.alias("text"), document).withColumn("content_hash", F.sha2("text", 256)).withColumn("embedding", F.lit(None).cast("array<float>"))
    order = F.regexp_extract("id", "^ORD([0-9]+):", 1).cast("long")
    recitals = t["Recital"].withColumn("text", F.when(order % 4 == 0, F.concat("text", F.lit(" Again."))).otherwise(F.col("text"))).withColumn("document_id", F.concat(F.lit("doc:ORD"), order.cast("string"))).withColumn("parent_id", F.col("document_id"))
    lost = t["Recital"].limit(1).select(F.lit("lost").alias("id"), "number", "text", "embedding", F.lit("doc:none").alias("document_id"), F.lit("doc:none").alias("parent_id"))
    return t, {"Article": articles, "Paragraph": para, "Recital": recitals.unionByName(lost)}


COUNTS = f"""SELECT o_orderkey, coalesce(max(aa), 0) AS aa, coalesce(max(au), 0) AS au, coalesce(max(an), 0) AS an, coalesce(max(pu), 0) AS pu, coalesce(max(pn), 0) AS pn FROM orders
    LEFT JOIN (SELECT o, max((o % 5 = 0)::INT) AS aa, sum((n % 3 = 0)::INT) AS au, sum((n % 3 <> 0)::INT) AS an, sum((n % 2 = 0)::INT) AS pu, sum((n % 2 <> 0)::INT + (f = 'R')::INT) AS pn FROM {LN} GROUP BY o) ON o = o_orderkey GROUP BY o_orderkey"""


@query(
    "update_counters",
    f"""WITH c AS ({COUNTS}), r AS (SELECT c.*, CASE WHEN o_orderstatus = 'O' AND c.o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS ru, CASE WHEN o_orderstatus = 'O' AND c.o_orderkey % 4 <> 0 THEN 2 ELSE 0 END AS rn FROM c JOIN orders ON c.o_orderkey = orders.o_orderkey)
        SELECT 'doc:ORD' || o_orderkey AS document_id, aa::BIGINT AS articles_added, au::BIGINT AS articles_updated, an::BIGINT AS articles_unchanged, pu::BIGINT AS paragraphs_updated, pn::BIGINT AS paragraphs_unchanged, ru::BIGINT AS recitals_updated, rn::BIGINT AS recitals_unchanged,
        'Updated ''ORD' || o_orderkey || ''': ' || CASE WHEN au + aa + ru = 0 THEN 'All provisions were unchanged' ELSE concat_ws('; ', CASE WHEN au + aa > 0 THEN au::INT || ' articles modified, ' || aa::INT || ' articles added, ' || an::INT || ' unchanged' END, CASE WHEN ru > 0 THEN ru || ' recitals modified, 0 recitals added, ' || rn || ' unchanged' END) END || '.' AS message FROM r""",
)
def _(spark, d):
    stored, new = _versions(spark, d)
    documents = stored["Document"].select(F.col("id").alias("document_id"), "short_name", F.lit(True).alias("existing"))
    out = updates.counters(updates.changed(stored, new), documents)
    return out.select("document_id", "articles_added", "articles_updated", "articles_unchanged", "paragraphs_updated", "paragraphs_unchanged", "recitals_updated", "recitals_unchanged", "message")


@query(
    "update_tables",
    f"""SELECT id, text FROM (SELECT id, text || CASE WHEN n % 3 = 0 THEN ' Amended.' ELSE '' END AS text FROM {ARTICLES} UNION ALL SELECT DISTINCT sn || ':art:new', 'A new article.' FROM {LN} WHERE o % 5 = 0
            UNION ALL SELECT id, text || CASE WHEN n % 2 = 0 AND number = '1' THEN ' Soon.' ELSE '' END FROM {PARAGRAPHS} UNION ALL SELECT id, text || CASE WHEN o % 4 = 0 THEN ' Again.' ELSE '' END FROM {RECITALS})""",
)
def _(spark, d):
    out = updates.take_in(*_versions(spark, d))
    return out["Article"].select("id", F.col("full_text").alias("text")).union(out["Paragraph"].select("id", "text")).union(out["Recital"].select("id", "text"))


@query(
    "update_write_counters",
    f"SELECT (SELECT count(DISTINCT o) FROM {LN} WHERE o % 5 = 0) AS nodes_created, (SELECT count(*) * 4 FROM {LN}) + (SELECT count(DISTINCT o) * 4 FROM {LN} WHERE o % 5 = 0) AS properties_set, (SELECT count(DISTINCT o) FROM {LN} WHERE o % 5 = 0) AS relationships_created",
)
def _(spark, d):
    stored, new = _versions(spark, d)
    return updates.upsert_below(stored["Article"], stored["edges"], stored["Document"], new["Article"], "HAS_ARTICLE")[2].select("nodes_created", F.col("properties_set").cast("long"), "relationships_created")


@query(
    "diff_documents",
    f"""WITH o AS (SELECT * FROM {ARTICLES}), n AS (SELECT id, title, text || CASE WHEN n % 3 = 0 THEN ' Amended.' ELSE '' END AS text, v FROM o WHERE n % 4 <> 0 UNION ALL SELECT DISTINCT sn || ':art:new', 'New', 'A new article.', NULL FROM o WHERE o.o % 5 = 0),
        s AS (SELECT a.vec_id, {SCORES} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % {N_VECTORS}), m AS (SELECT coalesce(o.id, n.id) AS number, o.id AS id, coalesce(n.title, o.title) AS title, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.text = n.text THEN 'unchanged' ELSE 'modified' END AS status, o.v FROM o FULL JOIN n ON o.id = n.id)
        SELECT number, id, title, status, CASE WHEN status = 'modified' THEN round(score, 4) END AS similarity, CASE WHEN status <> 'modified' THEN NULL WHEN round(score, 4) >= 0.95 THEN 'formatting_or_minor' WHEN round(score, 4) >= 0.8 THEN 'moderate' ELSE 'major_rewrite' END AS change_level FROM m LEFT JOIN s ON m.v = s.vec_id""",
)
def _(spark, d):
    lines = line_articles(provision_lines(spark, d))
    (vectors,) = tables(spark, d, "embeddings")
    few, n_vectors = dealt_vectors(vectors.select("vec_id", "embedding"))
    at = F.pmod(F.col("l_partkey"), F.lit(n_vectors))
    old = lines.withColumn("embedding", at).join(few.select(F.col("vec_id").alias("embedding")), "embedding", "left_semi").select("id", F.col("id").alias("number"), "title", F.col("full_text").alias("text"), "embedding")
    new = lines.where("n % 4 <> 0").withColumn("embedding", F.pmod(at + 1, F.lit(n_vectors))).join(few.select(F.col("vec_id").alias("embedding")), "embedding", "left_semi")
    new = new.select(F.col("id").alias("number"), "title", F.when(F.col("n") % 3 == 0, F.concat("full_text", F.lit(" Amended."))).otherwise(F.col("full_text")).alias("text"), "embedding")
    more = lines.where("n = 1 AND l_orderkey % 5 = 0").select(F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"), F.lit(":art:new")).alias("number"), F.lit("New").alias("title"), F.lit("A new article.").alias("text"), F.lit(None).cast("long").alias("embedding"))
    return changes.article_diff(old, new.union(more), few).select("number", "id", "title", "status", "similarity", "change_level")


@query("diff_paragraph_levels", f"SELECT art AS article_id, '1' AS number, 'modified' AS status, round(score, 4) AS similarity, CASE WHEN round(score, 4) >= 0.95 THEN 'minor_edit' WHEN round(score, 4) >= 0.8 THEN 'moderate_change' ELSE 'substantive_revision' END AS change_level FROM (SELECT art, (p + s) % {N_VECTORS} AS v FROM {LN}) JOIN {VECTOR} ON v = vec_id")
def _(spark, d):
    t = order_provisions(spark, d)
    question = F.array(*[F.lit(float(x)) for x in _question(spark, d)]).cast("array<float>")
    old = t["Paragraph"].where("number = '1'").select(F.regexp_extract("id", "^(.*):para:", 1).alias("article_id"), "number", "text", "embedding")
    new = old.select("article_id", F.concat(F.lit("1. "), "text", F.lit(" More.")).alias("text"), F.create_map(F.lit("1"), question).alias("embeddings"))
    return changes.paragraph_diff(old, new)


# --- evidence and wrappers -------------------------------------------------------------------------------------------------------
@query(
    "evidence_bundle",
    f"""WITH r AS (SELECT o, art, sn, 'Delivery of ' || p_name || ' as part ' || p || '.' AS t, CASE WHEN n % 2 = 0 THEN q ELSE 0 END AS score, n FROM {LN}), e AS (SELECT *, '=== PROVISION: ' || art || ' | ' || sn || ' ===' || chr(10) || t || chr(10) AS entry FROM r)
        SELECT o AS question, string_agg(entry, chr(10) ORDER BY score DESC, n) AS bundle FROM (SELECT *, sum(length(entry)) OVER (PARTITION BY o ORDER BY score DESC, n) AS total, row_number() OVER (PARTITION BY o ORDER BY score DESC, n) AS rn FROM e) WHERE total <= 7500 OR rn = 1 GROUP BY o""",
)
def _(spark, d):
    lines = order_lines(spark, d)
    act = F.concat(F.lit("ORD"), F.col("l_orderkey").cast("string"))
    score = F.when(F.col("n") % 2 == 0, F.col("l_quantity"))
    record = F.struct(F.concat(act, F.lit(":art:"), F.col("n").cast("string")).alias("provision_id"), act.alias("document"), F.concat(F.lit("Delivery of "), "p_name", F.lit(" as part "), F.col("l_partkey").cast("string"), F.lit(".")).alias("text"), score.alias("score"))
    outputs = lines.groupBy(F.col("l_orderkey").alias("question")).agg(F.to_json(F.struct(F.lit("success").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("n", record.alias("r")))), lambda x: x["r"]).alias("data"))).alias("output"))
    return evidence.bundles(evidence.records(outputs, "question", "output"), "question")


@query("meta_structure_json", "SELECT doc_id, json_object('source', source, 'lang', lang, 'doc_id', doc_id)::VARCHAR AS record FROM documents")
def _(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.select("doc_id", metadata.as_json("source", "lang", "doc_id").alias("record"))


@query("seg_chunks_json", f"SELECT 'ORD' || l_orderkey || ':art:' || (n + 1) AS id, json_object('id', 'ORD' || l_orderkey || ':art:' || (n + 1), 'chunk_type', 'article', 'number', (n + 1)::VARCHAR)::VARCHAR AS record FROM {LINES} UNION ALL SELECT 'ORD' || o_orderkey || ':art:1', json_object('id', 'ORD' || o_orderkey || ':art:1', 'chunk_type', 'article', 'number', '1')::VARCHAR FROM orders")
def _(spark, d):
    return _chunks(spark, d).where("chunk_type = 'article'").select("id", metadata.as_json("id", "chunk_type", "number").alias("record"))


@query("sem_ontology", "SELECT 'doc:ORD' || o_orderkey AS document_id, 'General Statutory / Regulatory Law' AS domain, 7 AS n_types, 'Autonomous legal ontology discovered for ORD' || o_orderkey || ' (General Statutory / Regulatory Law).' AS description FROM orders")
def _(spark, d):
    rows = semantics.ontology(_chunks(spark, d)).select("document_id", "domain", F.size("node_types").alias("n_types"), "description")
    stored = rows.where("1 = 0")
    return graph.upsert(stored, rows, "document_id")


@query(
    "sem_terms_longest_first",
    "SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, k) - 1 AS rank FROM (SELECT l_orderkey AS doc_id, p_name AS term, min(l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
)
def _(spark, d):
    terms = semantics.definitions(_chunks(spark, d))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("term")), "ord", "pattern", "pos")
    return terms.select("doc_id", "term", (F.row_number().over(order) - 1).cast("long").alias("rank"))


@query("sem_defining_articles", f"SELECT 'ORD' || l_orderkey || ':term:' || replace(p_name, ' ', '_') AS term_id, 'ORD' || l_orderkey || ':art:1' AS first_article, 'ORD' || l_orderkey || ':art:1' AS last_article FROM (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)")
def _(spark, d):
    return semantics.first_and_last(semantics.definitions(_chunks(spark, d)), "term_id", "article_id", "ord")



# --- acts of many shapes ---------------------------------------------------------------------------------------------------------
def _pick(words) -> str:
    return f"[{', '.join(f"'{w}'" for w in words)}][p_partkey % {len(words)} + 1]"


VARIED = f"""(SELECT p_partkey AS k, 'P' || p_partkey AS sn, 'Quality Auditor ' || {_pick(VERBS)} || ' inspect all ' || {_pick(SUBJECTS)} || ' of ' || p_brand || '.' AS body, 'Records are kept ' || {_pick(segment.QUALIFIERS)} || ' by law.' AS rule, {_pick(SUPPLEMENTS)} AS extra FROM part)"""


def _varied(spark, d):
    return written(segment.chunks(varied_corpus(spark, d)), "varied")


@query(
    "varied_chunks",
    f"""WITH c AS (SELECT sn || ':art:1' AS id, 'article' AS chunk_type, 'Scope' AS title, 'Scope' || chr(10) || chr(10) || body || chr(10) || chr(10) || '1. ' || rule AS text FROM {VARIED} UNION ALL SELECT sn || ':art:1:para:1', 'paragraph', 'Paragraph 1', rule FROM {VARIED}
            UNION ALL SELECT sn || ':annex:' || string_split(extra, ' ')[2], 'annex', 'Lists', 'A list of parts.' FROM {VARIED} WHERE extra <> '')
        SELECT id, chunk_type, title, text, array_to_string(list_filter([{', '.join(f"'{q}'" for q in segment.QUALIFIERS)}], lambda x: contains(lower(text), x)), ',') AS terms FROM c""",
)
def _(spark, d):
    return _varied(spark, d).select("id", "chunk_type", "title", "text", F.array_join("qualification_terms", ",").alias("terms"))


@query("varied_domains", "SELECT p_partkey AS doc_id, ['Medical & Healthcare Regulation', 'Data Protection & Privacy', 'Artificial Intelligence & Technology Regulation', 'Intellectual Property Law', 'Financial & Securities Regulation', 'Commercial Contract / Licensing', 'General Statutory / Regulatory Law'][p_partkey % 7 + 1] AS domain FROM part")
def _(spark, d):
    return semantics.domains(_varied(spark, d))


@query("varied_roles", "SELECT p_partkey AS doc_id, 'role:scope_quality_auditor' AS role_id, 'Scope' || chr(10) || chr(10) || 'Quality Auditor' AS name, 7::BIGINT AS rank FROM part")
def _(spark, d):
    return semantics.roles(_varied(spark, d)).where("rank >= 7").select("doc_id", "role_id", "name", F.col("rank").cast("long").alias("rank"))


@query(
    "varied_first_obligations",
    f"SELECT sn || ':art:1' AS article_id, sn || ':art:1:obl:1' AS obligation_id, CASE k % 3 WHEN 0 THEN 'shall' WHEN 1 THEN 'must' ELSE 'may' END AS modality, 'Scope' || chr(10) || chr(10) || 'Quality Auditor' AS role, 'Scope' || chr(10) || chr(10) || body AS description FROM {VARIED}",
)
def _(spark, d):
    return semantics.obligations(_varied(spark, d)).where("pos = 0").select("article_id", "obligation_id", "modality", "role", "description")
