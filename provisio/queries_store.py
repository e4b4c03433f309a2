"""Registered queries over the store: texts taken in by versions, reach, deletes, batches of questions. Each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.tables import shared_dir, written
from provisio.operators import changes, graph, reads
from provisio.operators.index import KeywordIndex, parse
from provisio.operators.retrieval import keyword_query, phrase_matches, vector_top_k_batch
from provisio.operators.vectors import VectorIndex, recall
from provisio.plans import typed
from provisio.plans.corpus import order_graph, statutory_corpus, tables, varied_corpus
from provisio.plans.provisions import order_provisions
from provisio.queries import FIRST_TERMS, LINES, ORACLES, PARTS, QUERIES, query
from provisio.queries_graph import ARTICLES, LN
from provisio.sources.store import GraphStore

#: Put at the end of each act's articles, so that no two acts are equal; and, in the second version, of every fifth one's.
NAMED, LATE = "\nArticle 901\nName\n1. This act is called %s.", "\nArticle 900\nLate goods\n1. The importer shall be told of late goods."


def _store(spark, d) -> GraphStore:
    """Two versions of the acts of all orders, taken in as files: five sixths of them, and then all, every fifth one with an article more."""
    store = GraphStore(spark, f"{shared_dir(spark)}/provisio-stores/{uuid.uuid4().hex}", buckets=16)
    acts = statutory_corpus(spark, d)
    name = F.format_string(NAMED, "short_name")
    for k, (rows, extra) in enumerate(((acts.where("doc_id % 6 <> 0"), name), (acts, F.when(F.col("doc_id") % 5 == 0, F.concat(name, F.lit(LATE))).otherwise(name)))):
        annex = F.lit("\nANNEX IV\n")
        text = F.when(F.contains("text", annex), F.replace("text", annex, F.concat(extra, annex))).otherwise(F.concat("text", extra))
        files = rows.select(F.concat("short_name", F.lit(".txt")).alias("filename"), text.alias("text")).withColumn("content_hash", F.sha2("text", 256))
        typed.ingest_files(store, files, ("orders", k))
    return store


COUNTED = f"""SELECT o_orderkey AS k, o_orderkey % 6 = 0 AS fresh, o_orderkey % 5 = 0 AS late, 2 + coalesce(l.n, 0) AS a, 1 + coalesce(p.n, 0) + coalesce(l.n, 0) + coalesce(l.r, 0) AS p, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS r
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1) l ON o_orderkey = l.l_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {PARTS} GROUP BY 1) p ON o_orderkey = p.l_orderkey"""


@query(
    "ingest_tables",
    f"""WITH late AS (SELECT 'ORD' || o_orderkey AS sn FROM orders WHERE o_orderkey % 5 = 0), a AS (
            SELECT l_orderkey AS o, '1' AS num, string_agg(k || '. ''' || p_name || ''' means part type ' || p_type || ' of brand ' || p_brand || ';', chr(10) || chr(10) ORDER BY k) AS t FROM {PARTS} GROUP BY 1
            UNION ALL SELECT l_orderkey, (n + 1)::VARCHAR, '1. The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' || CASE WHEN l_returnflag = 'R' THEN chr(10) || chr(10) || '2. Article 1 shall not apply to returned goods.' ELSE '' END FROM {LINES}
            UNION ALL SELECT o_orderkey, '1', 'Definitions' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, '901', '1. This act is called ORD' || o_orderkey || '.' FROM orders),
        t AS (SELECT 'Article' AS label, 'ORD' || o || ':art:' || num AS id, t AS content FROM a
        UNION ALL SELECT 'Article', sn || ':art:900', '1. The importer shall be told of late goods.' FROM late UNION ALL SELECT 'Paragraph', sn || ':art:900:para:1', 'The importer shall be told of late goods.' FROM late
        UNION ALL SELECT 'Paragraph', 'ORD' || o_orderkey || ':art:901:para:1', 'This act is called ORD' || o_orderkey || '.' FROM orders
        UNION ALL SELECT 'Paragraph', 'ORD' || l_orderkey || ':art:1:para:' || k, '''' || p_name || ''' means part type ' || p_type || ' of brand ' || p_brand || ';' FROM {PARTS}
        UNION ALL SELECT 'Paragraph', 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:1', 'The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' FROM {LINES}
        UNION ALL SELECT 'Paragraph', 'ORD' || l_orderkey || ':art:' || (n + 1) || ':para:2', 'Article 1 shall not apply to returned goods.' FROM {LINES} WHERE l_returnflag = 'R'
        UNION ALL SELECT 'Recital', 'ORD' || o_orderkey || ':recital:' || i, CASE i WHEN 1 THEN 'This order is open.' ELSE 'It shall be served in time.' END FROM orders, (SELECT unnest([1, 2]) AS i) WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'Annex', 'ORD' || o_orderkey || ':annex:IV', 'Urgent orders are served first.' FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'DefinedTerm', 'ORD' || l_orderkey || ':term:' || replace(p_name, ' ', '_'), 'part type ' || p_type || ' of brand ' || p_brand || ';' FROM {FIRST_TERMS}
        UNION ALL SELECT 'Obligation', 'ORD' || l_orderkey || ':art:' || (n + 1) || ':obl:1', 'The manufacturer shall deliver ' || l_quantity::INT || ' units of ' || p_name || ' under Annex IV.' FROM {LINES}
        UNION ALL SELECT 'Obligation', 'ORD' || l_orderkey || ':art:' || (n + 1) || ':obl:exemption_2', 'Article 1 shall not apply to returned goods.' FROM {LINES} WHERE l_returnflag = 'R'
        UNION ALL SELECT 'Obligation', sn || ':art:900:obl:1', 'The importer shall be told of late goods.' FROM late
        UNION ALL SELECT 'edges', rel, n::VARCHAR FROM (
            SELECT 'HAS_ONTOLOGY' AS rel, count(*) AS n FROM orders UNION ALL SELECT 'HAS_ARTICLE', 2 * (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM late)
            UNION ALL SELECT 'APPLIES_TO', (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM late) UNION ALL SELECT 'DEFINES', count(*) FROM {FIRST_TERMS}
            UNION ALL SELECT 'REFERENCES_ANNEX', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')
        UNION ALL SELECT 'Ingested', 'ORD' || k || '.txt', (a + late::INT) || ',' || (p::BIGINT + late::INT) || ',' || r || ',' || CASE
            WHEN fresh THEN 'new_document,Successfully indexed ''ORD' || k || ''': ' || (a + late::INT) || ' articles, ' || r || ' recitals, ' || (p::BIGINT + late::INT) || ' paragraphs with vector embeddings.'
            WHEN late THEN 'updated_document,Updated ''ORD' || k || ''': 0 articles modified, 1 articles added, ' || a || ' unchanged.' ELSE 'identical,Document ''ORD' || k || ''' already indexed with identical content.' END FROM ({COUNTED}))
        SELECT label, id, sha256(content) AS content FROM t""",
)
def _(spark, d):
    """All provisions, terms and obligations that the store has after both versions, numbers of edges, and what became of each file."""
    store = _store(spark, d)
    t, out = store.tables(), None
    said = {"Article": "full_text", "Paragraph": "text", "Recital": "text", "Annex": "text", "DefinedTerm": "definition", "Obligation": "description"}
    for label, text in said.items():
        rows = t[label].select(F.lit(label).alias("label"), "id", F.col(text).alias("content"))
        out = rows if out is None else out.union(rows)
    kinds = t["edges"].where(F.col("rel_type").isin("HAS_ONTOLOGY", "HAS_ARTICLE", "APPLIES_TO", "DEFINES", "REFERENCES_ANNEX")).groupBy("rel_type").agg(F.count("*").cast("string").alias("n"))
    log = store.table("Ingested").select(F.lit("Ingested"), "filename", F.concat_ws(",", "articles_count", "paragraphs_count", "recitals_count", "status", "message"))
    return out.union(kinds.select(F.lit("edges"), "rel_type", "n")).union(log).withColumn("content", F.sha2("content", 256))


@query(
    "store_delete_counters",
    f"""WITH o AS (SELECT o_orderkey AS o, o_orderstatus = 'O' AS open, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_orderkey % 10 = 0), l AS (SELECT x.*, o % 10 = 0 AS gone FROM {LN} x), g AS (SELECT l.*, open, urgent FROM l JOIN o USING (o)),
        n AS (SELECT count(*) + sum(CASE WHEN open THEN 2 ELSE 0 END) + sum(urgent::INT) AS n, sum(CASE WHEN open THEN 2 ELSE 0 END) + sum(urgent::INT) AS e FROM o),
        c AS (SELECT count(*) AS k FROM (SELECT DISTINCT o, f FROM g)), p AS (SELECT count(*) AS k FROM (SELECT p FROM l GROUP BY p HAVING bool_and(gone))), s AS (SELECT count(*) AS k FROM (SELECT s FROM l GROUP BY s HAVING bool_and(gone)))
        SELECT 0::BIGINT AS nodes_created, (SELECT n FROM n)::BIGINT + count(*) * 3 + sum((f = 'R')::INT)::BIGINT + (SELECT k FROM c) + (SELECT k FROM p) + (SELECT k FROM s) AS nodes_deleted, 0::BIGINT AS properties_set, 0::BIGINT AS relationships_created,
        (SELECT e FROM n)::BIGINT + (SELECT k FROM c) + count(*) * 6 + sum((f = 'R')::INT + (n > 1)::INT + urgent::INT + (open AND n <= 2)::INT)::BIGINT AS relationships_deleted FROM g""",
)
def _(spark, d):
    """The typed graph stored, every tenth order deleted with what no other order reaches: the five counters of that version."""
    store = GraphStore(spark, f"{shared_dir(spark)}/provisio-stores/{uuid.uuid4().hex}", buckets=16)
    store.commit({name: (df, None) for name, df in order_provisions(spark, d).items()})
    typed.delete_documents(store, store.table("Document").where("CAST(substring(id, 8) AS LONG) % 10 = 0").select("id"), keep_shared=True)
    return store.counters(1, 2)


@query(
    "graph_active_schema",
    f"""SELECT 'schema' AS kind, 'doc:P' || doc_id AS name, domain AS detail FROM ({ORACLES["varied_domains"]}) UNION ALL SELECT 'label', unnest(['Document', 'Article', 'Paragraph', 'Annex', 'ActorRole', 'Obligation', 'OntologySchema']), NULL
        UNION ALL SELECT 'relationship', unnest(['HAS_ARTICLE', 'HAS_PARAGRAPH', 'HAS_ANNEX', 'IMPOSES', 'APPLIES_TO', 'HAS_ONTOLOGY']), NULL""",
)
def _(spark, d):
    acts = varied_corpus(spark, d)
    return reads.active_schema(typed.typed_tables(acts.select("doc_id", "short_name", F.lit("Act").alias("title"), F.lit("regulation").alias("document_type"), F.sha2("text", 256).alias("content_hash"), "text")))


@query("diff_totals", f"SELECT count(*) FILTER (status = 'added') AS total_added, count(*) FILTER (status = 'removed') AS total_removed, count(*) FILTER (status = 'modified') AS total_modified, count(*) FILTER (status = 'unchanged') AS unchanged_count FROM ({ORACLES['diff_documents']})")
def _(spark, d):
    return changes.diff_totals(QUERIES["diff_documents"](spark, d))


# --- reach -----------------------------------------------------------------------------------------------------------------------
EDGES = """(SELECT 'r:' || n_regionkey AS s, 'n:' || n_nationkey AS t FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
    UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem)"""


@query(
    "graph_reach_pairs",
    f"""WITH RECURSIVE e AS MATERIALIZED {EDGES}, w AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS id, 0 AS hops FROM region UNION SELECT 'n:' || n_nationkey, 'n:' || n_nationkey, 0 FROM nation UNION SELECT root, t, hops + 1 FROM w JOIN e ON s = id)
        SELECT root, hops::BIGINT AS hops, count(*) AS nodes FROM w GROUP BY ALL""",
)
def _(spark, d):
    """Nodes by distance from each region and each nation, which regions reach too."""
    nodes, edges = order_graph(spark, d)
    pairs = graph.reach_pairs(edges, nodes.where("label IN ('Region', 'Nation')"))
    return pairs.groupBy("root", F.col("hops").cast("long").alias("hops")).agg(F.count("*").alias("nodes"))


@query(
    "graph_deep_articles",
    """SELECT 'r:' || n_regionkey AS document_id, 'l:' || l_orderkey || ':' || l_linenumber AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY l_linenumber::VARCHAR, 'l:' || l_orderkey || ':' || l_linenumber) - 1 AS rank
        FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, d):
    """Line items as articles of regions, four containers down."""
    nodes, edges = order_graph(spark, d)
    articles = nodes.where("label = 'Article'").select("id", F.element_at(F.split("id", ":"), -1).alias("number"))
    out = reads.document_articles({"edges": edges, "Document": nodes.where("label = 'Region'"), "Article": articles})
    return out.select("document_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "graph_exclusive_reach",
    f"""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_orderkey % 10 = 0 AS gone FROM {LINES}) SELECT 'order' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT 'line', count(*) FROM l WHERE gone UNION ALL SELECT 'part', count(*) AS n FROM (SELECT p FROM l GROUP BY p HAVING bool_and(gone)) HAVING count(*) > 0""",
)
def _(spark, d):
    """Every tenth order is to go, with its lines and the parts that no other order uses."""
    t = order_provisions(spark, d)
    edges = t["edges"].where("rel_type IN ('HAS_ARTICLE', 'USES_TERM') AND src_id NOT LIKE '%:chap:%'")
    gone = graph.exclusive_reach(edges, t["Document"].select("id"), t["Document"].where("CAST(substring(id, 8) AS LONG) % 10 = 0").select("id"))
    kind = F.when(F.col("id").startswith("doc:"), "order").when(F.col("id").startswith("term:"), "part").otherwise("line")
    return gone.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- batches of questions --------------------------------------------------------------------------------------------------------
def _article_index(spark, rows: DataFrame) -> KeywordIndex:
    """An index of articles in three segments: two thirds, the rest, and a second wording of those that end in 7."""
    index = KeywordIndex(spark, f"{shared_dir(spark)}/provisio-indexes/{uuid.uuid4().hex}")
    late = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) == 0
    index.add(rows.where(~late), "title", "full_text", batch=("load", 0))
    index.add(rows.where(late), "title", "full_text", batch=("load", 1))
    index.add(rows.where("id LIKE '%7'").withColumn("full_text", F.concat("full_text", F.lit(" Reworded part."))), "title", "full_text", batch=("load", 2))
    return index


@query(
    "search_batch",
    f"""WITH docs AS (SELECT id, regexp_extract_all(lower(title || ' ' || text || CASE WHEN id LIKE '%7' THEN ' Reworded part.' ELSE '' END), '[a-z0-9]+') AS t FROM {ARTICLES}), tok AS (SELECT id, len(t) AS dl, unnest(t) AS w, unnest(range(len(t))) AS pos FROM docs),
        q AS (SELECT p_partkey AS k, p_name, string_split(p_name, ' ') AS ws FROM part),
        c AS (SELECT DISTINCT k, w, 0.8::DOUBLE AS boost FROM (SELECT k, unnest(ws) AS w FROM q) WHERE length(w) >= 3 UNION ALL SELECT k, p_name, 3::DOUBLE FROM q),
        two AS (SELECT a.id, a.dl, a.w || ' ' || b.w AS w FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1), h AS (SELECT w, id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, dl, w FROM tok UNION ALL SELECT id, dl, w FROM two) WHERE w IN (SELECT w FROM c) GROUP BY w, id),
        g AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM docs), f AS (SELECT w, count(*) AS df FROM h GROUP BY w),
        s AS (SELECT k, id, sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM c JOIN h USING (w) JOIN f USING (w), g GROUP BY k, id)
        SELECT k AS question_id, rank, round(score, 4) AS score FROM (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score DESC) - 1 AS rank FROM s) WHERE rank < 5""",
)
def _(spark, d):
    """All parts as questions at once, over the articles of all orders; ranks and scores of the five best (which of equal ones is told first does not show)."""
    (part,) = tables(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("text"))
    index = _article_index(spark, order_provisions(spark, d)["Article"])
    top = index.top(parse(keyword_query(asked)), 5)
    return top.select("question_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("vector_cells", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, d):
    """Every fiftieth vector as query against all, by cells: whether nine tenths of the ten nearest of exact search are found."""
    (rows,) = tables(spark, d, "embeddings")
    rows = rows.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    index = VectorIndex(spark, f"{shared_dir(spark)}/provisio-vectors/{uuid.uuid4().hex}")
    index.add(rows)
    queries = rows.where("CAST(id AS LONG) % 50 = 0").select(F.col("id").cast("long").alias("question_id"), "embedding")
    exact = vector_top_k_batch(rows, queries, 10, "id", question="question_id")
    return recall(index.top(queries, 10), exact, 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "merkle_update",
    """WITH l AS (SELECT l_orderkey AS o, sha256(l_linenumber || ':' || l_partkey || CASE WHEN l_orderkey % 100 = 0 AND l_linenumber = 1 THEN ' late' ELSE '' END) AS h FROM lineitem),
        a AS (SELECT o_orderkey AS o, o_custkey AS c, sha256(any_value(o_orderpriority) || coalesce(string_agg(h, '' ORDER BY h), '')) AS h FROM orders LEFT JOIN l ON o = o_orderkey GROUP BY 1, 2)
        SELECT 'o:' || o AS id, h AS hash FROM a UNION ALL SELECT 'c:' || c_custkey, sha256(coalesce(string_agg(h, '' ORDER BY h), '')) FROM customer LEFT JOIN a ON c = c_custkey GROUP BY c_custkey""",
)
def _(spark, d):
    """Line items under orders under customers; the first lines of every hundredth order change, and the stored tree is updated along their paths."""
    customer, orders, lineitem = tables(spark, d, "customer", "orders", "lineitem")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    numbered = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")).cast("string")
    leaves = lineitem.select("l_orderkey", "l_linenumber", F.concat(name("l:", "l_orderkey"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(":"), numbered).alias("id"), name("o:", "l_orderkey").alias("parent_id"), text.alias("text"))
    tree = changes.merkle_tree(customer.select(name("c:", "c_custkey").alias("id")), orders.select(name("o:", "o_orderkey").alias("id"), name("c:", "o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("title")), leaves)
    tree = written(tree, "tree")
    late = leaves.where("l_orderkey % 100 = 0 AND l_linenumber = 1").select("id", "parent_id", F.concat("text", F.lit(" late")).alias("text"))
    return changes.merkle_merged(tree, changes.merkle_update(tree, late)).where("level <> 'paragraph'").select("id", "hash")


@query("phrase_matches_short", "SELECT doc_id, phrase FROM documents JOIN (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:n], ' ') AS phrase FROM benchmark, (SELECT unnest([1, 2, 4]) AS n) WHERE item_id % 10 = 0) ON contains(text, phrase)")
def _(spark, d):
    """The first word, two and four words of every tenth item as phrases, in all documents."""
    docs, items = tables(spark, d, "documents", "benchmark")
    words = items.where("item_id % 10 = 0").select(F.split("text", " ").alias("w"), F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("n"))
    phrases = words.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("text")).distinct().select(F.col("text").alias("item_id"), "text")
    return phrase_matches(docs, phrases).select("doc_id", F.col("item_id").alias("phrase"))
