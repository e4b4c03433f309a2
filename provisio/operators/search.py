"""Search over the typed graph: a stored keyword index, seven ranked lists, and hits with their context."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions.tables import written
from provisio.operators.retrieval import B, K1, fuse, ranked, tokens, vector_top_k

#: The lists in their order: name, label, whether by vectors.
LEGS = (
    ("paragraph", "Paragraph", True), ("article", "Article", True), ("annex", "Annex", True), ("recital", "Recital", True),
    ("article_ft", "Article", False), ("paragraph_ft", "Paragraph", False), ("annex_ft", "Annex", False),
)


def keyword_index(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings (token, id, dl, positions), sorted by token within files so that a question reads the row groups of its words, and norms (n, avgdl)."""
    text = F.concat_ws(" ", *columns)
    t = rows.select("id", tokens(text).alias("_t"))
    each = t.select("id", F.size("_t").alias("dl"), F.posexplode("_t").alias("pos", "token")).groupBy("id", "token").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    # ranges of (token, id), so that a token of a third of all rows is several tasks
    postings = written(each.repartitionByRange("token", "id").sortWithinPartitions("token", "id"), "postings")
    return postings, written(t.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl")), "norms")


def keyword_scores(index: tuple[DataFrame, DataFrame], terms: dict[str, float]) -> DataFrame:
    """id, score: BM25 of words and quoted phrases with boosts, from the postings of their words alone."""
    postings, norms = index
    split = {t: t.lower().strip('"').split() for t in terms}
    words = sorted({w for ws in split.values() for w in ws})
    own = postings.where(F.col("token").isin(*words))
    rows = own.groupBy("id").agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))  # a row a document, no more entries than words
    none = F.array().cast("array<int>")
    found = lambda w: F.coalesce(F.try_element_at("at", F.lit(w)), none)
    counts = []
    for k, ws in enumerate(split.values()):
        here = found(ws[0]) if ws else none
        for step, w in enumerate(ws[1:], 1):
            here = F.array_intersect(here, F.transform(found(w), _back(step)))
        counts.append(F.size(here).alias(f"tf{k}"))
    hits = written(rows.select("id", "dl", *counts), "hits")
    total = norms.first()
    seen = hits.agg(*[F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for k, boost in enumerate(terms.values()):
        df = seen[f"df{k}"] or 0
        idf = math.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
        tf = F.col(f"tf{k}")
        score = score + F.lit(boost * idf * (K1 + 1)) * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(total["avgdl"] or 1))))
    return hits.select("id", score.alias("score")).where("score > 0")


def _back(step: int):
    return lambda x: x - step


def indexed_columns(label: str) -> tuple[str, ...]:
    return {"Article": ("title", "full_text"), "Paragraph": ("text",), "Annex": ("title", "text")}[label]


def _clauses(spark: SparkSession, terms: dict[str, float]) -> DataFrame:
    """terms as the clauses of one question."""
    rows = [(0, " ".join(w), w, float(b)) for t, b in terms.items() if (w := t.lower().strip('"').split())]
    return spark.createDataFrame(rows, "question_id long, clause string, words array<string>, boost double")


def leg(graph: dict[str, DataFrame], name: str, vector: list[float], terms: dict[str, float], k: int, indexes: dict | None = None) -> DataFrame:
    """list_no, provision_id, rank, score of one list. Paragraphs without an article are dropped after the cut, so a list may be shorter than k.

    indexes: the stored keyword index of each label; without them one is made for this question.
    """
    no = [x[0] for x in LEGS].index(name)
    _, label, by_vector = LEGS[no]
    if by_vector:
        top = vector_top_k(graph[label].where("embedding IS NOT NULL"), vector, k, "id")
    elif indexes:
        top = indexes[label].top(_clauses(graph[label].sparkSession, terms), k).select("id", "score")
    else:
        top = keyword_scores(keyword_index(graph[label], *indexed_columns(label)), terms).orderBy(F.desc("score"), "id").limit(k)
    if label == "Paragraph":
        top = top.join(graph["edges"].where("rel_type = 'HAS_PARAGRAPH'").select(F.col("dst_id").alias("id")).distinct(), "id", "left_semi")
    return ranked(top, no, k, "id")


def hits_in_context(graph: dict[str, DataFrame], hits: DataFrame) -> DataFrame:
    """hits (provision_id, ...) with type, text, article_id, article_title, document, chapter_title, cited_articles and referenced_annexes.

    hits are few (their number is bounded by the lists), so each table is read once, filtered by what they name. What a hit has several of (documents,
    chapters) is the least by name; lists are distinct and sorted.
    """
    e = graph["edges"]
    few = lambda df: F.broadcast(df)  # noqa: E731  hits and what they lead to: a few rows a hit
    sort = lambda df: F.array_sort(F.collect_set(df))
    own = few(hits.select("provision_id").distinct())
    article = graph["Article"].join(own, F.col("id") == F.col("provision_id"), "left_semi").select(F.col("id").alias("provision_id"), F.lit("article").alias("type"), F.col("full_text").alias("text"), F.col("id").alias("article_id"), F.col("title").alias("own_title"))
    paragraph = graph["Paragraph"].join(own, F.col("id") == F.col("provision_id"), "left_semi").select(F.col("id").alias("provision_id"), F.lit("paragraph").alias("type"), "text")
    paragraph = paragraph.join(e.where("rel_type = 'HAS_PARAGRAPH'").select(F.col("dst_id").alias("provision_id"), F.col("src_id").alias("article_id")), "provision_id").withColumn("own_title", F.lit(None).cast("string")).select("provision_id", "type", "text", "article_id", "own_title")
    annex = graph["Annex"].join(own, F.col("id") == F.col("provision_id"), "left_semi").select("id", F.lit("annex"), "text", "id", "title")
    recital = graph["Recital"].join(own, F.col("id") == F.col("provision_id"), "left_semi").select("id", F.lit("recital"), "text", "id", F.concat(F.lit("Recital ("), F.coalesce("number", F.lit("")), F.lit(")")))
    found = written(article.union(paragraph).union(annex).union(recital), "found")
    ids = few(found.select("article_id").distinct())
    titles = graph["Article"].join(ids, F.col("id") == F.col("article_id"), "left_semi").select(F.col("id").alias("article_id"), F.col("title").alias("above_title"))
    docs = e.where(F.col("rel_type").isin("HAS_ARTICLE", "HAS_RECITAL", "HAS_ANNEX")).join(ids, F.col("dst_id") == F.col("article_id"), "left_semi").select(F.col("src_id"), F.col("dst_id").alias("article_id"))
    docs = written(docs, "above")
    document = graph["Document"].join(few(docs.withColumnRenamed("src_id", "id")), "id").groupBy("article_id").agg(F.min(F.coalesce("short_name", "title", F.lit(""))).alias("document"))
    chapter = graph["Chapter"].join(few(docs.withColumnRenamed("src_id", "id")), "id").groupBy("article_id").agg(F.min("title").alias("chapter_title"))
    lists = e.where(F.col("rel_type").isin("CITES", "REFERENCES_ANNEX")).join(ids, F.col("src_id") == F.col("article_id"), "left_semi").groupBy(F.col("src_id").alias("article_id")).agg(
        sort(F.when(F.col("rel_type") == "CITES", F.col("dst_id"))).alias("cited_articles"), sort(F.when(F.col("rel_type") == "REFERENCES_ANNEX", F.col("dst_id"))).alias("referenced_annexes")
    )
    out = hits.join(found, "provision_id")
    for side in (titles, document, chapter, lists):
        out = out.join(side, "article_id", "left")
    none = F.array().cast("array<string>")
    lists_of = lambda c: F.coalesce(F.col(c), none).alias(c)
    return out.select(
        *hits.columns, "type", "text", "article_id", F.coalesce("above_title", "own_title").alias("article_title"), F.coalesce("document", F.lit("")).alias("document"), F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), lists_of("cited_articles"), lists_of("referenced_annexes")
    )


def hybrid_search(graph: dict[str, DataFrame], vector: list[float], terms: dict[str, float], k: int = 15, indexes: dict | None = None) -> DataFrame:
    """rank, provision_id, rrf, score and context of the best provisions over all seven lists, which name the same ids; a list that a graph has no table for is left out.

    indexes as in leg().
    """
    lists = [leg(graph, name, vector, terms, k, indexes) for name, label, by_vector in LEGS if label in graph and (by_vector or terms)]
    every = lists[0]
    for x in lists[1:]:
        every = every.union(x)
    fused = written(fuse(written(every, "lists"), tuple(i for i, x in enumerate(LEGS) if x[2]), k), "fused")
    placed = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("rrf"), "provision_id")) - 1)  # max(2 k, 25) rows
    return hits_in_context(graph, placed)


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A vector for a text without any model: each word adds or subtracts one at a place by its hash; unit length, all 0 without words. The default where no
    embedding function is plugged in (Column to Column, such as an Arrow batch function)."""
    h = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    # the vector and its norm are bound once, as the elements of arrays of one
    one = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    sign = lambda x: F.when(F.floor(x / size) % 2 == 0, 1.0).otherwise(-1.0)
    sums = lambda words: F.transform(places, lambda i: F.aggregate(F.filter(words, lambda x: x % size == i), F.lit(0.0), lambda a, x: a + sign(x)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda v: one(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return one(h, lambda words: one(sums(words), unit))


def upsert_vectors(nodes: DataFrame, texts: DataFrame, embed=hash_embedding) -> DataFrame:
    """nodes with the vectors of texts (id, text) in place of their own; an id that no node has is an error, told by a row of status missing.

    Returns the nodes' columns with status: updated, unchanged or missing.
    """
    new = texts.select("id", embed(F.col("text")).cast("array<float>").alias("_v"), F.lit(True).alias("_new"))
    both = nodes.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    status = F.when(F.col("_old").isNull(), "missing").when(F.col("_new"), "updated").otherwise("unchanged")
    return both.withColumn("embedding", F.coalesce("_v", "embedding")).withColumn("status", status).select(*nodes.columns, "status")
