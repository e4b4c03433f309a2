"""Retrieval: exact vector search, BM25 keyword search with phrases and boosts, rank fusion, keyword query building."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.tables import written
from provisio.functions.text import cosine, strip

K1, B, RRF_CONSTANT, VECTOR_WEIGHT = 1.2, 0.75, 60, 0.3
#: Queries in one block of a batch search; a block is what is broadcast.
QUERY_BLOCK = 2048
WORD = "[a-z0-9]+"
#: Characters by which phrases of one or two words are looked up.
SHORT_CHARS = 8

#: Boosted phrases, actors, patterns of references and words that are no keywords.
REFERENCE_PATTERNS = (
    r"(?iu)\b(?:article|art\.?)\s+\d+[a-z]?\b",
    r"(?iu)\b(?:section|sec\.?)\s+\d+[a-z]?\b",
    r"(?iu)\b(?:annex|schedule|appendix|exhibit)\s+[ivxlcdm0-9]+\b",
    r"(?iu)\b(?:chapter|title|part)\s+[ivxlcdm0-9]+\b",
    r"(?iu)\bclass\s+(?:i{1,3}[ab]?|iv|v)\b",
)
QUALIFIERS = (
    "custom-made",
    "investigational",
    "exemption",
    "exempt",
    "exception",
    "shall not apply",
    "does not apply",
    "other than",
    "joint liability",
    "several liability",
    "declaration of conformity",
    "conformity assessment",
)
ACTORS = (
    "notified body",
    "authorised representative",
    "authorized representative",
    "manufacturer",
    "importer",
    "distributor",
    "operator",
    "controller",
    "processor",
)
STOPWORDS = (
    "the", "and", "for", "are", "with", "from", "that", "this", "which",
    "what", "does", "how", "who", "when", "where", "about", "their",
    "have", "been", "being", "into", "across", "between", "specific",
    "specifically", "identify", "exact", "requirements", "obligations",
    "under", "such", "some", "more", "also", "each", "will", "would",
    "could", "should", "than", "then", "must", "they", "them", "these",
)
MAX_TERMS = 15


def vector_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """key, score of the k vectors nearest to one query: each task keeps k, then they meet."""
    return vectors.select(key, cosine("embedding", F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _least_keys(score: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
    """Columns of the n best scores of each row; of equal ones those that come first in order."""
    score = score[:, order]
    least = np.partition(score, score.shape[1] - n, axis=1)[:, [score.shape[1] - n]]
    over, equal = score > least, score == least
    keep = over | (equal & (np.cumsum(equal, axis=1) <= n - over.sum(1, keepdims=True)))
    return order[np.nonzero(keep)[1].reshape(len(score), n)]


def vector_top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", question: str = "query_id") -> DataFrame:
    """question, key, rank (0-based), score: the k nearest vectors of every query (question, embedding); where keys are numbers, the vector of the query's own number is left out.

    For a stated set of queries, not for all vectors against all. Queries go block by block, QUERY_BLOCK at a time; a task multiplies its
    vectors with the block and keeps k a query, so what is shuffled is k rows a query and task.
    """
    spark, out = vectors.sparkSession, None
    numbered = queries.select(F.col(question).cast("long").alias(question), "embedding")
    named = dict(vectors.dtypes)[key] == "string"
    blocks = -(-numbered.count() // QUERY_BLOCK)
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64(question), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK
        ids = np.array([r[question] for r in rows], np.int64)
        q = np.array([r["embedding"] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                m = batch.num_rows
                if not m or not len(ids):
                    continue
                v = np.asarray(batch.column(1).flatten(), np.float64).reshape(m, -1)
                score = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                if not named:
                    score[ids[:, None] == np.asarray(batch.column(0), np.int64)] = -2
                n = min(k, m)
                best = _least_keys(score, n, np.asarray(pc.sort_indices(batch.column(0)))) if named else np.argpartition(-score, n - 1, axis=1)[:, :n]
                who = np.repeat(np.arange(len(ids)), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), batch.column(0).take(pa.array(best.ravel())), pa.array(score[who, best.ravel()])], names=[question, key, "score"])

        part = vectors.select(F.col(key).cast("string" if named else "long").alias(key), "embedding").mapInArrow(run, f"{question} long, {key} {'string' if named else 'long'}, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], f"{question} long, {key} {'string' if named else 'long'}, score double, rank int")
    rank = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), key))
    return out.where("score >= -1.5").withColumn("rank", rank - 1).where(F.col("rank") < k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _frequency(t: Column, term: str) -> Column:
    """How often a word or phrase stands among tokens."""
    words = term.lower().strip('"').split()
    if len(words) == 1:
        return F.size(F.filter(t, lambda x: x == words[0]))
    phrase, padded = " ".join(words), F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(f" {phrase} "), F.lit(" ")))) / (len(phrase) + 1)).cast("int")


def bm25(docs: DataFrame, terms: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score over the words and quoted phrases in terms (with boosts).

    For texts without a stored index: each text is read and split once, its counts of the query's terms are kept as a table, and nothing is shuffled.
    """
    count = lambda t: F.struct(F.size(t).alias("dl"), *[_frequency(t, term).alias(f"tf{i}") for i, term in enumerate(terms)])
    # tokens are bound once, as the only element of an array
    bound = F.get(F.transform(F.array(tokens(F.coalesce(F.col(text), F.lit("")))), count), F.lit(0))
    counts = written(docs.select(F.col(key), bound.alias("_c")).select(key, "_c.*"), "counts")
    total = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, boost in enumerate(terms.values()):
        df = total[f"df{i}"] or 0
        idf = float(np.log(1 + (total["n"] - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + F.lit(boost * idf * (K1 + 1)) * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(total["avgdl"] or 1))))
    return counts.select(key, score.alias("score")).where("score > 0")


def ranked(hits: DataFrame, list_no: int, k: int, key: str) -> DataFrame:
    """list_no, provision_id, rank (0-based), score of the k best."""
    top = hits.orderBy(F.desc("score"), key).limit(k)  # k rows
    return top.select(F.lit(list_no).alias("list_no"), F.col(key).alias("provision_id"), (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("rank"), "score")


def fuse(lists: DataFrame, vector_lists: tuple[int, ...], top_k: int) -> DataFrame:
    """provision_id, rrf, similarity, score: reciprocal ranks summed over lists, plus a share of the best similarity; the first max(2 top_k, 25).

    Sorted by the rounded score; ties go to what appears first.
    """
    vector = F.when(F.col("list_no").isin(*vector_lists), F.col("score"))
    each = lists.groupBy("provision_id").agg(
        F.sum(1 / (F.lit(RRF_CONSTANT) + F.col("rank") + 1)).alias("rrf"), F.max(vector).alias("similarity"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    score = F.round(F.col("rrf") + VECTOR_WEIGHT * F.coalesce("similarity", F.lit(0.0)), 4)
    return each.withColumn("score", score).orderBy(F.desc("score"), "first").limit(max(2 * top_k, 25)).select("provision_id", "rrf", "similarity", "score")


def keyword_query(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with fulltext: quoted phrases, references, qualifiers, actors and words with their boosts, the first MAX_TERMS distinct ones."""
    t, low = F.col(text), F.lower(F.col(text))
    boosted = lambda words, boost: F.transform(words, lambda w: F.struct(F.lower(w).alias("key"), F.concat(F.lit('"'), w, F.lit('"^' + boost)).alias("s")))
    quoted = F.filter(F.transform(F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), lambda w: strip(w)), lambda w: w != "")
    parts = [boosted(quoted, "3.0")]
    parts += [boosted(F.regexp_extract_all(t, F.lit(p), F.lit(0)), "2.5") for p in REFERENCE_PATTERNS]
    parts += [boosted(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)), boost) for words, boost in ((QUALIFIERS, "2.0"), (ACTORS, "1.0"))]
    plain = F.filter(F.regexp_extract_all(t, F.lit(r"\b[A-Za-z0-9_-]{3,}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOPWORDS))
    escaped = F.transform(plain, lambda w: F.struct(F.lower(w).alias("key"), F.concat(F.regexp_replace(w, "-", r"\\-"), F.lit("^0.8")).alias("s")))
    found = queries.withColumn("_all", F.concat(*parts, escaped)).withColumn("_keys", F.transform("_all", lambda y: y["key"]))
    first = F.filter("_all", lambda x, i: F.array_position(F.col("_keys"), x["key"]) == i + 1)
    return found.withColumn("fulltext", F.array_join(F.slice(F.transform(first, lambda x: x["s"]), 1, MAX_TERMS), " OR ")).drop("_all", "_keys")


def _grams(df: DataFrame, words: int) -> DataFrame:
    """df with _w, the words of text, and _g, the hashes of its runs of so many words; a text is split once."""
    w = df.withColumn("_w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    own = F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(words)]))
    return w.withColumn("_g", F.when(F.size("_w") >= words, own).otherwise(F.array().cast("array<bigint>")))


def _run(n: int):
    return lambda x: F.struct(F.lit(n).alias("size"), F.xxhash64(x).alias("hash"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, item_id of documents that contain a phrase (item_id, text) as a substring; phrases without a word match nothing.

    Both sides meet by equality and the substring test then decides: on hashes of runs of words (white space apart), the phrase's inner ones, for phrases of at least words + 2;
    on their longest inner word for those of 3 words and more; and on runs of characters for those of one or two, whose words may be parts of others.
    Lengths that no phrase has cost nothing.
    """
    split = _grams(phrases.select("item_id", "text"), words).withColumn("_n", F.size("_w"))
    lengths = {r[0] for r in split.select(F.when(F.col("_n") >= words + 2, "long").when(F.col("_n") >= 3, "brief").when(F.col("_n") > 0, "short").alias("c")).distinct().collect()}
    keys, found = {}, None
    inner = F.slice("_w", 2, F.greatest(F.col("_n") - 2, F.lit(0)))
    keys["long"] = split.where(F.col("_n") >= words + 2).select("item_id", F.get("_g", F.lit(1)).alias("key"))
    keys["brief"] = split.where(F.col("_n").between(3, words + 1)).select("item_id", F.xxhash64(F.element_at(F.array_sort(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))), -1)["w"]).alias("key"))
    # characters of the whole phrase, or its first ones
    size = F.least(F.length("text"), F.lit(SHORT_CHARS))
    keys["short"] = split.where(F.col("_n").between(1, 2)).select("item_id", F.struct(size.alias("size"), F.xxhash64(F.substr("text", F.lit(1), size)).alias("hash")).alias("key"))
    for kind in sorted(lengths - {None}):
        if kind == "long":
            # outer, as the filter that the optimizer derives from a plain explode would split each text once a word
            own = _grams(docs.select("doc_id", "text"), words).select("doc_id", F.explode_outer("_g").alias("key"))
        elif kind == "brief":
            own = docs.select("doc_id", F.explode_outer(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda x: F.xxhash64(x)))).alias("key"))
        else:
            sizes = sorted(r[0] for r in keys[kind].select("key.size").distinct().collect())  # SHORT_CHARS numbers at most
            runs = [F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))), _run(n)) for n in sizes]
            own = docs.select("doc_id", F.explode_outer(F.concat(*runs)).alias("key"))
        met = own.join(keys[kind], "key").select("doc_id", "item_id").distinct()
        found = met if found is None else found.union(met)
    if found is None:
        return docs.select("doc_id").join(phrases.select("item_id").limit(0))
    texts = docs.select("doc_id", "text")
    return found.join(texts, "doc_id").join(phrases.select("item_id", F.col("text").alias("phrase")), "item_id").where(F.col("text").contains(F.col("phrase"))).select("doc_id", "item_id").distinct()
