"""Change detection: manifests, existence checks, comparison of documents and of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.text import EXACT, cosine, optional_equal, parity_any, strip


def article_level(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "formatting_or_minor").when(similarity >= 0.80, "moderate").otherwise("major_rewrite")


def paragraph_level(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "minor_edit").when(similarity >= 0.80, "moderate_change").otherwise("substantive_revision")


def exists_check(documents: DataFrame, content_hash: str | None = None, short_name: str | None = None, parity: bool = False) -> DataFrame:
    """One row: status (not_found, identical, different_version) and the number of documents found.

    By default all given values must fit; parity keeps the rule by which a missing value fits every document.
    """
    given = {"content_hash": content_hash, "short_name": short_name}
    hits = parity_any(documents, **given) if parity else optional_equal(documents, **given) if any(given.values()) else documents.limit(0)
    same = F.coalesce(F.max((F.col("content_hash") == F.lit(content_hash)).cast("int")), F.lit(0))
    return hits.agg(F.count("*").alias("n"), same.alias("same")).select(F.when(F.col("n") == 0, "not_found").when(F.col("same") == 1, "identical").otherwise("different_version").alias("status"), F.col("n").alias("n_found"))


def manifest_changes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (id, hash, kind) with status added, updated or unchanged against the stored manifest; nothing stored is ever deleted."""
    # 32 bytes in place of a hash's 64 digits, or of a text
    short = F.unhex(F.sha2("hash", 256))
    old = stored.select("id", short.alias("_h"), F.lit(1).alias("_in"))
    both = new.withColumn("_n", short).join(old, "id", "left")
    return both.withColumn("status", F.when(F.col("_in").isNull(), "added").when(F.col("_h").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")).drop("_h", "_n", "_in")


def article_diff(old: DataFrame, new: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """number, status, similarity, change_level, old_length, new_length, id, title of a stored document's articles (number, text) against a new version's.

    Where both have an embedding, similarity is its cosine (4 places), else 1. id (of the stored article) and title (the new one's, else
    the stored one's) are null where they are not given. Articles without a number do not take part.

    vectors (vec_id, embedding): the column embedding of both is then a vec_id, and vectors are looked up for what was modified alone, instead of moving with all articles.
    """
    have = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    side = lambda df, s: df.where("number IS NOT NULL AND cast(number AS string) <> ''").select("number", F.col("text").alias(f"_{s}"), have(df, "embedding").alias(f"_e{s}"), have(df, "title").alias(f"_t{s}"), have(df, "id").alias(f"_i{s}"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.sha2(strip("_o"), 256) == F.sha2(strip("_n"), 256), "unchanged").otherwise("modified")
    joined = side(old, "o").join(side(new, "n"), "number", "full_outer").withColumn("status", status)
    both = "embedding" in old.columns and "embedding" in new.columns
    if both and vectors is not None:
        for side_ in ("_eo", "_en"):
            joined = joined.withColumn("_k", F.when(F.col("status") == "modified", F.col(side_))).drop(side_).join(vectors.select(F.col("vec_id").alias("_k"), F.col("embedding").alias(side_)), "_k", "left").drop("_k")
    near = F.coalesce(F.when(F.col("_eo").isNotNull() & F.col("_en").isNotNull(), cosine("_eo", "_en")), F.lit(1.0)) if both else F.lit(1.0)
    joined = joined.withColumn("similarity", F.when(F.col("status") == "modified", F.round(near, 4)))
    level = F.when(F.col("status") == "modified", article_level(F.col("similarity")))
    return joined.select("number", "status", "similarity", level.alias("change_level"), F.length("_o").alias("old_length"), F.length("_n").alias("new_length"), F.col("_io").alias("id"), F.coalesce("_tn", "_to").alias("title"))


def diff_totals(diff: DataFrame) -> DataFrame:
    """One row: total_added, total_removed, total_modified, unchanged_count."""
    n = lambda s, name: F.count(F.when(F.col("status") == s, 1)).alias(name)
    return diff.agg(n("added", "total_added"), n("removed", "total_removed"), n("modified", "total_modified"), n("unchanged", "unchanged_count"))


def numbered_paragraphs(articles: DataFrame) -> DataFrame:
    """article_id, number, text: bodies after 'n.' at line starts; else the lines that are not blank, numbered from 1. The last of equal numbers counts."""
    mark = EXACT + r"(?:^|\n)\s*(\d+)\.\s+"
    numbers, bodies = F.regexp_extract_all("text", F.lit(mark), F.lit(1)), F.split("text", mark, -1)
    marked = F.arrays_zip(numbers.alias("n"), F.slice(bodies, 2, F.size(bodies)).alias("t"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: strip(x)), lambda x: x != "")
    plain = F.transform(lines, lambda x, i: F.struct((i + 1).cast("string").alias("n"), x.alias("t")))
    rows = articles.select("article_id", F.posexplode(F.when(F.size(numbers) > 0, marked).otherwise(plain)).alias("pos", "p"))
    return rows.groupBy("article_id", F.col("p.n").alias("number")).agg(strip(F.max_by("p.t", "pos")).alias("text"))


def paragraph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """article_id, number, status, similarity, change_level of stored paragraphs (article_id, number, text and, perhaps, embedding) against new articles
    (article_id, text and, perhaps, embeddings: a map from number to vector). Paragraphs without a number or text do not take part."""
    fresh = numbered_paragraphs(new).select("article_id", "number", F.col("text").alias("_n"))
    vectors = "embedding" in old.columns and "embeddings" in new.columns
    if vectors:
        fresh = fresh.join(new.select("article_id", "embeddings"), "article_id").withColumn("_en", F.try_element_at("embeddings", F.col("number"))).drop("embeddings")
    stored = old.where("number <> '' AND text <> ''").select("article_id", "number", strip("text").alias("_o"), *[F.col("embedding").alias("_eo")] * vectors)
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("modified")
    joined = stored.join(fresh, ["article_id", "number"], "full_outer").withColumn("status", status)
    near = F.coalesce(F.when(F.col("_eo").isNotNull() & F.col("_en").isNotNull(), cosine("_eo", "_en")), F.lit(1.0)) if vectors else F.lit(1.0)
    joined = joined.withColumn("similarity", F.when(F.col("status") == "modified", F.round(near, 4)))
    return joined.select("article_id", "number", "status", "similarity", F.when(F.col("status") == "modified", paragraph_level(F.col("similarity"))).alias("change_level"))


def merkle(articles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """article_id, merkle: hash over the title and the sorted hashes of the paragraphs (article_id, text)."""
    leaves = paragraphs.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list(F.sha2("text", 256))), "").alias("_l"))
    return articles.join(leaves, "article_id", "left").select("article_id", F.sha2(F.concat(F.coalesce("title", F.lit("")), F.coalesce("_l", F.lit(""))), 256).alias("merkle"))


#: Columns of a Merkle tree's nodes; hash is null for a paragraph that was taken out.
NODE = ("level", "id", "parent_id", "title", "hash")


def _rolled(children: DataFrame, parents: DataFrame) -> DataFrame:
    """parents with the hash of their title and the sorted hashes of children (parent_id, hash)."""
    below = children.where("hash IS NOT NULL").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("_l"))
    joined = parents.drop("hash").join(below.withColumnRenamed("parent_id", "id"), "id", "left")
    return joined.withColumn("hash", F.sha2(F.concat(F.coalesce("title", F.lit("")), F.coalesce("_l", F.lit(""))), 256)).select(*NODE)


def merkle_tree(documents: DataFrame, articles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The nodes (level, id, parent_id, title, hash) of all documents (id), articles (id, parent_id, title) and paragraphs (id, parent_id, text), to be stored."""
    leaf = paragraphs.select(F.lit("paragraph").alias("level"), "id", "parent_id", F.lit(None).cast("string").alias("title"), F.sha2("text", 256).alias("hash"))
    middle = _rolled(leaf, articles.select(F.lit("article").alias("level"), "id", "parent_id", "title"))
    top = _rolled(middle, documents.select(F.lit("document").alias("level"), "id", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("title")))
    return leaf.union(middle).union(top)


def merkle_update(tree: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The nodes of tree that change with these paragraphs (id, parent_id, text; a null text takes one out): they, their articles and documents, hashed anew from the stored hashes beside them.

    No other article or document is hashed, and no other text is read.
    """
    leaf = paragraphs.select(F.lit("paragraph").alias("level"), "id", "parent_id", F.lit(None).cast("string").alias("title"), F.sha2("text", 256).alias("hash"))

    def above(level: str, below: str, fresh: DataFrame) -> DataFrame:
        touched = fresh.select("parent_id").distinct()
        beside = tree.where(F.col("level") == below).join(touched, "parent_id", "left_semi").join(fresh.select("id"), "id", "left_anti").select(*NODE)
        return _rolled(beside.union(fresh.select(*NODE)), tree.where(F.col("level") == level).join(touched.withColumnRenamed("parent_id", "id"), "id", "left_semi").select(*NODE))

    middle = above("article", "paragraph", leaf)
    return leaf.union(middle).union(above("document", "article", middle))


def merkle_merged(tree: DataFrame, changed: DataFrame) -> DataFrame:
    """tree with the nodes of merkle_update in place of its own."""
    return tree.join(changed.select("level", "id"), ["level", "id"], "left_anti").select(*NODE).union(changed.where("hash IS NOT NULL").select(*NODE))


def merkle_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """level, id, status (added, removed, changed) where two trees differ, found from the documents down: below a node of equal hashes nothing is compared."""
    out, within = None, None
    for level in ("document", "article", "paragraph"):
        a, b = (t.where(F.col("level") == level) for t in (old, new))
        if within is not None:
            a, b = (t.join(within, "parent_id", "left_semi") for t in (a, b))
        both = a.select("id", F.col("hash").alias("was")).join(b.select("id", "hash"), "id", "full_outer").where("NOT was <=> hash")
        status = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").otherwise("changed")
        rows = both.select(F.lit(level).alias("level"), "id", status.alias("status"))
        out, within = rows if out is None else out.union(rows), rows.select(F.col("id").alias("parent_id"))
    return out
