"""Property graph as one table a label and one edge table: guarded links, upserts, context, statistics, cascade delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.functions.tables import written

#: Relations of the model.
RELATIONS = (
    "CONTAINS", "HAS_CHAPTER", "HAS_SECTION", "HAS_ARTICLE", "HAS_PARAGRAPH", "HAS_ANNEX", "HAS_RECITAL", "NEXT_ARTICLE", "NEXT_PARAGRAPH",
    "CITES", "REFERENCES_ANNEX", "INTERPRETED_BY", "DEFINES", "USES_TERM", "IMPOSES", "APPLIES_TO", "AMENDS", "HAS_ONTOLOGY",
)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full merge on key: a new value replaces the stored one unless it is null; the last of several new rows (highest ord, if there is one) counts."""
    columns = [c for c in stored.columns if c != key]
    if "ord" in new.columns and "ord" not in stored.columns:
        new = new.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns])
    n = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    return stored.join(n, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def guarded(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct edges whose both ends exist."""
    ok = edges.where(F.col("rel_type").isin(*RELATIONS))
    ok = ok.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(targets.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return ok.select("src_id", "rel_type", "dst_id").distinct()


def citations(chunks: DataFrame) -> DataFrame:
    """src_id, dst_id: guarded CITES edges of chunks, whose ends are provisions of one document, as cross_references are. A document's ids meet in its own row, so that no id is shuffled."""
    own = chunks.groupBy("doc_id").agg(F.collect_list("id").alias("ids"), F.collect_set(F.when(F.size("cross_references") > 0, F.struct("id", "cross_references"))).alias("refs"))
    there = F.array_intersect(F.flatten(F.transform("refs", lambda r: r["cross_references"])), F.col("ids"))
    edges = own.where(F.size("refs") > 0).select("doc_id", there.alias("there"), F.explode("refs").alias("r")).select(F.col("r.id").alias("src_id"), F.explode(F.array_intersect("r.cross_references", "there")).alias("dst_id"))
    return edges.distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by label and edges by relation, with a total of each."""
    n = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    e = edges.groupBy("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n")
    both = n.union(e)
    return both.union(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("total").alias("name"), "n"))


def schema_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name: labels and relations in use."""
    return nodes.select(F.lit("label").alias("kind"), F.col("label").alias("name")).distinct().union(edges.select(F.lit("relationship").alias("kind"), F.col("rel_type").alias("name")).distinct())


def reachable(edges: DataFrame, roots: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """id of the roots and of all nodes on directed paths from them; cycles end because visited nodes are left out.

    Each step joins only the frontier with the edges. Relations in skip are not followed (to keep shared nodes, say).
    """
    step = edges.where(~F.col("rel_type").isin(*skip)) if skip else edges
    seen = written(roots.select("id").distinct(), "seen")
    frontier = seen
    while True:
        found = step.join(frontier, F.col("src_id") == F.col("id"), "left_semi").select(F.col("dst_id").alias("id")).distinct()
        frontier = written(found.join(seen, "id", "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return seen
        seen = seen.union(frontier)


def reach_pairs(edges: DataFrame, roots: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """root, id, hops (the fewest) of all nodes on directed paths from each of the roots (id), itself with 0, at any depth; relations: only these are followed.

    Each step joins the pairs found last with the edges, so a node that many roots reach is told for each of them; cycles end because pairs that are known are left out.
    """
    step = (edges.where(F.col("rel_type").isin(*relations)) if relations else edges).select("src_id", "dst_id")
    frontier = seen = written(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops")).distinct(), "pairs")
    while True:
        next_ = frontier.join(step, F.col("id") == F.col("src_id")).select("root", F.col("dst_id").alias("id"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = written(next_.join(seen.select("root", "id"), ["root", "id"], "left_anti"), "pairs")
        if not frontier.limit(1).count():
            return seen
        seen = seen.union(frontier)


def exclusive_reach(edges: DataFrame, roots: DataFrame, chosen: DataFrame) -> DataFrame:
    """id of the chosen roots and of what is reachable from them, but for other roots and for what a node outside, or another root, leads to.

    Only what the chosen ones reach is walked: whatever else leads into it does so by an edge from outside, and what such an edge leads to stays, with all below it.
    """
    mine = written(chosen.select("id").distinct(), "chosen")
    all_ = written(reachable(edges, mine), "within")
    own = edges.join(mine, F.col("src_id") == F.col("id"), "left_anti")
    entered = own.join(all_, F.col("dst_id") == F.col("id"), "left_semi").join(all_, F.col("src_id") == F.col("id"), "left_anti").select(F.col("dst_id").alias("id"))
    kept = entered.union(roots.select("id").join(all_, "id", "left_semi")).join(mine, "id", "left_anti")
    return all_.join(reachable(own, kept), "id", "left_anti").union(mine).distinct()


def cascade_delete(nodes: DataFrame, edges: DataFrame, roots: DataFrame, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that stay, and the ids that go: everything reachable from the roots."""
    gone = reachable(edges, roots, skip)
    left = edges.join(gone, F.col("src_id") == F.col("id"), "left_anti").join(gone, F.col("dst_id") == F.col("id"), "left_anti")
    return nodes.join(gone, "id", "left_anti"), left, gone


def listed(documents: DataFrame, edges: DataFrame, relations: dict[str, str]) -> DataFrame:
    """documents with, for each column of relations, the number of distinct targets; counted before joining, so nothing multiplies."""
    counts = edges.where(F.col("rel_type").isin(*relations.values())).groupBy(F.col("src_id").alias("id")).agg(*[F.count_distinct(F.when(F.col("rel_type") == r, F.col("dst_id"))).alias(c) for c, r in relations.items()])
    return documents.join(counts, "id", "left").fillna(0, list(relations))


def context(provisions: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """provisions (id) with parents, cites and annexes (ids) and terms ('term: definition'), each sorted; branches are aggregated before they are joined."""

    def targets(relation: str, column: str) -> DataFrame:
        return edges.where(F.col("rel_type") == relation).groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set("dst_id")).alias(column))

    parents = edges.where(F.col("rel_type").isin("HAS_ARTICLE", "HAS_PARAGRAPH", "CONTAINS")).groupBy(F.col("dst_id").alias("id")).agg(F.array_sort(F.collect_set("src_id")).alias("parents"))
    uses = edges.where("rel_type = 'USES_TERM'").join(texts.select(F.col("id").alias("dst_id"), "text"), "dst_id").groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set("text")).alias("terms"))
    out = provisions.join(parents, "id", "left").join(targets("CITES", "cites"), "id", "left").join(targets("REFERENCES_ANNEX", "annexes"), "id", "left").join(uses, "id", "left")
    none = F.array().cast("array<string>")
    return out.select(*provisions.columns, *[F.coalesce(c, none).alias(c) for c in ("parents", "cites", "annexes", "terms")])
