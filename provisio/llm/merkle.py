"""Merkle manifest of a table: levels of aligned blocks as concatenated hex strings, of which fixed-width substrings are hashed to parents and cut out as siblings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Nodes that are hashed together, and hexadecimal digits of a node.
ARITY, DIGITS = 3, 64
#: Levels that one block covers: a block keeps ARITY ** LEVELS nodes, about 5 kB, whatever the size of the table.
LEVELS = 4
BLOCK = ARITY**LEVELS
RUN = ARITY * DIGITS
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value: no two rows of fields have the same concatenation."""
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp (source, null first in its order), doc_id, node (the leaf) and tampered (the leaf of the tampered row, null where tampering changes nothing)."""
    fields = [F.col(c) for c in FIELDS]
    struck = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaf = lambda text: digest(*[encoded(c) for c in fields[:-1]], encoded(text))
    return docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("grp"),
        "doc_id",
        leaf(F.col("text")).alias("node"),
        F.when(struck.isNotNull(), leaf(struck)).alias("tampered"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (gapless from 0 in grp, by order) and n (rows of the grp).

    Rows are ranged over partitions by grp and order, so that a hot group spreads; only the rows of each group and partition are counted and summed up.
    """
    at = staged(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33).alias("_part")
    runs = at.groupBy("grp", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy("grp")
    runs = runs.select("grp", "_part", (F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n"))
    return at.withColumn("_part", part).join(runs, ["grp", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _levels(n: Column) -> Column:
    """Levels from n nodes up to one, LEVELS at most."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(1, LEVELS)), F.when(n > 1, 1).otherwise(0))


def _parents(level: Column) -> Column:
    """The next level's string: each run of ARITY nodes, the last one shorter, is a fixed-width substring."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def _flanks(k: int, i: Column) -> Column:
    """left, right: the siblings at level k of what stands at place i of the block."""
    at = F.floor(i / ARITY**k).cast("int")
    within = at % ARITY
    level = F.get("strings", F.lit(k))
    return F.struct(F.substr(level, (at - within) * DIGITS + 1, within * DIGITS).alias("left"), F.substr(level, (at + 1) * DIGITS + 1, (ARITY - 1 - within) * DIGITS).alias("right"))


def climb(nodes: DataFrame, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """The staged blocks of each round, from the nodes (grp, pos, n, node, payload) upwards, and the root (grp, node) of each group.

    A block (grp, block) keeps its nodes' pos and payload, and strings: each of its levels as one string.
    """
    rounds, largest = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        found = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("nodes"))
        up = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= _levels(F.col("n")))
        strings = F.aggregate(up, F.array(F.array_join("nodes.node", "")), lambda made, k: F.concat(made, F.array(_parents(F.element_at(made, -1)))))
        rows = F.transform("nodes", lambda x: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in payload]))
        rounds.append(staged(found.select("grp", "block", "n", rows.alias("rows"), strings.alias("strings")), "blocks"))  # BLOCK nodes a row at most
        nodes, payload = rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("strings", -1).alias("node")), ()
        if largest <= BLOCK:
            return rounds, nodes.select("grp", "node")
        largest = math.ceil(largest / BLOCK)


def descend(rounds: list[DataFrame], tops: DataFrame, *payload: str) -> DataFrame:
    """grp, payload and node of all nodes of the first round, with path: the siblings (left, right) of each level from the node up, followed by the path of its group in tops
    (grp, path and other columns, which are handed down)."""
    handed = [c for c in tops.columns if c not in ("grp", "path")]
    down = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        own = payload if k == 0 else ()
        path = lambda i: F.slice(F.array(*[_flanks(level, i) for level in range(LEVELS)]), F.lit(1), F.size("strings") - 1)
        node = lambda i: F.substr(F.get("strings", F.lit(0)), i * DIGITS + 1, F.lit(DIGITS))
        rows = rounds[k].select("grp", "block", F.transform("rows", lambda x, i: F.struct(x["pos"].alias("pos"), node(i).alias("node"), *[x[c].alias(c) for c in own], path(i).alias("own"))).alias("rows"))
        joined = rows.join(down.select("grp", F.col("pos").alias("block"), F.col("path").alias("upper"), *handed), ["grp", "block"])
        keep = ["row.node", *[f"row.{c}" for c in own]] if k == 0 else []
        down = joined.select("grp", F.explode("rows").alias("row"), "upper", *handed).select("grp", "row.pos", *keep, F.concat("row.own", "upper").alias("path"), *handed)
    return down.drop("pos")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text; other columns are not read).

    Leaves ascend by doc_id in each source; a null doc_id stands first and is not tampered with, rows of one doc_id are ordered by leaf, and rows that repeat are leaves of their own.
    A source's tree is built of aligned blocks of BLOCK nodes, whose roots are the nodes of the next round, so no task holds more than a block of any source. The proof of a table's
    only row is the digest of nothing. Null and empty fields differ; an empty table gives an empty result.
    """
    rounds, roots = climb(placed(leaves(docs), "doc_id", "node"), "doc_id", "tampered")
    sources = roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    above, root = climb(placed(sources, "of"), "of")
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = descend(above, root.select("grp", none.alias("path"), F.col("node").alias("root")), "of")
    tops = tops.select(F.col("of").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    rows = descend(rounds, tops, "doc_id", "tampered")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "node"), lambda node, p: digest(p["left"], node, p["right"]))
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaves, roots, proofs and their check under tampering for all documents."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


def _sql_siblings(tree: str) -> str:
    return f"""SELECT t.grp, t.lvl, t.pos, {{'l': COALESCE(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < t.pos), ''), 'r': COALESCE(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > t.pos), '')}} AS step
  FROM {tree} t JOIN {tree} o ON o.grp = t.grp AND o.lvl = t.lvl AND o.pos // 3 = t.pos // 3 WHERE t.n > 1 GROUP BY t.grp, t.lvl, t.pos"""


_LEAF = "sha256(" + " || ".join(_sql_field(c) for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS id, COALESCE('=' || source, '') AS grp, *,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents
), hashed AS (
  SELECT id, grp, doc_id, {_LEAF} AS leaf, {_LEAF.replace("text", "(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS tampered FROM rows
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM hashed
), tree AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
), subroots AS (
  SELECT grp AS of, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT '' AS grp, 0 AS lvl, pos, n, node FROM subroots
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
), siblings AS (
  {_sql_siblings("tree")}
), uppers AS (
  {_sql_siblings("top")}
), steps AS (
  SELECT l.id, s.lvl, s.step FROM leaves l JOIN siblings s ON s.grp = l.grp AND s.pos = l.pos // (3 ** s.lvl)::BIGINT
  UNION ALL
  SELECT l.id, 1000 + u.lvl, u.step FROM leaves l JOIN subroots r ON r.of = l.grp JOIN uppers u ON u.pos = r.pos // (3 ** u.lvl)::BIGINT
), paths AS (
  SELECT id, list(step ORDER BY lvl) AS path FROM steps GROUP BY id
), folded AS (
  SELECT l.doc_id, l.leaf, r.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, COALESCE(array_to_string(list_transform(path, lambda p: p.l || p.r), ''), '') AS beside,
    list_reduce(list_prepend({{'l': l.tampered, 'r': ''}}, COALESCE(path, [])), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root
  FROM leaves l JOIN subroots r ON r.of = l.grp LEFT JOIN paths p USING (id)
)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
