"""Line dedup: classes of equal line runs by distributed prefix doubling over line ids; later copies are deleted. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, keep_members, member_filter, staged, without_members

#: A run counts when it holds so many characters (line breaks aside).
LEAST_CHARS = 100


def _key():
    """One number for a document: its id and text. Rows that repeat both count as one document."""
    return F.xxhash64("doc_id", F.col("text"), F.octet_length("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """k, doc_id, line, id, chars of every line: hashes and lengths, never the text."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("id"), F.length(x).alias("chars")))
    return docs.select(_key().alias("k"), "doc_id", F.posexplode(lines).alias("line", "x")).select("k", "doc_id", "line", "x.id", "x.chars").distinct()


def _classes(windows: DataFrame) -> DataFrame:
    """Windows (k, doc_id, line, id, chars) whose id stands more than once, with their class's name and whether an earlier one exists.

    The class is named by its first position. Ids are counted before rows move, so a line of a third of all documents is one row a task.
    """
    often = windows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    active = staged(windows.join(often, "id"), "windows")
    first = active.groupBy("id").agg(F.min(F.struct("doc_id", "k", "line")).alias("first"))
    named = active.join(first, "id")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.k") == F.col("k")) & (F.col("first.line") == F.col("line"))
    out = staged(named.select("k", "doc_id", "line", F.xxhash64("first.doc_id", "first.k", "first.line").alias("name"), "chars", (~same).alias("later")), "classes")
    drop_staged(active)
    return out


def _least_windows(lines: DataFrame, least_chars: int) -> DataFrame:
    """k, start, width: for each line the shortest window that begins there, and the shortest that ends there, with least_chars.

    lines (k, line, chars) are those that stand more than once; windows do not cross others. Every window with least_chars is the
    union of such windows inside it, and equal windows have equal ones, so these are all that need to be looked up.
    """
    by = Window.partitionBy("k").orderBy("line")
    part = Window.partitionBy("k", "part").orderBy("line")
    own = lines.select("k", "line", "chars", (F.col("line") - F.row_number().over(by)).alias("part"))
    own = own.withColumn("upto", F.sum("chars").over(part)).withColumn("last", F.lead("line").over(part).isNull())
    # boundaries of lines, with the characters before them
    here, after = F.struct(F.col("line").alias("at"), (F.col("upto") - F.col("chars")).alias("before")), F.struct((F.col("line") + 1).alias("at"), F.col("upto").alias("before"))
    points = own.select("k", "part", F.explode(F.when(F.col("last"), F.array(here, after)).otherwise(F.array(here))).alias("p")).select("k", "part", "p.at", "p.before")
    points = points.withColumn("back", -F.col("before"))
    far = lambda order: Window.partitionBy("k", "part").orderBy(order).rangeBetween(Window.unboundedPreceding, -least_chars)
    both = points.select("k", "at", F.max("at").over(far("before")).alias("start"), F.min("at").over(far("back")).alias("end"))
    begins, ends = both.select("k", F.col("at").alias("start"), (F.col("end") - F.col("at")).alias("width")), both.select("k", "start", (F.col("at") - F.col("start")).alias("width"))
    return begins.union(ends).where("start IS NOT NULL AND width IS NOT NULL").distinct()


def repeated_runs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """k, start, end: maximal runs of lines (end exclusive) made of windows that stand earlier too.

    Windows have 1, 2, 4, ... lines. A window of twice the length is named by the names of its halves, as in building a suffix array by
    prefix doubling; its class is the interval of suffixes with that common prefix. A window of any other width is named by two windows
    of the largest power of two, which overlap. A line is deleted when a window of whatever width around it holds least_chars and
    starts earlier as well: in a document of smaller id, or above in the same one; overlaps count. Only windows that stand more than
    once are carried on, and the doubling ends when none is left or none of the shortest windows with least_chars is wider.
    """
    level = _classes(line_table(docs))
    least = staged(_least_windows(level, least_chars), "least")
    widest = least.agg(F.max("width")).first()[0] or 0
    hits, width = [], 1
    while True:
        hits.append(staged(level.where(F.col("later") & (F.col("chars") >= least_chars)).select("k", F.col("line").alias("start"), (F.col("line") + width).alias("end")), "hits"))
        if widest > width > 1:
            wanted = least.where((F.col("width") > width) & (F.col("width") < 2 * width)).withColumn("line", F.col("start") + F.col("width") - width)
            tail = level.select("k", "line", F.col("name").alias("name2"))
            head = level.select("k", F.col("line").alias("start"), "doc_id", "name")
            named = wanted.join(tail, ["k", "line"]).join(head, ["k", "start"])
            # the width takes the place of the characters, of which there are enough
            other = _classes(named.select("k", "doc_id", F.col("start").alias("line"), F.xxhash64("name", "name2", "width").alias("id"), F.col("width").alias("chars")))
            hits.append(staged(other.where("later").select("k", F.col("line").alias("start"), (F.col("line") + F.col("chars")).alias("end")), "hits"))
            drop_staged(other)
        if 2 * width > widest:
            break
        right = level.select("k", (F.col("line") - width).alias("line"), F.col("name").alias("name2"), F.col("chars").alias("chars2"))
        pairs = level.join(right, ["k", "line"])
        last = level
        level = _classes(pairs.select("k", "doc_id", "line", F.xxhash64("name", "name2").alias("id"), (F.col("chars") + F.col("chars2")).alias("chars")))
        drop_staged(last)
        width *= 2
        if not level.limit(1).count():
            break
    found = hits[0]
    for h in hits[1:]:
        found = found.union(h)
    by = Window.partitionBy("k").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("k", "start", "end")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of docs (doc_id, text and any others) with the text that is left, and n_lines, n_removed, runs (start and end of each deleted run).

    Lines are what \\n separates. Null texts stay null and have no lines; empty ones have one empty line. Rows that repeat an id and
    text get equal results. Documents without deletions are never shuffled. Columns named as the results are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "runs")
    runs = staged(repeated_runs(docs.where("text IS NOT NULL"), least_chars).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")
    keyed = docs.withColumn("_k", _key())
    bitmap = staged(member_filter(runs, "k"), "bitmap")
    touched = keep_members(keyed, bitmap, "_k").join(runs.withColumnRenamed("k", "_k"), "_k", "left")
    rest = without_members(keyed, bitmap, "_k").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    both = touched.select(*docs.columns, "runs").unionByName(rest.select(*docs.columns, "runs"))
    # a column of its own, so that it is split once and not once a run
    both = both.withColumn("_lines", F.split("text", "\n", -1))
    lines = F.col("_lines")
    upto = lambda i: F.coalesce(F.get(F.col("runs"), i - 1)["end"], F.lit(0))
    gaps = F.transform("runs", lambda r, i: F.slice(lines, upto(i) + 1, r["start"] - upto(i)))
    end = F.element_at("runs", -1)["end"]
    kept = F.array_join(F.concat(F.flatten(gaps), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return (
        both.withColumn("n_lines", F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
        .withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept))
        .withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
        .drop("_lines")
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines deleted from every document, and a digest of what is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
