"""After retrieval: evidence budgets, history budgets, intent routing, citations, expansion along references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions.text import contains_any, strip

EVIDENCE_CHARS, PROVISION_CHARS = 7_500, 1_500
TRUNCATED = "\n[... provision text truncated to retain key operative rules ...]"
#: Greetings and the substrings that route a message.
GREETINGS = (
    "hi",
    "hello",
    "hey",
    "good morning",
    "good afternoon",
    "good evening",
    "greetings",
    "hi there",
    "hello there",
    "howdy",
    "thanks",
    "thank you",
    "bye",
    "goodbye",
)
SHORT_GREETINGS = ("hi", "hello", "hey", "greetings")
UPLOAD_WORDS = ("upload", "index", "add document", "parse pdf")
DIFF_WORDS = ("diff", "compare", "difference", "version", "amendment")
#: Patterns of citations in answers.
NODE_CITATION = r"(?i)\[([A-Za-z0-9_ -]+:(?:recital|art|para|annex):[A-Za-z0-9_:.-]+)\]"
PROVISION_CITATION = r"(?i)\[([A-Za-z0-9_ -]+,\s*(?:Art\.|Article|Recital)[^\]]+)\]"
SOURCE_LINE = r"(?i)\b(?:Article ID|Source):\s*([A-Za-z0-9_ -]+:[A-Za-z0-9_:.-]+)"
ACT = r"(?i)\b(Regulation \((?:EC|EU)\) (?:No )?\d+/\d+|Decision (?:No )?\d+/\d+/EC|Directive \d+/\d+/EC)\b"


def evidence_entry(provision_id: Column, document: Column, title: Column, text: Column, cites: Column, annexes: Column) -> Column:
    """One provision of the evidence bundle; texts over PROVISION_CHARS are cut and say so."""
    body = strip(F.coalesce(text, F.lit("")))
    body = F.when(F.length(body) > PROVISION_CHARS, F.concat(F.substring(body, 1, PROVISION_CHARS), F.lit(TRUNCATED))).otherwise(body)
    part = lambda label, c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    head = F.concat(F.lit("=== PROVISION: "), provision_id, F.lit(" | "), F.when(document != "", document).otherwise(F.lit("Document")), F.when(title != "", F.concat(F.lit(" | "), title)).otherwise(F.lit("")), F.lit(" ==="))
    return F.concat(F.concat_ws("\n", head, F.when(body != "", body), part("Cross-References Cited: ", cites), part("Annexes Referenced: ", annexes)), F.lit("\n"))


def within_budget(entries: DataFrame, group: list[str], order: list[Column], size: Column, most: int, keep_first: bool) -> DataFrame:
    """The leading rows of each group whose sizes add up to most at the most; the first row always, if keep_first. Sizes are positive, so a running sum decides.

    Within each part of a group the rows that can still fit are found first, so a group of a third of all rows is small when it meets.
    """
    rows = entries.withColumn("_size", size).withColumn("_part", F.spark_partition_id())
    for by in ([*group, "_part"], group):
        w = Window.partitionBy(*by).orderBy(*order)
        ok = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most
        rows = rows.withColumn("_ok", ok | (F.row_number().over(w) == 1) if keep_first else ok).where("_ok")
    return rows.drop("_ok", "_size", "_part")


#: Columns of a record of search results.
RECORD = "array<struct<provision_id:string,document:string,article_title:string,text:string,score:double,cited_articles:array<string>,referenced_annexes:array<string>>>"
NOTHING = "No statutory provisions retrieved from the knowledge graph."


def records(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and the fields of RECORD of each record in a tool's output: a JSON list, an object, or an object that holds the list as data. What is no JSON has none."""
    wrapped = F.from_json(F.col(text), f"data {RECORD}", {"mode": "PERMISSIVE"})["data"]
    plain = F.from_json(F.when(F.ltrim(F.col(text)).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]"))), RECORD)
    found = F.filter(F.coalesce(wrapped, plain, F.array().cast(RECORD)), lambda r: r.isNotNull())
    return outputs.select(key, F.posexplode_outer(found).alias("pos", "r")).select(key, "pos", "r.*")


def bundles(rows: DataFrame, key: str, most: int = EVIDENCE_CHARS) -> DataFrame:
    """key, bundle: one text for each key of its records by score (missing: 0; ties in their order), as many as fit; a key without any says so."""
    none = F.array().cast("array<string>")
    entry = evidence_entry(F.col("provision_id"), F.coalesce("document", F.lit("")), F.coalesce("article_title", F.lit("")), F.col("text"), F.coalesce("cited_articles", none), F.coalesce("referenced_annexes", none))
    own = rows.where("provision_id IS NOT NULL").select(key, "pos", F.coalesce("score", F.lit(0.0)).alias("score"), entry.alias("entry"))
    kept = within_budget(own, [key], [F.desc("score"), F.col("pos")], F.length("entry"), most, True)
    texts = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "entry"))), lambda x: x["entry"]), "\n").alias("bundle"))
    return rows.select(key).distinct().join(texts, key, "left").withColumn("bundle", F.coalesce("bundle", F.lit(NOTHING)))


def trim_history(messages: DataFrame, most: int = 16_000) -> DataFrame:
    """The newest messages (conv_id, turn, text) of each conversation that fit: length / 4 + 10 tokens each."""
    return within_budget(messages, ["conv_id"], [F.desc("turn")], F.floor(F.length("text") / 4) + 10, most, False)


def intent(text: Column) -> Column:
    """greeting, upload, diff or question; the first that fits."""
    clean = F.lower(strip(text))
    bare = F.regexp_replace(clean, "[!.,?]+$", "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    greeting = bare.isin(*GREETINGS) | ((F.size(words) <= 3) & F.arrays_overlap(words, F.array(*map(F.lit, SHORT_GREETINGS))))
    return F.when(greeting, "greeting").when(contains_any(clean, UPLOAD_WORDS), "upload").when(contains_any(clean, DIFF_WORDS), "diff").otherwise("question")


def citations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, citation of every citation in an answer."""
    def kind(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda c: F.struct(F.lit(name).alias("kind"), c.alias("citation")))

    found = F.concat(kind("node", NODE_CITATION), kind("provision", PROVISION_CITATION), kind("source", SOURCE_LINE), kind("act", ACT))
    return answers.select(key, F.explode(found).alias("c")).select(key, "c.kind", "c.citation")


def expand_references(hits: DataFrame, group: str, first: int = 2, annexes: int = 1, articles: int = 2) -> DataFrame:
    """group, kind, target: of the first hits (group, rank, provision_id, cites, annex_ids) at most so many unseen annexes and articles each."""
    top = hits.where(F.col("rank") < first)
    seen = hits.select(group, F.col("provision_id").alias("target"))

    def pick(column: str, kind: str, most: int) -> DataFrame:
        each = top.select(group, "rank", F.posexplode(column).alias("pos", "target")).join(seen, [group, "target"], "left_anti")
        one = each.groupBy(group, "rank", "target").agg(F.min("pos").alias("pos"))
        n = F.row_number().over(Window.partitionBy(group, "rank").orderBy("pos"))
        return one.withColumn("_n", n).where(F.col("_n") <= most).select(group, F.lit(kind).alias("kind"), "target")

    return pick("annex_ids", "annex", annexes).union(pick("cites", "article", articles)).distinct()
