"""Structural segmentation: lines of a legal text become articles, paragraphs, recitals, annexes and a preamble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions.text import ANYCASE, EXACT, bound, contains_any, strip

#: Patterns of running headers and footers.
RUNNING_HEADERS = (
    EXACT + r"^\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s*$",
    ANYCASE + r"^\s*(?:Page\s+)?\d+(?:\s*(?:of|/)\s*\d+)?\s*$",
    EXACT + r"^\s*L\s+\d+/\d+\s*$",
    ANYCASE + r"^\s*(?:Official Journal|Federal Register|Congressional Record|Statutes at Large).*",
    EXACT + r"^\s*(?:EN|FR|DE|ES|IT)\s*$",
    ANYCASE + r"^\s*(?:CONFIDENTIAL|DRAFT|PROPRIETARY)\s*$",
)
#: Words that mark qualifications, exemptions and liability.
QUALIFIERS = (
    "other than",
    "shall not apply",
    "shall not",
    "exempt",
    "exemption",
    "derogation",
    "exception",
    "except as provided",
    "notwithstanding",
    "subject to",
    "provided that",
    "unless",
    "jointly and severally",
    "liable",
    "liability",
)
#: Patterns of headings (alone on a line), of headings with a title, and of other parts.
ARTICLE_HEADING = ANYCASE + r"^\s*(?:Article|Art\.)\s+([0-9]+[a-z]?)\s*$"
ARTICLE_INLINE = EXACT + r"^\s*(?:Article|Art\.)\s+([0-9]+[a-z]?)\s+([A-Z][a-z].*)$"
SECTION_HEADING = ANYCASE + r"^\s*(?:Section|Sec\.|§|§§)\s*([0-9]+[a-z]?|[IVXLCDM]+)\s*$"
SECTION_INLINE = EXACT + r"^\s*(?:Section|Sec\.|§|§§)\s*([0-9]+[a-z]?|[IVXLCDM]+)\s+([A-Z].*)$"
CLAUSE_HEADING = ANYCASE + r"^\s*Clause\s+([0-9]+(?:\.[0-9]+)*)\s*$"
CLAUSE_INLINE = EXACT + r"^\s*Clause\s+([0-9]+(?:\.[0-9]+)*)\s+([A-Z].*)$"
SUPPLEMENT = ANYCASE + r"^\s*(?:ANNEX|SCHEDULE|EXHIBIT|APPENDIX)\s+([IVXLCDM0-9]+|[A-Z])\s*$"
PARAGRAPH = EXACT + r"^\s*(?:(\d+)\.|(\(\d+\)))\s*(.*)$"
RECITAL = ANYCASE + r"^\s*(?:\((\d+)\)|Whereas\s+)\s*(.*)$"
OTHER_ACT = ANYCASE + r"^(of\s+(the\s+)?(Directive|Regulation|Charter|Treaty|Act|Code)|thereof)"
CROSS_REFERENCE = ANYCASE + r"(?:Article|Art\.|Section|Sec\.|§|Clause|Rule)\s+([0-9]+[a-z]?(?:\s*(?:and|,)\s*[0-9]+[a-z]?)*)"
FIRST_NUMBERS = ("1", "101", "1.1", "I")


#: Letters that running headers begin with; others begin with a digit or beyond ASCII.
HEADER_LETTERS = "LEFDIpPoOfFcCsSdD"


def _begins(line: Column, letters: str) -> Column:
    """Whether line begins with one of the letters, or beyond ASCII, where cases and digits are many: cheap, and tried before patterns."""
    return bound(F.substring(line, 1, 1), lambda c: c.isin(*letters) | (c > "\x7f"))


def is_running_header(line: Column) -> Column:
    """Whether one of RUNNING_HEADERS fits a stripped line; all are tried in one pattern."""
    kinds = ["(?" + flags[2:-1] + ":" + "|".join(p.removeprefix(flags) for p in RUNNING_HEADERS if p.startswith(flags)) + ")" for flags in (EXACT, ANYCASE)]
    return _begins(line, HEADER_LETTERS + "0123456789") & line.rlike("|".join(kinds))


def _may_hold(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of the words (lower case) in any case; true of all that is not ASCII, where cases are many."""
    return (F.octet_length(text) != F.length(text)) | bound(F.lower(text), lambda low: contains_any(low, words))


def cross_references(text: Column, short_name: Column) -> Column:
    """Ids of the provisions that a text cites, in order, repetitions included. Plural keywords do not count."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CROSS_REFERENCE), F.lit(1)), lambda g: F.split(strip(g), EXACT + r"\s*(?:and|,)\s*"))
    ids = F.transform(F.filter(F.flatten(numbers), lambda n: n != ""), lambda n: F.concat(short_name, F.lit(":art:"), n))
    return F.when(_may_hold(text, ("art", "sec", "clause", "rule")), ids).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def qualification_terms(text: Column) -> Column:
    """The qualifiers in a text, in their own order."""
    return bound(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, QUALIFIERS)), lambda q: low.contains(q)))


#: What a line must begin with to be a heading of any kind or a supplement: tried before their patterns.
MAYBE_HEADING, HEADING_LETTERS = ANYCASE + r"^\s*(?:art|sec|§|clause|annex|schedule|exhibit|appendix)", "aAsScCeE"
#: The kinds of headings, in the order in which they are tried; those that end in i have a title on their line.
HEADINGS = {"ah": ARTICLE_HEADING, "ai": ARTICLE_INLINE, "sh": SECTION_HEADING, "si": SECTION_INLINE, "ch": CLAUSE_HEADING, "ci": CLAUSE_INLINE}
#: Stands for a place that does not exist, after all lines.
NOWHERE = 2**31 - 1


def _lines(text: Column) -> Column:
    """The stripped lines of a text that are neither blank nor running headers."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(x)), lambda x: (x != "") & ~is_running_header(x))


def _read(line: Column) -> Column:
    """What the words of a line say by themselves: kind of heading (its number, title, whether a text in passing), supplement, paragraph."""
    maybe = _begins(line, HEADING_LETTERS) & line.rlike(MAYBE_HEADING)
    kind, number, title = F.lit(None).cast("string"), lambda k: F.lit(None).cast("string"), lambda k: F.lit(None).cast("string")
    for name, p in reversed(HEADINGS.items()):
        kind = F.when(line.rlike(p), F.lit(name)).otherwise(kind)
        number = lambda k, name=name, p=p, rest=number: F.when(k == name, F.regexp_extract(line, p, 1)).otherwise(rest(k))
        if name.endswith("i"):
            title = lambda k, name=name, p=p, rest=title: F.when(k == name, strip(F.regexp_extract(line, p, 2))).otherwise(rest(k))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("passing"), F.lit(False).alias("supplement"))

    def heading(k: Column) -> Column:
        own = lambda t: F.struct(k.alias("kind"), number(k).alias("number"), t.alias("title"), F.coalesce(t.endswith(".") | t.rlike(OTHER_ACT), F.lit(False)).alias("passing"), line.rlike(SUPPLEMENT).alias("supplement"))
        return bound(title(k), own)

    said = F.when(maybe, bound(kind, heading)).otherwise(none)
    return F.struct(line.alias("line"), said.alias("h"), (_begins(line, "(0123456789") & line.rlike(PARAGRAPH)).alias("paragraph"))


def _place(flags: Column) -> Column:
    """The place of the first true one, from 0."""
    return F.coalesce(F.nullif(F.array_position(flags, True), F.lit(0)) - 1, F.lit(NOWHERE))


def _recitals(lines: Column) -> Column:
    """The recitals accepted among lines, which stand before the first provision; each depends on the last, so they are folded."""
    found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["h"]["kind"].isNull().alias("plain"), x["line"].alias("line"))), lambda x: x["plain"] & _begins(x["line"], "(wW") & x["line"].rlike(RECITAL))
    rows = F.transform(found, lambda x: F.struct(x["at"].alias("at"), F.nullif(F.regexp_extract(x["line"], RECITAL, 1), F.lit("")).try_cast("int").alias("n"), strip(F.regexp_extract(x["line"], RECITAL, 2)).alias("rest")))
    empty = F.struct(F.lit(0).alias("count"), F.array().cast("array<struct<at:int,n:int,rest:string>>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        return bound(F.coalesce(x["n"], s["count"] + 1), lambda n: F.when((n == s["count"] + 1) | (s["count"] == 0), F.struct(n.alias("count"), F.array_append(s["taken"], F.struct(x["at"].alias("at"), n.alias("n"), x["rest"].alias("rest"))).alias("taken"))).otherwise(s))

    return F.aggregate(rows, empty, step)["taken"]


def _start(at: Column, kind: str, number: Column, title: Column, rest: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("type"), number.alias("number"), title.alias("title"), rest.alias("rest"))


def _parts(lines: Column) -> Column:
    """The parts of a text whose lines have been read, in their order: at (the place of their first line), type, number, title, rest (of the first line)."""
    none = F.lit(None).cast("string")

    def within(supplement: Column) -> Column:
        opens = F.transform(lines, lambda x, i: F.coalesce(x["h"]["kind"].isNotNull() & ~x["h"]["passing"] & x["h"]["number"].isin(*FIRST_NUMBERS) & (i < supplement), F.lit(False)))
        return bound(_place(opens), lambda provision: starts(provision, supplement))

    def starts(provision: Column, supplement: Column) -> Column:
        inside = lambda i: (i >= provision) & (i < supplement)

        def consumed(x: Column, i: Column, before: Column) -> Column:
            """Whether a line is the title of a heading or supplement in the line before."""
            asks = F.coalesce(before["h"]["kind"].isin("ah", "sh", "ch"), F.lit(False)) & inside(i - 1) & (i < supplement)
            titular = ~F.coalesce(x["h"]["kind"].isin("ah", "sh", "ch"), F.lit(False)) & ~x["h"]["supplement"] & ~x["paragraph"]
            named = before["h"]["supplement"] & ~x["h"]["supplement"] & ~F.coalesce(x["h"]["kind"] == "ah", F.lit(False))
            return F.when(i > 0, (asks & titular & ~x["line"].rlike(OTHER_ACT)) | named).otherwise(F.lit(False))

        def start(x: Column, i: Column) -> Column:
            heading = x["h"]["kind"].isNotNull()
            line = x["line"]
            marked = F.coalesce(F.nullif(F.regexp_extract(line, PARAGRAPH, 1), F.lit("")), F.regexp_replace(F.regexp_extract(line, PARAGRAPH, 2), "[()]", ""))
            taken = consumed(x, i, F.get(lines, i - 1))
            return (
                F.when(x["h"]["supplement"], _start(i, "annex", F.regexp_extract(line, SUPPLEMENT, 1), x["h"]["title"], none))
                .when(inside(i) & heading & ~x["h"]["passing"] & ~taken, _start(i, "article", x["h"]["number"], x["h"]["title"], none))
                .when(inside(i) & ~heading & x["paragraph"] & (i > provision) & ~taken, _start(i, "paragraph", marked, none, strip(F.regexp_extract(line, PARAGRAPH, 3))))
            )

        def whole(opened: Column) -> Column:
            # headings that are refused before anything is open are dropped; later they are content
            plain = _place(F.transform(lines, lambda x: x["h"]["kind"].isNull()))
            dropped = F.least(plain, provision, supplement, F.size(lines))
            first = F.coalesce(F.get(opened, F.lit(0))["at"], F.size(lines))
            preamble = F.when(first > 0, F.array(_start(dropped, "preamble", F.lit(""), none, none))).otherwise(F.slice(opened, 1, 0))
            return bound(F.concat(preamble, opened), filled)

        def filled(parts: Column) -> Column:
            """parts with their place among the parts with a first line (0: what stands before them all), title and text."""
            base = F.when(F.get(parts, F.lit(0))["type"] == "preamble", 0).otherwise(1)

            def fill(x: Column, k: Column) -> Column:
                end = F.coalesce(F.get(parts, k + 1)["at"], F.size(lines))
                after = x["at"] + F.when(x["type"] == "preamble", 0).otherwise(1)
                titled = F.when(x["type"].isin("article", "annex") & (after < end), bound(F.struct(F.get(lines, after).alias("x"), F.get(lines, x["at"]).alias("b")), lambda p: consumed(p["x"], after, p["b"]))).otherwise(F.lit(False))

                def made(named: Column) -> Column:
                    begin = after + F.when(named, 1).otherwise(0)
                    body = F.transform(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), lambda y: y["line"])
                    text = strip(F.array_join(F.concat(F.when(x["rest"] != "", F.array(x["rest"])).otherwise(F.array().cast("array<string>")), body), "\n"))
                    default = F.when(x["type"] == "article", F.lit("Provision ")).when(x["type"] == "annex", F.lit("Annex ")).when(x["type"] == "recital", F.lit("Recital (")).when(x["type"] == "paragraph", F.lit("Paragraph "))
                    title = F.coalesce(x["title"], F.when(named, F.get(lines, after)["line"]), F.concat(default, x["number"], F.when(x["type"] == "recital", F.lit(")")).otherwise(F.lit(""))))
                    said = lambda t: F.struct((k + base).cast("int").alias("ord"), x["type"].alias("type"), x["number"].alias("number"), title.alias("title"), F.when((t == "") & (x["type"] == "article"), title).otherwise(t).alias("text"), (k == F.size(parts) - 1).alias("last"))
                    return bound(text, said)

                return bound(titled, made)

            return F.transform(parts, fill)

        early = F.transform(_recitals(F.slice(lines, 1, F.least(provision, supplement, F.size(lines)))), lambda r: _start(r["at"], "recital", r["n"].cast("string"), none, r["rest"]))
        return bound(F.concat(early, F.filter(F.transform(lines, start), lambda x: x.isNotNull())), whole)

    return bound(_place(F.transform(lines, lambda x: x["h"]["supplement"])), within)


def _grouped(parts: Column) -> Column:
    """Each part with the number of the article that it stands in or under, and, of an article, its paragraphs; those of articles of one number are one list."""
    kept = lambda x: (x["text"] != "") | (x["type"] == "article")
    heads = F.filter(F.transform(parts, lambda x, i: F.when((i == 0) | (x["type"] == "article"), i)), lambda i: i.isNotNull())

    def split(at: Column) -> Column:
        def group(i: Column, j: Column) -> Column:
            own = F.slice(parts, i + 1, F.coalesce(F.get(at, j + 1), F.size(parts)) - i)
            paragraphs = F.transform(F.filter(own, lambda x: (x["type"] == "paragraph") & kept(x)), lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text")))
            return F.struct(F.when(F.get(parts, i)["type"] == "article", F.get(parts, i)["number"]).alias("article"), own.alias("own"), paragraphs.alias("paragraphs"))

        return bound(F.transform(at, group), joined)

    def joined(groups: Column) -> Column:
        numbers = F.transform(groups, lambda g: g["article"])
        again = bound(numbers, lambda ns: F.when(F.size(F.array_distinct(ns)) < F.size(ns), F.filter(ns, lambda n, i: F.array_position(ns, n) < i + 1)).otherwise(F.slice(ns, 1, 0)))

        def rows(twice: Column) -> Column:
            def row(g: Column) -> Column:
                paragraphs = F.when(F.array_contains(twice, g["article"]), F.flatten(F.transform(F.filter(groups, lambda o: o["article"] == g["article"]), lambda o: o["paragraphs"]))).otherwise(g["paragraphs"])
                out = lambda ps: F.transform(F.filter(g["own"], kept), lambda x: F.struct(*[x[c].alias(c) for c in ("ord", "type", "number", "title", "text", "last")], g["article"].alias("article"), F.when((x["type"] == "article") & (F.size(ps) > 0), ps).alias("paragraphs")))
                return bound(paragraphs, out)

            return F.flatten(F.transform(groups, row))

        return bound(again, rows)

    return bound(heads, split)


def _segments(docs: DataFrame) -> DataFrame:
    """segments() with paragraphs: of an article, number and text of its paragraphs."""
    parts = bound(_lines(F.col("text")), lambda lines: bound(F.transform(lines, _read), lambda read: bound(_parts(read), _grouped)))
    # outer, as the filter that Spark infers for an inner one would evaluate the whole expression once more
    rows = docs.select("doc_id", "short_name", F.explode_outer(parts).alias("s")).where("s IS NOT NULL")
    sn = F.col("short_name")
    rows = rows.select("doc_id", "short_name", "s.ord", F.col("s.type").alias("chunk_type"), "s.number", "s.title", "s.text", "s.last", F.concat(sn, F.lit(":art:"), "s.article").alias("article"), "s.paragraphs")
    kind = F.col("chunk_type")
    id_ = F.when(kind == "article", F.col("article")).when(kind == "paragraph", F.concat("article", F.lit(":para:"), "number")).when(kind == "preamble", F.concat(sn, F.lit(":preamble"))).otherwise(F.concat(sn, F.lit(":"), kind, F.lit(":"), "number"))
    parent = F.when(kind.isin("article", "paragraph"), F.col("article")).when((kind == "annex") & F.col("last"), id_).otherwise(F.concat(sn, F.lit(":root")))
    return rows.select("doc_id", "short_name", "ord", id_.alias("id"), "chunk_type", "number", "title", "text", parent.alias("parent_id"), "paragraphs")


def segments(docs: DataFrame) -> DataFrame:
    """One row for each provision before roll-up: doc_id, short_name, ord, id, chunk_type, number, title, text, parent_id.

    docs has doc_id, short_name and text. All rules are functions of arrays of a document's lines, which stay one row, as they were when they were its text: nothing is
    shuffled, sorted or written, and what stands after it in a plan is still dealt out as docs is.
    """
    return _segments(docs).drop("paragraphs")


def chunks(docs: DataFrame) -> DataFrame:
    """segments with roll-up of articles, children, cross references (of the text before roll-up) and qualification tags. Nothing is shuffled or written."""
    seg = _segments(docs).withColumn("intro", F.col("text"))
    article = F.col("chunk_type") == "article"
    blocks = F.transform("paragraphs", lambda p: bound(F.concat(p["number"], F.lit(".")), lambda prefix: F.when(p["text"].startswith(prefix), p["text"]).otherwise(F.concat(prefix, F.lit(" "), p["text"]))))
    lead = F.when(~F.col("intro").contains(F.col("title")), F.col("title"))
    rolled = F.concat_ws("\n\n", lead, F.when((F.col("intro") != "") & (F.col("intro") != F.col("title")), F.col("intro")), F.array_join(blocks, "\n\n"))
    plain = F.when(lead.isNotNull(), F.concat(F.col("title"), F.lit("\n\n"), F.col("intro"))).otherwise(F.col("intro"))
    text = F.when(article, strip(F.when(F.col("paragraphs").isNotNull(), rolled).otherwise(plain))).otherwise(F.col("intro"))
    seg = seg.withColumn("text", text)
    early = F.when(article, qualification_terms(F.col("intro")))
    terms = bound(qualification_terms(F.col("text")), lambda t: F.when(F.size(t) > 0, t).otherwise(F.coalesce(early, t)))
    children = F.transform("paragraphs", lambda p: F.concat("id", F.lit(":para:"), p["number"]))
    return seg.withColumn("qualification_terms", terms).select(
        "doc_id", "short_name", "ord", "id", "chunk_type", "number", "title", "text", "parent_id",
        F.coalesce(children, F.array().cast("array<string>")).alias("children_ids"),
        cross_references(F.col("intro"), F.col("short_name")).alias("cross_references"),
        (F.size("qualification_terms") > 0).alias("has_qualifications"),
        "qualification_terms",
    )


def hierarchy(chunk_table: DataFrame) -> DataFrame:
    """doc_id, parent_id, children: ids in the order of the text."""
    return chunk_table.groupBy("doc_id", "parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("children"))
