"""Main text of web pages: element subtrees that recur across a host's pages are templates and go; so do page furniture and markup.

A subtree recurs by its content (tags and words), wherever it stands, or by its frame (tags and attributes without words) outside of articles:
a menu, an advert's box and a footer have other words on each page, but the same frame.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, staged

#: Fixed values of HTML: elements without content, with raw content, that never hold visible text, and that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
HIDDEN = frozenset("head script style title noscript iframe noframes noembed template svg canvas object audio video map select option datalist button input textarea form dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Page furniture by element, by role and by a word of class or id.
FURNITURE = frozenset("nav header footer aside menu".split())
FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORD = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that may stand beside one of those in a class or id: "share-buttons" is furniture, "share-price" is not.
NEUTRAL_WORD = frozenset("area bar block body bottom box button buttons col column container content group holder icon icons inner item items label left link links list main outer panel right row section site slot top unit wrap wrapper".split())
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_P = BLOCK - {"body", "html", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: What a template may be: containers, never a paragraph, heading, list item or table part of an article.
CONTAINER = frozenset("div section ul ol dl table figure details center fieldset blockquote".split())
#: What a frame template may be, besides those.
FRAMED = CONTAINER | FURNITURE | {"form", "search", "address"}
#: A template stands on so many different pages of a host, however many the host has.
LEAST_PAGES = 5
#: A table of so many templates is broadcast (16 bytes each, and the hosts' names); a larger one is joined to the pages, with the same results.
BROADCAST_TEMPLATES = 500_000

#: One attribute by the standard's states: quotes open a value only after the equals sign; elsewhere they belong to the name or to the bare value.
_ATTRIBUTE = r"(?>=[^\s/>=]*+|[^\s/>=]++)(?>\s*+=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?")
READ = frozenset("class id role hidden aria-hidden style".split())
SOME_READ = re.compile("class|id|role|hidden|style", re.I)
WORDS = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"[0-9]+")


#: Last words of a class or id that is one of reader comments, and words before them that say something else.
COMMENT_WORD = frozenset("comment comments commentlist".split())
NO_COMMENT = frozenset("has with no without show hide".split())
#: Headings under which other articles are announced.
TEASER = re.compile(r"\W*(?:related|more|read more|read next|read also|see also|recommended|you (?:may|might) also like|also on|most read|popular|trending|latest)\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a label is part of the text and no control's.
PROSE = frozenset("p li td th dd dt blockquote figcaption pre h1 h2 h3 h4 h5 h6".split())


class Element:
    """One element: tag, furniture or not (by its class or id alone, where by_name), name (tag, class, id and role), children (elements and strings), and its subtree's hashes."""

    __slots__ = ("by_name", "children", "digest", "frame", "name", "out", "tag")

    def __init__(self, tag: str, out: bool, name: str = "", by_name: bool = False):
        self.tag, self.out, self.name, self.by_name, self.children, self.digest, self.frame = tag, out, name or tag, by_name, [], 0, 0


def _comments(words: list[str]) -> bool:
    return bool(words) and words[-1] in COMMENT_WORD and NO_COMMENT.isdisjoint(words)


def _marked(value: str, every: bool = False) -> bool:
    """Whether a class or id is furniture: one of its parts (every: each of them) has a word of furniture and beside it only neutral ones; or one ends in comments."""
    parts = [WORDS.findall(part) for part in value.split()]
    own = [not FURNITURE_WORD.isdisjoint(words) and all(w in FURNITURE_WORD or w in NEUTRAL_WORD for w in words) for words in parts]
    return any(map(_comments, parts)) or (all(own) and bool(own) if every else any(own))


def _furniture(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether an element is furniture or hidden, its name, and whether it is furniture by class or id alone. Of an attribute that stands twice the first counts."""
    out, name, by_name, seen = tag in FURNITURE, tag, False, set()
    if attributes and SOME_READ.search(attributes):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key not in READ or key in seen:
                continue
            seen.add(key)
            if key in ("class", "id", "role"):
                name += f" {key}={DIGITS.sub('0', value)}"
            if tag in ("html", "body"):
                continue
            out = (
                out
                or key == "hidden" and value != "until-found"
                or key == "aria-hidden" and value == "true"
                or key == "style" and UNSEEN.search(value) is not None
                or key == "role" and value in FURNITURE_ROLE
            )
            by_name = by_name or key in ("class", "id") and tag != "main" and _marked(value, tag == "article")
    return out or by_name, name, by_name and not out


class _Open:
    """The open elements, and where in their stack each tag stands, so that no end tag has to look for its element."""

    def __init__(self, root: Element):
        self.stack, self.at, self.blocks, self.walls = [root], {}, [], []

    def push(self, e: Element) -> None:
        k = len(self.stack)
        self.stack.append(e)
        self.at.setdefault(e.tag, []).append(k)
        if e.tag in BLOCK:
            self.blocks.append(k)
        if e.tag in WALLS:
            self.walls.append(k)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            e = self.stack.pop()
            self.at[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()
            if e.tag in WALLS:
                self.walls.pop()

    def last(self, tags) -> int:
        """The place of the last open one of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


#: What an end tag of no block does not close across.
WALLS = frozenset("article main td th table".split())


def parse(page: str) -> Element:
    """The page's tree, in time that follows its length. Unclosed elements end where HTML ends them; stray end tags are left out."""
    root = Element("", False)
    at, n = 0, len(page)
    open_ = _Open(root)
    stack = open_.stack
    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            stack[-1].children.append(page[at:less])
        if less == n:
            break
        m = TOKEN.match(page, less)
        if m is None:
            stack[-1].children.append("<")
            at = less + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            k = open_.last((tag,))
            if not k:
                if tag in ("br", "p"):
                    stack[-1].children.append(Element(tag, False))
            elif tag in BLOCK or tag in WALLS or not open_.walls or open_.walls[-1] < k:
                open_.cut(k)
            continue
        if tag in ENDS_P and open_.blocks and stack[open_.blocks[-1]].tag == "p":
            open_.cut(open_.blocks[-1])
        if tag in ENDS:
            while (k := open_.last(ENDS[tag])) > open_.last(SCOPE[tag]):
                open_.cut(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        element = Element(tag, *_furniture(tag, m[3]))
        stack[-1].children.append(element)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = _close(tag).search(page, at)
            at = close.end() if close else n
            continue
        if tag == "label" and not (open_.blocks and stack[open_.blocks[-1]].tag in PROSE):
            element.out = True
        open_.push(element)
    settle(root)
    return root


@functools.cache
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def settle(root: Element) -> None:
    """What only the whole page tells: a form around an article, or around most of the page's words, is no form; nor is an element with these furniture for a class or id alone,
    but for reader comments; a header of an article with a heading is its own; articles announced under a heading of related ones go."""
    order = _post_order(root)
    size: dict[int, int] = {}
    holds: set[int] = set()  # has an article or main element in it
    headed: set[int] = set()  # has a heading in it
    for e in order:
        total = 0
        for c in e.children:
            if isinstance(c, Element):
                total += size[id(c)]
                if c.tag in ("article", "main") or id(c) in holds:
                    holds.add(id(e))
                if c.tag in HEADINGS or id(c) in headed:
                    headed.add(id(e))
            else:
                total += len(c) - c.count(" ") - c.count("\n")
        size[id(e)] = total
    every = size[id(root)]
    for e in order:
        most = 2 * size[id(e)] > every
        if e.tag == "form" and (id(e) in holds or most):
            e.tag = "div"
        elif e.by_name and e.out and most and (id(e) in holds or e.tag == "article") and not _comments(WORDS.findall(e.name)):
            e.out = False
        elif e.tag == "article":
            for c in e.children:
                if isinstance(c, Element) and c.tag == "header" and not c.by_name and id(c) in headed:
                    c.tag, c.out = "div", False
        announced = False
        for c in e.children:
            if isinstance(c, Element):
                if c.tag in HEADINGS and c.tag != "h1":
                    announced = TEASER.match("".join(x for x in c.children if isinstance(x, str))) is not None
                elif announced and c.tag == "article" and 2 * size[id(c)] <= every:
                    c.out = True


def _post_order(root: Element) -> list[Element]:
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack.extend(c for c in e.children if isinstance(c, Element))
    order.reverse()
    return order


def _hash(parts: list[str]) -> int:
    return xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def digests(root: Element) -> None:
    """Give every element the hash of its tag and content, in which white space between words does not count, and of its frame, in which
    elements that repeat side by side count once."""
    for e in _post_order(root):
        parts, frame, last = [e.tag], ["frame", e.name], None
        for c in e.children:
            if isinstance(c, Element):
                parts.append(f"\x01{c.digest}")
                if c.frame != last:
                    frame.append(str(c.frame))
                    last = c.frame
            else:
                parts.append(" ".join(c.split()))
        e.digest, e.frame = _hash(parts), _hash(frame)


def main_roots(root: Element) -> list[Element]:
    """The outermost articles, after the main element's h1 that stands before them; else main elements; else the whole page. Those inside furniture, or furniture themselves
    (comments, say), do not count."""
    for tag in ("article", "main"):
        found, titles, stack = [], [], [(root, False)]
        while stack:
            e, within = stack.pop()
            if e.out or e.tag in HIDDEN:
                continue
            if e.tag == tag:
                found.append(e)
            elif within and e.tag == "h1" and not found:
                titles.append(e)
            else:
                stack.extend((c, within or e.tag == "main") for c in reversed(e.children) if isinstance(c, Element))
        if found:
            return titles + found
    return [root]


def candidates(root: Element) -> set[int]:
    """Hashes of the subtrees of this page that could be templates: the contents of all its containers, and the frames of those that
    have no article or main element in or around them and, on pages without any, whose text is mostly links."""
    digests(root)
    found = {e.digest for e in _post_order(root) if e.tag in CONTAINER}
    return found | {e.frame for e in _framed(root)}


def _framed(root: Element) -> list[Element]:
    tops = main_roots(root)
    inside = {id(e) for t in tops if t is not root for e in _post_order(t)}
    around: set[int] = set()
    linked: dict[int, tuple[int, int]] = {}
    out = []
    for e in _post_order(root):
        kids = [c for c in e.children if isinstance(c, Element)]
        if id(e) in inside or any(id(c) in inside or id(c) in around for c in kids):
            around.add(id(e))
        text = sum(len("".join(c.split())) for c in e.children if not isinstance(c, Element)) + sum(linked[id(c)][0] for c in kids)
        linked[id(e)] = (text, text if e.tag == "a" else sum(linked[id(c)][1] for c in kids))
        if e.tag in FRAMED and id(e) not in around and (inside or 2 * linked[id(e)][1] > text > 0):
            out.append(e)
    return out


def text_of(root: Element, templates: frozenset[int] | set[int], lists: bool = True) -> str:
    """Blocks in page order, white space inside each made one space, joined by line breaks.

    Templates go first, from the whole page; of what is left, without the furniture of the lists, the main part stays. Without lists, all that is left stays.
    """
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            if found := WHITE.sub(" ", html.unescape("".join(line))).strip():
                blocks.append(found)
            line.clear()

    gone: set[int] = set()
    if templates:
        digests(root)
        gone = {id(e) for e in _framed(root) if e.frame in templates} | {id(e) for e in _post_order(root) if e.tag in CONTAINER and e.digest in templates}
    for top in main_roots(root) if lists else [root]:
        stack: list = [top]
        while stack:
            e = stack.pop()
            if e is None:
                close()
            elif isinstance(e, str):
                line.append(e)
            elif e.tag == "br":
                line.append(" ")
            elif e.out and lists or e.tag in HIDDEN or e is not top and id(e) in gone:
                if e.tag in BLOCK:
                    close()
            elif e.tag in BLOCK:
                close()
                stack.append(None)
                stack.extend(reversed(e.children))
            else:
                stack.extend(reversed(e.children))
        close()
    return "\n".join(blocks)


def main_text(root: Element, templates: frozenset[int] | set[int]) -> str:
    """The page's text without templates; where they hold all of its text, they are no templates of this page."""
    return text_of(root, templates) or (text_of(root, frozenset()) if templates else "")


def template_hashes(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, digest: subtrees (by content or frame) found on least_pages different pages of the host, as a staged table.

    Pages of equal content (tags and words) count once. The table of subtrees follows the corpus; different pages are told apart by
    host, subtree and content, and counted in part before rows move, so a host with a third of all pages is no burden.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, contents, hashes = [], [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                root = parse(page or "")
                found = candidates(root)
                at += [k] * len(found)
                contents += [root.digest] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(contents, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "content", "digest"])

    keyed = pages.select(_host(F.col("url")).alias("host"), "html")
    found = keyed.mapInArrow(run, "host string, content long, digest long")
    common = found.groupBy("host", "digest", "content").agg(F.count("*").alias("n")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    return staged(common.where(F.col("n") >= least_pages).select("host", "digest"), "templates")


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null, empty and text-free pages give an empty text; a null url is a host of its own; repeated pages give repeated rows; pages
    without an article or main element are read whole. Columns other than page_id, url and html are not read.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    templates = template_hashes(bounded_batches(pages, 500))
    own = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def out(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        texts = [main_text(parse(page or ""), hashes) for page, hashes in zip(batch.column(2).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if templates.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for host, digest in zip(*(c.to_pylist() for c in templates.toArrow().columns), strict=True):
            by_host.setdefault(host, set()).add(digest)
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield out(batch, [shared.value.get(h, frozenset()) for h in batch.column(3).to_pylist()])

        return own.mapInArrow(run, schema)

    # each different page of a host meets the templates that it holds, so no host's pages have to meet in one place
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(parse(page or "")) for page in batch.column(2).to_pylist()]
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([d for x in found for d in x], pa.int64())], names=["host", "page", "digest"])

    page = F.xxhash64("html")
    rows = own.select("host", page.alias("page"), "html").mapInArrow(held, "host string, page long, digest long").distinct()
    mine = rows.join(templates, ["host", "digest"]).groupBy("host", "page").agg(F.collect_list("digest").alias("hashes"))
    joined = own.withColumn("page", page).join(mine, ["host", "page"], "left").select("page_id", "url", "html", "hashes")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [frozenset(x or ()) for x in batch.column(3).to_pylist()])

    return joined.mapInArrow(run_joined, schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
