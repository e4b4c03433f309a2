"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, queried by every passage of the corpus.

Scores are shares of an item's own score: 1 means that all its terms occur. All items with a share of THRESHOLD or more are
retrieved (safe pruning, no top-k), then the overlap of question and answer with the passage is verified by word 5-grams
or, part by part, by the words to change, insert or leave out. Items too short for that are found by their exact words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bounded_batches, mix, released, slices, span_hashes, spans, utf8

K1, B, THRESHOLD = 1.2, 0.75, 0.5
#: Words a gram; share of an item's words, and of its question's and its answer's, that must be found in the passage.
GRAM, COVER, PART_COVER = 5, 0.8, 0.5
#: Items with fewer words are reported where exactly their words stand one after the other.
LEAST_WORDS = 5
#: Items a posting block.
POSTING_BLOCK = 4
#: Items are indexed by length, up to so many words times a power of four, so that a passage is no more than eight times as long as its items.
SHORTEST_BUCKET = 64
#: Bytes of items in one index. A larger benchmark is dealt to several indexes, each of which scans the documents.
INDEX_BYTES = 16 << 20

_PLACE = np.random.default_rng(5).integers(1, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII bytes that are no letter or digit separate words; other bytes belong to words.
_FOLD = LOWER.copy()
_FOLD[[c for c in range(128) if not (48 <= c < 58 or 97 <= LOWER[c] <= 122)]] = 32
assert SPACE[32]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; case and ASCII punctuation do not count."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    data = _FOLD[data]
    start, end, row = spans(data, off)
    return span_hashes(data, start, end), row


def _grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    return mix(sum(words[k : k + n] * _PLACE[k] for k in range(GRAM))) if n > 0 else np.zeros(0, np.uint64)


def _question_words(text: str) -> int:
    """Words of the question: up to the last question mark; else before the last line; else before the last sentence; else two thirds."""
    cut = text.rstrip().rfind("?") + 1
    body = text.rstrip()
    if cut and cut < len(body):
        head = body[:cut]
    elif (k := max(body.rfind("\n"), 0)) or (k := max(body.rstrip(".!?").rfind(". "), 0)):
        head = body[: k + 1]
    else:
        n = len(_words(pa.array([body]))[0])
        return max(1, 2 * n // 3) if n > 1 else n
    return len(_words(pa.array([head]))[0])


@dataclass
class Index:
    """Terms (sorted hashes); postings by term and block of POSTING_BLOCK items, with each block's maximum; items' words for verification."""

    terms: np.ndarray
    common: np.ndarray  # terms that alone never decide; their part of a block's bound is rest
    rest: np.ndarray
    block_start: np.ndarray  # by term, into block_no and block_max
    block_no: np.ndarray
    block_max: np.ndarray
    posting_start: np.ndarray  # by entry of block_no, into posting_slot and posting_weight
    posting_slot: np.ndarray
    posting_weight: np.ndarray
    ids: list
    words: list[np.ndarray]
    question: list[int]
    own: np.ndarray
    passage: int  # words of a stride: the length of the longest item of the bucket
    short: list[tuple[np.ndarray, object, float]] = field(default_factory=list)  # words, id and BM25 score of items under LEAST_WORDS


def _build(ids: list, texts: list[str], n_items: int, mean_words: float, df: dict[int, int] | None = None) -> Index:
    """The index of one bucket of items."""
    h, row = _words(pa.array(texts, pa.string()))
    n = np.bincount(row, minlength=len(ids))
    use = np.flatnonzero(n >= LEAST_WORDS)
    first = np.cumsum(n) - n
    words = [h[first[i] : first[i] + n[i]] for i in use]
    short = []
    brief = np.flatnonzero((n > 0) & (n < LEAST_WORDS))
    if len(brief):
        known = df
        if known is None:
            each = np.unique(np.column_stack([row.astype(np.uint64), h]), axis=0)[:, 1]
            known = dict(zip(*(x.tolist() for x in np.unique(each, return_counts=True)), strict=True))
        for i in brief:
            w = h[first[i] : first[i] + n[i]]
            terms, tf = np.unique(w, return_counts=True)
            count = np.array([known[int(t)] for t in terms])
            weights = np.log(1 + (n_items - count + 0.5) / (count + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / max(mean_words, 1)))
            short.append((w, ids[i], float(weights.sum())))
    # items with like openings share blocks, which keeps block maxima close to their items
    order = sorted(range(len(use)), key=lambda k: texts[use[k]][:40])
    use, words = use[order], [words[k] for k in order]
    item = np.repeat(np.arange(len(use)), [len(w) for w in words])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    terms, term = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * max(len(use), 1) + item, return_counts=True)
    term, item = pair // max(len(use), 1), pair % max(len(use), 1)
    count = np.bincount(term, minlength=len(terms)) if df is None else np.array([df[int(t)] for t in terms], np.int64)
    idf = np.log(1 + (n_items - count + 0.5) / (count + 0.5))
    size = np.array([len(w) for w in words], float)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(mean_words, 1))) if len(term) else np.zeros(0)
    own = np.bincount(item, weight, minlength=len(use))
    share = weight / own[item] if len(term) else weight
    # common terms: the most frequent ones, as long as in nine items of ten they make up less than half of the threshold
    common = np.zeros(len(terms), bool)
    part = np.zeros(len(use))
    by = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[by], np.arange(len(terms) + 1))
    for t in np.argsort(-count, kind="stable"):
        its = by[begin[t] : begin[t + 1]]
        part[item[its]] += share[its]
        if len(use) and np.quantile(part, 0.9) > THRESHOLD / 2:
            part[item[its]] -= share[its]
            break
        common[t] = True
    n_blocks = len(use) // POSTING_BLOCK + 1
    rest = np.zeros(n_blocks)
    np.maximum.at(rest, np.arange(len(use)) // POSTING_BLOCK, part)
    key = term * n_blocks + item // POSTING_BLOCK
    order = np.argsort(key, kind="stable")
    key, item, share = key[order], item[order], share[order]
    blocks, starts = np.unique(key, return_index=True)
    return Index(
        terms, common, rest, np.searchsorted(blocks // n_blocks, np.arange(len(terms) + 1)), blocks % n_blocks, np.maximum.reduceat(share, starts) if len(starts) else np.zeros(0),
        np.r_[starts, len(share)], item % POSTING_BLOCK, share, [ids[i] for i in use], words, [_question_words(texts[i]) for i in use], own, max([SHORTEST_BUCKET, *map(len, words)]), short,
    )


def build_index(ids: list, texts: list[str], n_items: int, mean_words: float, df: dict[int, int] | None = None) -> list[Index]:
    """The index of these items, a part for each bucket of lengths; n_items, mean_words and df are of the whole benchmark (df None: these items are all)."""
    h, row = _words(pa.array(texts, pa.string()))
    if df is None:
        each = np.unique(np.column_stack([row.astype(np.uint64), h]), axis=0)[:, 1] if len(h) else h
        df = dict(zip(*(x.tolist() for x in np.unique(each, return_counts=True)), strict=True))
    size = np.bincount(row, minlength=len(ids))
    bucket = np.ceil(np.log(np.maximum(size, SHORTEST_BUCKET) / SHORTEST_BUCKET) / np.log(4) - 1e-9).astype(int)
    parts = [np.flatnonzero(bucket == b).tolist() for b in np.unique(bucket)]
    return [_build([ids[i] for i in p], [texts[i] for i in p], n_items, mean_words, df) for p in parts]


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start .. start + count of each, one after the other, and whose they are."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum())), owner


def retrieve(index: Index, h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word in the row, item and share of all (passage, item) at THRESHOLD or more.

    Passages are windows of two strides that begin at each stride, so any run of words as long as an item lies in one. Block
    bounds come first: the rare terms' block maxima plus the common terms' most in that block; only blocks whose bound reaches
    the threshold have their postings read.
    """
    none = np.zeros(0, np.int64)
    if not len(index.ids) or not len(h):
        return none, none, none, np.zeros(0)
    stride = index.passage
    n_words = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n_words) - n_words
    n_pass = np.where(n_words > 0, np.maximum(1, -(-n_words // stride) - 1), 0)
    pass_first = np.cumsum(n_pass) - n_pass
    term = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[term] == h)
    term, owner = term[hit], row[hit]
    place = (hit - first[owner]) // stride
    n_terms = len(index.terms)
    here, there = place < n_pass[owner], place > 0
    key = np.concatenate([(pass_first[owner] + place)[here] * n_terms + term[here], (pass_first[owner] + place - 1)[there] * n_terms + term[there]])
    key = np.unique(key)
    passage, term = key // n_terms, key % n_terms
    n_blocks = len(index.rest)
    rare = np.flatnonzero(~index.common[term])
    at, who = _spread(index.block_start[term[rare]], index.block_start[term[rare] + 1] - index.block_start[term[rare]])
    pairs, inverse = np.unique(passage[rare][who] * n_blocks + index.block_no[at], return_inverse=True)
    bound = np.bincount(inverse, index.block_max[at], minlength=len(pairs)) + index.rest[pairs % n_blocks]
    pairs = pairs[bound >= THRESHOLD - 1e-9]
    open_ = index.rest >= THRESHOLD - 1e-9
    if open_.any():  # blocks that common terms alone may decide are bounded by the maxima of all terms that the passage has
        at, who = _spread(index.block_start[term], index.block_start[term + 1] - index.block_start[term])
        own = open_[index.block_no[at]]
        more, inverse = np.unique(passage[who[own]] * n_blocks + index.block_no[at[own]], return_inverse=True)
        pairs = np.union1d(pairs, more[np.bincount(inverse, index.block_max[at[own]], minlength=len(more)) >= THRESHOLD - 1e-9])
    # read the postings of all terms of the passage in these blocks
    begin, end = np.searchsorted(passage, pairs // n_blocks), np.searchsorted(passage, pairs // n_blocks, "right")
    at, who = _spread(begin, end - begin)
    block_key = np.repeat(np.arange(n_terms), np.diff(index.block_start)) * n_blocks + index.block_no
    want = term[at] * n_blocks + (pairs % n_blocks)[who]
    entry = np.minimum(np.searchsorted(block_key, want), len(block_key) - 1)
    found = block_key[entry] == want
    entry, who = entry[found], who[found]
    at, again = _spread(index.posting_start[entry], index.posting_start[entry + 1] - index.posting_start[entry])
    score = np.bincount(who[again] * POSTING_BLOCK + index.posting_slot[at], index.posting_weight[at], minlength=len(pairs) * POSTING_BLOCK)
    good = np.flatnonzero(score >= THRESHOLD)
    pair = pairs[good // POSTING_BLOCK]
    number = pair // n_blocks
    doc = np.searchsorted(pass_first + n_pass, number, "right")
    return doc, (number - pass_first[doc]) * stride, pair % n_blocks * POSTING_BLOCK + good % POSTING_BLOCK, score[good]


def _edits(part: list[int], passage: list[int]) -> int:
    """Fewest words to change, insert or leave out so that part stands somewhere in the passage (Myers's bit-parallel search)."""
    m = len(part)
    mask, top, same = (1 << m) - 1, 1 << (m - 1), {}
    for k, w in enumerate(part):
        same[w] = same.get(w, 0) | 1 << k
    up, down, score, best = mask, 0, m, m
    for w in passage:
        eq = same.get(w, 0)
        x = eq | down
        y = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(y | up) & mask, up & y
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & mask, less << 1 & mask
        up, down = less | ~(x | more) & mask, more & x
        best = min(best, score)
    return best


def _short(index: Index, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """Rows of find() for items under LEAST_WORDS: the first place of their exact words in each text."""
    for words, item, score in index.short:
        n = len(h) - len(words) + 1
        if n <= 0:
            continue
        here = row[:n] == row[len(words) - 1 :]
        for k, w in enumerate(words):
            here &= h[k : k + n] == w
        at = np.flatnonzero(here)
        doc, where = np.unique(row[at], return_index=True)
        yield from ((d, item, score, 1.0, 1.0, 1.0, p) for d, p in zip(doc.tolist(), (at[where] - first[doc]).tolist(), strict=True))


def find(indexes: list[Index], texts: pa.Array) -> list[tuple[int, object, float, float, float, float, int]]:
    """row, item id, BM25 score, share of words covered, of the question, of the answer, first word of the passage: the best passage of each verified item."""
    h, row = _words(texts)
    n_words = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    out = []
    for index in indexes:
        out += _verified(index, h, row, n_words, first) + list(_short(index, h, row, first))
    return sorted(out, key=lambda x: x[0])


def _verified(index: Index, h: np.ndarray, row: np.ndarray, n_words: np.ndarray, first: np.ndarray) -> list[tuple]:
    """Rows of find() for the items of one part of the index."""
    best: dict[tuple[int, int], tuple] = {}
    for doc, begin, item, share in zip(*(x.tolist() for x in retrieve(index, h, row, len(n_words))), strict=True):
        a = first[doc] + begin
        words = index.words[item]
        hit = np.flatnonzero(np.isin(_grams(words), _grams(h[a : min(a + 2 * index.passage, first[doc] + n_words[doc])])))
        covered = np.zeros(len(words), bool)
        for k in range(GRAM):
            covered[hit + k] = True
        q = index.question[item]
        parts = [float(x.mean()) if len(x) else 1.0 for x in (covered, covered[:q], covered[q:])]
        if parts[0] < COVER or min(parts) < PART_COVER:  # altered, or a part shorter than a gram: each part by itself
            passage = h[a : min(a + 2 * index.passage, first[doc] + n_words[doc])].tolist()
            size = [q, len(words) - q]
            found = [max(x * n, n - _edits(part, passage)) if n else 0 for x, n, part in zip(parts[1:], size, (words[:q].tolist(), words[q:].tolist()), strict=True)]
            parts = [sum(found) / len(words), *(x / n if n else 1.0 for x, n in zip(found, size, strict=True))]
        if parts[0] >= COVER and min(parts) >= PART_COVER and parts > best.get((doc, item), (0, 0, 0, [0]))[3]:
            best[doc, item] = (share * float(index.own[item]), share, begin, parts)
    return [(doc, index.ids[item], x[0], *x[3], x[2]) for (doc, item), x in sorted(best.items())]


def indexes(benchmark: DataFrame, key: str = "item_id") -> Iterator[list[Index]]:
    """One index for each INDEX_BYTES of items; term and length statistics are of the whole benchmark."""
    items = benchmark.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    parts = (size["b"] or 0) // INDEX_BYTES + 1

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row = _words(batch.column("text"))
            pair = np.unique(np.column_stack([row.astype(np.uint64), h]), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(pair[:, 0].astype(np.int64))), pa.array(pair[:, 1].view(np.int64) if len(pair) else np.zeros(0, np.int64)), pa.array(np.zeros(len(pair), np.int64))], names=["part", "term", "words"])
            yield pa.RecordBatch.from_arrays([batch.column("part").slice(0, 1), pa.array([0], pa.int64()).slice(0, min(1, batch.num_rows)), pa.array([len(h)], pa.int64()).slice(0, min(1, batch.num_rows))], names=["part", "term", "words"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
    if parts == 1:
        rows = dealt.collect()  # within INDEX_BYTES
        texts = [r["text"] for r in rows]
        n = len(_words(pa.array(texts, pa.string()))[0])
        yield build_index([r["id"] for r in rows], texts, len(rows), n / max(len(rows), 1))
        return
    found = dealt.mapInArrow(terms, "part int, term long, words long").cache()
    mean = found.agg(F.sum("words")).first()[0] / size["n"]
    df = found.where("words = 0").groupBy("term").agg(F.count("*").alias("df"))
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).collect()  # about INDEX_BYTES
        own = found.where((F.col("part") == part) & (F.col("words") == 0)).select("term").distinct().join(df, "term").collect()
        yield build_index([r["id"] for r in rows], [r["text"] for r in rows], size["n"], mean, {r["term"] & (2**64 - 1): r["df"] for r in own})
    found.unpersist()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap, first_word: the items found in each document.

    The documents are read once for each index and never shuffled. Null and empty texts and items match nothing; items with fewer
    than LEAST_WORDS words are matched by their exact words; repeated documents or items give repeated rows; other columns are not read.
    """
    spark, out = docs.sparkSession, None
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double, first_word long"
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_type = to_arrow_type(_parse_datatype_string(kinds[1]))
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)  # INDEX_BYTES of items, whatever the size of the corpus

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = find(shared.value, part.column("text"))
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), *[pa.array(c, pa.float64()) for c in cols[2:6]], pa.array(cols[6], pa.int64())],
                        names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "first_word"],
                    )

        found = bounded_batches(docs).select("doc_id", "text").mapInArrow(released(run), schema)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which an item is found; all columns stay and nothing is shuffled."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in find(shared.value, part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = bounded_batches(docs).mapInArrow(released(run), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """All benchmark items found in any document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, benchmark)
