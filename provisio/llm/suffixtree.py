"""Language-model scores from a probabilistic suffix tree over bytes, beside an add-one unigram base over words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, SPACE, bounded_batches, drop_staged, gathered, release, released, slices, span_hashes, spans, staged, utf8
from .quality import fold

#: Longest context in bytes. A gram (context and next symbol) is a number in base 256; of seven bytes, it fits in a long.
DEPTH = 6
#: A context is kept if it occurs at least this often, however large the corpus.
LEAST = 12
#: And if its next-symbol distribution differs from that of its longest proper suffix: count * divergence (nats) is over this.
DIVERGENCE = 6.0
#: Weight with which a suffix's distribution smooths a context's own counts, for each different symbol seen after the context.
PRIOR = 4.0
#: A tree of at most so many grams (12 bytes each) is broadcast; a larger one is joined to the distinct grams of chunks of documents, with the
#: same scores. Chunks are 2 ** CHUNK_BITS rows of a partition; a text over LONG_BYTES is a chunk of its own, so a chunk has 128 MB or is one text.
MODEL_GRAMS, CHUNK_BITS, LONG_BYTES = 8_000_000, 11, 1 << 16
#: Bytes of text that are scored at a time.
SCORE_BYTES = 1 << 20
#: Grams that are counted at a time, by sorting; counts of so many distinct ones are merged at a time; grams that are looked up at a time.
COUNT_GRAMS, MERGE_GRAMS, FIND_GRAMS = 4 << 20, 3 << 20, 1 << 19
#: Words that take part in counts by broadcast: at most so many, those that are frequent within slices.
COMMON_WORDS, COMMON_IN_SLICE = 200_000, 4
END, SPACE_BYTE = 10, 32  # symbols: words are joined by spaces, a text begins after and ends with a line break


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the offsets of rows in them; start, end and row of each word."""
    data, off = utf8(texts)
    data = LOWER[data]
    return data, off, *spans(data, off)


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased words joined by single spaces, each text ended by END; offsets of rows."""
    return _joined(*_words(texts))


def _joined(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_symbols of these words."""
    n = len(off) - 1
    if not len(data):
        return np.full(n, END, np.uint8), np.arange(n + 1)
    use = ~SPACE[data]
    gap = start[1:][row[1:] == row[:-1]] - 1  # the separator before each word but a text's first becomes the space
    use[gap] = True
    data = data.copy()
    data[gap] = SPACE_BYTE
    new = np.r_[0, np.searchsorted(np.flatnonzero(use), off[1:])] + np.arange(n + 1)
    own = np.ones(int(new[-1]), bool)
    own[new[1:] - 1] = False
    out = np.full(len(own), END, np.uint8)
    out[own] = data[use]
    return out, new


def _grams(symbols: np.ndarray, new: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol the number of its preceding depth symbols and itself (eight in all at most); before a text stand END symbols."""
    stream = np.r_[np.full(7, END, np.uint8), symbols]
    out = np.ndarray(len(symbols), ">u8", stream, strides=(1,)).astype(np.int64)  # eight bytes that end at each symbol
    if depth < 7:
        out &= (1 << 8 * (depth + 1)) - 1
    ends = int.from_bytes(bytes([END]) * (depth + 1), "big")
    size = np.diff(new)
    for k in range(depth):  # a text's symbol k: what comes before the text gives way to END
        at = new[:-1][size > k] + k
        own = (1 << 8 * (k + 1)) - 1
        out[at] = out[at] & own | ends & ~own
    return out


def _counted(gram: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each occurs (or the sums of n). Without n, gram is sorted in place."""
    if n is None:
        gram.sort()
    else:
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.diff(np.r_[first, len(gram)]) if n is None else np.add.reduceat(n, first)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seen_grams of batches (_chunk, text) of a task: grams are sorted and counted COUNT_GRAMS at a time, and a chunk's counts are merged."""
    waiting: list[np.ndarray] = []  # grams that are not counted yet
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, now = 0, 0

    def count(merge: bool) -> None:
        if waiting:
            held.append(_counted(np.concatenate(waiting)))
            waiting.clear()
        if len(held) > 1 and (merge or sum(len(g) for g, _ in held) > MERGE_GRAMS):
            gram, n = np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held])
            held.clear()
            held.append(_counted(gram, n))

    def out(chunk: int) -> Iterator[pa.RecordBatch]:
        count(True)
        for gram, n in held:
            for k in range(0, len(gram), 100_000):
                part = gram[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(n[k : k + 100_000])], names=["_chunk", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            chunk = np.asarray(part.column("_chunk"), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (waiting or held) and now != chunk[a]:
                    yield from out(now)
                    size = 0
                now = int(chunk[a])
                waiting.append(_grams(*_symbols(part.slice(a, b - a).column("text")), DEPTH))
                size += len(waiting[-1])
                if size >= COUNT_GRAMS:
                    count(False)
                    size = 0
    yield from out(now)


def seen_grams(docs: DataFrame) -> DataFrame:
    """_chunk, gram, n over docs (_chunk, text): the distinct grams of each chunk and how often they occur in it.

    Counted in each chunk of a task; a chunk that two tasks share has rows of both.
    """
    return docs.select("_chunk", "text").mapInArrow(released(_seen), "_chunk long, gram long, n long")


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n over all docs. The table follows the corpus."""
    return seen_grams(docs.select(F.lit(0).cast("long").alias("_chunk"), "text")).groupBy("gram").agg(F.sum("n").alias("n"))


def _short(d: int, column: str = "gram"):
    """The last d symbols of a gram or context."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * d) - 1))


def _context():
    return F.shiftrightunsigned("gram", 8).alias("context")


def retained(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By length of context: gram, n of all grams, and context, all (its count), kinds (different symbols after it) of the contexts retained.

    A context must pass the count test and the divergence test, or be the suffix of one that does. All are Spark tables that follow
    the corpus; a gram or context meets at most 256 rows of another table.
    """
    levels, kept, chosen = {DEPTH: counts}, {}, {}
    for d in range(DEPTH - 1, -1, -1):
        levels[d] = staged(levels[d + 1].groupBy(_short(d + 1).alias("gram")).agg(F.sum("n").alias("n")), f"grams{d}")
    for d in range(DEPTH + 1):
        g = levels[d].select("gram", "n", _context())
        size = g.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("all") >= (LEAST if d else 0))
        kept[d] = staged(g.join(size, "context"), f"contexts{d}")
    needed = None
    for d in range(DEPTH, 0, -1):
        own = kept[d].withColumn("short", _short(d))
        short = kept[d - 1].select(F.col("gram").alias("short"), (F.col("n") / F.col("all")).alias("q"))
        gain = own.join(short, "short").groupBy("context").agg(F.sum(F.col("n") * F.log((F.col("n") / F.col("all")) / F.col("q"))).alias("gain"), F.first("all").alias("all"), F.first("kinds").alias("kinds"))
        found = gain.select("context", "all", "kinds", (F.col("gain") > DIVERGENCE).alias("use"))
        if needed is not None:
            found = found.join(needed, "context", "left").withColumn("use", F.col("use") | F.col("longer").isNotNull())
        chosen[d] = staged(found.where("use").select("context", "all", "kinds"), f"chosen{d}")
        needed = chosen[d].select(_short(d - 1, "context").alias("context")).distinct().withColumn("longer", F.lit(True))
    chosen[0] = staged(kept[0].select("context", "all", "kinds").distinct(), "chosen0")
    drop_staged(*kept.values())
    return [levels[d] for d in range(DEPTH + 1)], [chosen[d] for d in range(DEPTH + 1)]


def grow(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of these gram counts, as staged tables: depth, gram, share (probability of the last symbol) of the grams seen after a
    retained context; and depth, context, back: what a retained context leaves to its suffix for symbols not seen after it.

    A context's own counts are mixed with its suffix's distribution, which weighs the more, the more different symbols follow the context (Witten-Bell):
    (n + PRIOR * kinds * suffix) / (all + PRIOR * kinds). The empty context adds one for each of 256 bytes; all of them are in the table.
    """
    levels, contexts = retained(counts)
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    alphabet = counts.sparkSession.range(256).select(F.col("id").alias("gram")).join(levels[0], "gram", "left")
    shares = [staged(alphabet.select("gram", ((F.coalesce("n", F.lit(0)) + 1) / F.lit(total + 256.0)).alias("share")), "shares0")]
    for d in range(1, DEPTH + 1):
        own = levels[d].select("gram", "n", _context(), _short(d).alias("short")).join(contexts[d], "context")
        mixed = (F.col("n") + PRIOR * F.col("kinds") * F.col("share")) / (F.col("all") + PRIOR * F.col("kinds"))
        shares.append(staged(own.join(shares[-1].withColumnRenamed("gram", "short"), "short").select("gram", mixed.alias("share")), f"shares{d}"))
    share = staged(reduce(DataFrame.union, [t.select(F.lit(d).alias("depth"), "gram", "share") for d, t in enumerate(shares)]), "tree")
    back = staged(reduce(DataFrame.union, [t.select(F.lit(d).alias("depth"), "context", (PRIOR * F.col("kinds") / (F.col("all") + PRIOR * F.col("kinds"))).alias("back")) for d, t in enumerate(contexts) if d]), "backs")
    drop_staged(*levels[:-1], *contexts, *shares)
    return share, back


class Places:
    """Finds longs among distinct ones that stand in the order of a product that scatters them: a product's leading bits tell where to begin."""

    def __init__(self, keys: np.ndarray):
        """keys: in the order that order() gives."""
        self.scattered = np.r_[self.scatter(keys), np.uint64(2**64 - 1)]  # the last one ends each search
        self.begin = None  # made where it is used, so that it is not broadcast: 2 to 4 places of 4 bytes a key

    @staticmethod
    def scatter(keys: np.ndarray) -> np.ndarray:
        return np.asarray(keys, np.int64).view(np.uint64) * np.uint64(BASE)

    @staticmethod
    def order(keys: np.ndarray) -> np.ndarray:
        return np.argsort(Places.scatter(keys))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place, and whether it is there (else the place means nothing)."""
        size = len(self.scattered) - 1
        bits = size.bit_length() + 1
        shift = np.uint64(64 - bits)
        if self.begin is None:
            self.begin = np.searchsorted(self.scattered[:-1], np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
        key = self.scatter(key)
        at = self.begin[(key >> shift).view(np.int64)]
        got = self.scattered[at]
        rest = np.flatnonzero(got < key)
        while len(rest):  # once more for each key of the same leading bits
            at[rest] += 1
            following = self.scattered[at[rest]]
            got[rest] = following
            rest = rest[following < key[rest]]
        return at, (got == key) & (at < size)


@dataclass
class Tree:
    """grow()'s tables in memory: by depth, grams with log10 probabilities, and contexts with log10 weights of their suffix."""

    grams: list[Places]
    values: list[np.ndarray]
    contexts: list[Places]
    backs: list[np.ndarray]


def collected(share: DataFrame, back: DataFrame) -> Tree:
    """For trees of MODEL_GRAMS at most; 12 bytes a row come to the driver, a depth at a time."""
    out = []
    for table, key, value in ((share, "gram", "share"), (back, "context", "back")):
        keys, values = [], []
        for d in range(DEPTH + 1):
            rows = table.where(F.col("depth") == d).select(key, F.log10(value).cast("float").alias("value")).toArrow()
            own, logs = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            order = Places.order(own)
            keys.append(Places(own[order]))
            values.append(logs[order])
            del rows, own, logs, order
            release()
        out += [keys, values]
    return Tree(*out)


def log10_values(tree: Tree, gram: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each gram (DEPTH symbols and one), from its longest retained context: seen there, or left to that context's suffix."""
    out = np.zeros(len(gram))
    for k in range(0, len(gram), FIND_GRAMS):
        part, total = gram[k : k + FIND_GRAMS], out[k : k + FIND_GRAMS]
        rest = np.arange(len(part))
        for d in range(DEPTH, -1, -1):
            own = part[rest] & ((1 << 8 * (d + 1)) - 1)
            at, there = tree.grams[d].find(own)
            total[rest[there]] += tree.values[d][at[there]]
            rest, own = rest[~there], own[~there]
            if not len(rest):
                break
            at, there = tree.contexts[d].find(own >> 8)
            total[rest[there]] += tree.backs[d][at[there]]
    return out


def joined_values(grams: DataFrame, share: DataFrame, back: DataFrame) -> DataFrame:
    """gram, value of distinct grams, as log10_values has it, by joins with the tree's tables."""
    out = grams.select("gram", F.lit(0.0).alias("value"), F.lit(False).alias("found"))
    for d in range(DEPTH, -1, -1):
        s = share.where(F.col("depth") == d).select(F.col("gram").alias("_own"), "share")
        out = out.withColumn("_own", F.when(~F.col("found"), _short(d + 1))).join(s, "_own", "left")
        if d:
            b = back.where(F.col("depth") == d).select(F.col("context").alias("_context"), "back")
            out = out.withColumn("_context", F.when(~F.col("found") & F.col("share").isNull(), F.shiftrightunsigned(_short(d + 1), 8))).join(b, "_context", "left")
            left = F.coalesce(F.log10("back"), F.lit(0.0))
        else:
            left = F.lit(0.0)
        out = out.select("gram", (F.col("value") + F.coalesce(F.log10("share"), left)).alias("value"), (F.col("found") | F.col("share").isNotNull()).alias("found"))
        out = staged(out, "values") if d in (DEPTH, DEPTH // 2) else out
    return out.select("gram", "value")


def _word_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, _, start, end, row = _words(part.column("text"))
    return span_hashes(data, start, end).view(np.int64), row


def word_counts(docs: DataFrame, held: int, folds: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """Counts of training tokens: (document, rare word) rows with the word's count; common words and their counts; tokens; distinct.

    Words frequent within a slice are common, COMMON_WORDS of them at most: their counts are broadcast. All other words meet their
    count by a join on the word, where no word has more than a small share of the rows.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "_row", (fold(F.col("doc_id"), folds) != held).alias("train"), "text")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, n = np.unique(_word_rows(part)[0], return_counts=True)
                use = n >= COMMON_IN_SLICE
                yield pa.RecordBatch.from_arrays([pa.array(words[use]), pa.array(n[use])], names=["word", "n"])

    top = own.select("text").mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    common = np.asarray(top.select("word").toArrow().column(0), np.int64)
    common = common[Places.order(common)]
    shared = spark.sparkContext.broadcast(common)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, word, n, train) of rare words; training counts of common words with row null."""
        common = shared.value
        places = Places(common)
        total, seen = np.zeros(len(common), np.int64), False
        for batch in batches:
            for part in slices(batch, "text"):
                word, row = _word_rows(part)
                train = np.asarray(part.column("train").to_numpy(zero_copy_only=False), bool)
                at, is_common = places.find(word)
                total += np.bincount(at[is_common & train[row]], minlength=len(common)) if len(common) else 0
                seen = True
                word, row = word[~is_common], row[~is_common]
                order = np.lexsort((word, row))
                word, row = word[order], row[order]
                first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])]) if len(word) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(word)])
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(row[first])), pa.array(word[first]), pa.array(n), pa.array(train[row[first]])], names=["_row", "word", "n", "train"])
        if seen and len(common):
            some = np.flatnonzero(total)
            for k in range(0, len(some), 10_000):
                s = some[k : k + 10_000]
                # a task sums its own counts; rows without a document carry them
                yield pa.RecordBatch.from_arrays([pa.nulls(len(s), pa.int64()), pa.array(common[s]), pa.array(total[s]), pa.array(np.ones(len(s), bool))], names=["_row", "word", "n", "train"])

    rows = staged(own.mapInArrow(split, "_row long, word long, n long, train boolean"), "words")
    sums = rows.where("_row IS NULL").groupBy("word").agg(F.sum("n").alias("c")).toArrow()
    order = Places.order(np.asarray(sums.column("word"), np.int64))
    words, counts = np.asarray(sums.column("word"), np.int64)[order], np.asarray(sums.column("c"), np.int64)[order]
    # a rare word's rows meet its count in one place: no word here is frequent in any slice but for the cut at COMMON_WORDS
    rare = rows.where("_row IS NOT NULL")
    count = rare.groupBy("word").agg(F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("c")).where("c > 0")
    count = staged(count, "counts")
    known = count.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = own.where("train").count()
    tokens = int(known["n"] or 0) + int(counts.sum()) + ends
    distinct = int(known["v"]) + len(words) + (1 if ends else 0)
    by_doc = rare.join(count, "word").groupBy("_row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    return by_doc, words, counts, tokens, distinct


def score(docs: DataFrame, held: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Null texts count as empty and have the end token alone; a null doc_id is in fold 0; repeated rows count each. Both models learn
    from all whole texts outside the held-out fold.
    """
    docs = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.xxhash64("doc_id", "text", F.octet_length("text")))
    docs = docs.withColumn("train", fold(F.col("doc_id"), folds) != held)
    counts = staged(gram_counts(docs.where("train")), "grams")
    share, back = grow(counts)
    drop_staged(counts)
    by_doc, words, found, tokens, distinct = word_counts(docs, held, folds)
    ends = docs.where("train").count()
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    model = spark.sparkContext.broadcast((Places(words), np.log10(found + 1.0)))  # COMMON_WORDS at most
    schema = f"doc_id {kind}, _row long, n_tokens long, common_known long, common_log double, score double"

    def scored_part(part: pa.RecordBatch, values) -> pa.RecordBatch:
        """values: the log10 probabilities of an array of grams."""
        words, logs = model.value
        n_rows = part.num_rows
        data, off, start, end, row = _words(part.column("text"))
        symbols, new = _joined(data, off, start, end, row)
        total = np.add.reduceat(values(_grams(symbols, new, DEPTH)), new[:-1])
        at, is_common = words.find(span_hashes(data, start, end).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("_row"), pa.array(np.bincount(row, minlength=n_rows) + 1), pa.array(np.bincount(row[is_common], minlength=n_rows)),
                pa.array(np.bincount(row[is_common], logs[at[is_common]], minlength=n_rows) if len(logs) else np.zeros(n_rows)), pa.array(total),
            ],
            names=["doc_id", "_row", "n_tokens", "common_known", "common_log", "score"],
        )

    if share.count() <= MODEL_GRAMS:
        tree = spark.sparkContext.broadcast(collected(share, back))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, "text", SCORE_BYTES):
                for part in slices(batch, "text", 2 * SCORE_BYTES):
                    yield scored_part(part, lambda gram: log10_values(tree.value, gram))

        scored = docs.select("doc_id", "_row", "text").mapInArrow(released(run), schema)
    else:
        # the tree follows the corpus: each distinct gram of a chunk of documents gets its value by joins, and meets its documents again
        chunk = F.when(F.octet_length("text") > LONG_BYTES, -1 - F.col("_id")).otherwise(F.shiftright("_id", CHUNK_BITS))
        texts = staged(docs.withColumn("_id", F.monotonically_increasing_id()).withColumn("_chunk", chunk).drop("_id"), "texts")  # so that a chunk holds the same documents whenever it is read
        seen = staged(seen_grams(texts).select("_chunk", "gram").distinct(), "seen")
        values_of = staged(joined_values(seen.select("gram").distinct(), share, back), "values")

        def run_chunk(texts: pa.Table, known: pa.Table) -> pa.Table:
            gram, value = np.asarray(known.column("gram"), np.int64), np.asarray(known.column("value"), float)
            order = Places.order(gram)
            places, value = Places(gram[order]), value[order]
            parts = [p for b in texts.combine_chunks().to_batches() for p in slices(b, "text")]
            return pa.Table.from_batches([scored_part(p, lambda g: value[places.find(g)[0]]) for p in parts])

        looked_up = seen.join(values_of, "gram").groupBy("_chunk")
        scored = texts.select("_chunk", "doc_id", "_row", "text").groupBy("_chunk").cogroup(looked_up).applyInArrow(run_chunk, schema)
    # rows that repeat an id and text share _row, and their rare words are counted once for each of them
    copies = F.count("*").over(Window.partitionBy("_row"))
    joined = scored.join(by_doc, "_row", "left").withColumn("_copies", copies)
    end_log = math.log10(ends + 1)
    base = F.col("common_log") + F.coalesce(F.col("rare_log") / F.col("_copies"), F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    return joined.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("common_known") + F.coalesce((F.col("rare_known") / F.col("_copies")).cast("long"), F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op9_suffix_tree_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and suffix-tree scores of all documents, learned outside the fold crc32 mod 7 = 2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
