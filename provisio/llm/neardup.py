"""Near duplicates by MinHash with tensored banding: table keys are pairs of sketches from two small collections; links are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, drop_staged, keep_members, member_filter, mix, released, slices, span_hashes, spans, staged, utf8

#: Two collections of SIDE sketches of HASHES minhashes each give SIDE * SIDE tables from 2 * SIDE * HASHES minhashes. A pair of
#: similarity s shares no key with probability below 2 * (1 - s ** HASHES) ** SIDE: 5.6e-4 at 0.8, 3e-6 at 0.9.
SIDE, HASHES = 8, 2
#: Rounds in which each table key offers one centre; what then is left in two classes is compared in full where sizes allow a link.
CENTRE_ROUNDS = 2
#: Bits of a set's parities: bit b tells whether the set has an odd number of shingles of hash b. Two sets differ in at least as many
#: shingles as their parities do, which rules pairs out before their texts move.
PARITY_BITS = 512
#: In that comparison a shingle of so few documents is rare: its documents are paired outright.
RARE = 4

_RNG = np.random.default_rng(77)
_FACTOR = _RNG.integers(1, 2**63, 2 * SIDE * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, 2 * SIDE * HASHES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed shingles of each row, one row after the other, and each row's number of them.

    A-Z are lower-cased; words are what ASCII white space separates; a row with fewer words has its whole sequence as one shingle.
    """
    data = LOWER[data]
    start, end, row = spans(data, off)
    n_rows = len(off) - 1
    n_words = np.bincount(row, minlength=n_rows)
    h = span_hashes(data, start, end)
    first = np.cumsum(n_words) - n_words
    count = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    owner = np.repeat(np.arange(n_rows), count)
    last = (first + n_words)[owner]
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < last
        value += np.where(there, h[np.minimum(at + k, max(len(h) - 1, 0))] * _PLACE[k] if len(h) else 0, np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=n_rows)


def _sketches(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """2 * SIDE sketches a row (rows without shingles: zeros)."""
    out = np.zeros((len(count), 2 * SIDE), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        first = (np.cumsum(count) - count)[full]
        for i in range(2 * SIDE):
            for k in range(HASHES):
                j = i * HASHES + k
                low = np.minimum.reduceat(value * _FACTOR[j] + _SHIFT[j], first)
                out[full, i] = mix(out[full, i] * _PLACE[40 + k] + low)
    return out


def _parities(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits of each row's set, as numbers of 64 bits."""
    slot = np.repeat(np.arange(len(count)) * PARITY_BITS, count) + (value >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=len(count) * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, p1 and p2 (two hashes of the whole set), sketches and parities of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                value, count = shingles(*utf8(part.column("_text")), words)
                full = np.flatnonzero(count)
                prints = []
                for k in (50, 51):
                    total = np.zeros(len(count), np.uint64)
                    if len(full):
                        total[full] = np.add.reduceat(mix(value * _PLACE[k] + _PLACE[k]), (np.cumsum(count) - count)[full])
                    prints.append(total)
                lists = [(_sketches(value, count).reshape(-1).view(np.int64), 2 * SIDE), (_parities(value, count), PARITY_BITS // 64)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), *[pa.array(p.view(np.int64)) for p in prints], *[pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * n), pa.array(x)) for x, n in lists]],
                    names=["doc_id", "n_shingles", "p1", "p2", "sketches", "parities"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(released(run), "doc_id long, n_shingles long, p1 long, p2 long, sketches array<long>, parities array<long>")


def _table_keys(reps: DataFrame) -> DataFrame:
    """doc_id, key: a row for each of the SIDE * SIDE tables in which the document may meet another one.

    Two documents share a table's key only if they share both of its sketches, so sketches that stand once are left out first, in the small
    collections, before pairs are formed.
    """
    rows = reps.select("doc_id", F.posexplode("sketches").alias("i", "sketch"))
    often = rows.groupBy("i", "sketch").agg(F.count("*").alias("n")).where("n > 1").select("i", "sketch")
    own = rows.join(often, ["i", "sketch"]).groupBy("doc_id").agg(F.collect_list(F.struct("i", "sketch")).alias("own"))  # 2 * SIDE at most
    left, right = F.filter("own", lambda x: x["i"] < SIDE), F.filter("own", lambda x: x["i"] >= SIDE)
    pairs = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x["i"] * (2 * SIDE) + y["i"], x["sketch"], y["sketch"]))))
    return own.select("doc_id", F.explode(pairs).alias("key"))


def possible(percent: int, n: str, m: str, own: str, other: str) -> Column:
    """Whether sets of sizes n and m with these parities can have the similarity."""
    apart = sum((F.bit_count(F.get(own, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(1, PARITY_BITS // 64)), F.bit_count(F.get(own, F.lit(0)).bitwiseXOR(F.get(other, F.lit(0)))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m)))


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of docs for each of these ids. An inner join: a semi join would be moved below the bitmap, and all texts with it."""
    return keep_members(docs, member_filter(ids, "doc_id"), "doc_id").join(ids.distinct(), "doc_id").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """pairs (a, b) whose full sets have 100 * intersection >= percent * union, as a staged table. Only texts that stand in pairs move."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = staged(_of(docs, ends.select(F.col("id").alias("doc_id"))), "texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            ok = np.zeros(len(ids), bool)
            at = 0
            for part in slices(batch, "tb"):
                value, count = shingles(*utf8(part.column("tb")), words)
                begin = 0
                for k, n in enumerate(count.tolist()):
                    if ids[at] != centre:
                        centre, of = ids[at], shingles(*utf8(part.column("ta").slice(k, 1)), words)[0]
                    mine = value[begin : begin + n]
                    begin += n
                    spot = np.minimum(np.searchsorted(of, mine), max(len(of) - 1, 0))
                    common = int((of[spot] == mine).sum()) if len(of) else 0
                    ok[at] = common > 0 and 100 * common >= percent * (n + len(of) - common)
                    at += 1
            yield batch.select([0, 1]).filter(pa.array(ok))

    out = staged(both.mapInArrow(released(run), "a long, b long"), "links")
    drop_staged(texts)
    return out


def rare_shingles(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingle, df of the shingles that at most RARE of the documents in ids have; a common one is counted before it moves."""
    texts = _of(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, count = shingles(*utf8(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(value.view(np.int64))], names=["doc_id", "shingle"])

    rows = staged(texts.select("doc_id", "text").mapInArrow(released(run), "doc_id long, shingle long"), "shingles")
    few = rows.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    out = staged(rows.join(few, "shingle"), "rare")
    drop_staged(rows)
    return out


def _possible(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of entries (key, doc_id, root, n, r, parities) of one key and two classes that can have the similarity.

    r counts the shingles that are not rare: without a rare one in common, a pair has at most min(r) in common, so percent bounds the partner's size by ceiling = (100 + percent) / percent * r - n.
    Where a document's ceiling is below its own size it has too much of its own: two such documents can't be linked, and one of
    them only with a smaller document, found by steps of size. So the variants around a text, each with changes of its own,
    make no pairs with each other. Of the others, parities rule out most.
    """
    e = entries.withColumn("ceiling", F.col("r") * ((100 + percent) / percent) - F.col("n"))
    close, far = e.where("ceiling >= n"), e.where(F.col("ceiling") < F.col("n"))
    low, high = F.floor(F.log(F.greatest(F.col("n") * (percent / 100), F.lit(1.0))) / F.log(F.lit(1.03))), F.floor(F.log(F.greatest("ceiling", F.lit(1.0))) / F.log(F.lit(1.03)))
    other = close.select("key", F.col("doc_id").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("ceiling").alias("top"), F.col("parities").alias("others"))
    fits = (F.col("m") <= F.col("ceiling")) & (F.col("n") <= F.col("top")) & possible(percent, "n", "m", "parities", "others")
    same = close.join(other, "key").where((F.col("root") < F.col("other")) & fits).select(F.col("doc_id").alias("a"), "b")
    stepped = far.where(high >= low).withColumn("step", F.explode(F.sequence(low, high)))
    small = other.withColumn("step", F.floor(F.log("m") / F.log(F.lit(1.03))))
    return same.union(stepped.join(small, ["key", "step"]).where((F.col("root") != F.col("other")) & fits).select(F.col("doc_id").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for all ends of edges (a, b). Labels fall to the neighbours' least, then to that label's own label."""
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = staged(low.join(up, "root", "left").select("node", "was", F.coalesce(F.least("top", "root"), "root").alias("root")), "roots")
        drop_staged(labels)
        labels = new.select("node", "root")
        if not new.where("root != was").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents with equal sets are one from the start (found by two 64-bit hashes of the whole set), so copies make no pairs. Each
    table key offers links of its smallest document to its others; verified links join classes; keys that still hold two classes
    offer other centres, first the document with the least of its own, and after CENTRE_ROUNDS all their pairs between classes that can have the similarity are
    verified, so no candidate is dropped: a pair has a rare shingle in common, or its sizes without rare shingles bound what it can have; and
    sizes and parities rule out pairs that cannot have the similarity. Documents without words are linked with nothing. Repeated rows of a doc_id count as one document whose text is any
    one of them; a null doc_id is left out.
    """
    docs = bounded_batches(docs, 500).select("doc_id", "text").where("doc_id IS NOT NULL")
    sign = staged(signatures(docs, words), "signatures")
    # one representative of each set
    content = ["p1", "p2", "n_shingles"]
    groups = sign.where("n_shingles > 0").groupBy(*content).agg(F.min_by(F.struct("sketches", "parities"), "doc_id").alias("x"), F.min("doc_id").alias("doc_id"))
    reps = staged(groups.select(*content, "doc_id", "x.sketches", "x.parities"), "sets")
    keys = staged(_table_keys(reps), "keys")
    crowded = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    entries = staged(keys.join(crowded, "key").select("key", "doc_id", "centre", "size"), "entries")
    drop_staged(keys)
    about = staged(reps.join(entries.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "parities"), "about")
    first = about.select(F.col("doc_id").alias("a"), "n", "parities")
    second = about.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("parities").alias("others"))

    def sized(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that can have the similarity."""
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return p.join(first, "a").join(second, "b").where(possible(percent, "n", "m", "parities", "others")).select("a", "b")

    seen = staged(sized(entries.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))), "pairs")
    links = verified(seen, docs, percent, words)
    roots = components(links)
    # keys of two documents have had their only pair
    open_ = entries.where("size > 2").select("key", "doc_id")
    sizes = None
    for turn in range(CENTRE_ROUNDS + 1):
        labelled = open_.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        mixed = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
        open_ = staged(labelled.join(mixed, "key").select("key", "doc_id", "root"), "mixed")
        if sizes is None:
            ids = staged(open_.select("doc_id").distinct(), "open")
            rare = rare_shingles(ids, docs, words)
            own = ids.join(rare.groupBy("doc_id").agg(F.count("*").alias("rare")), "doc_id", "left").join(about, "doc_id")
            sizes = staged(own.select("doc_id", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("r"), "parities"), "sizes")
        if turn < CENTRE_ROUNDS:
            ranked = open_.join(sizes.select("doc_id", (F.col("r") / F.col("n")).alias("share")), "doc_id") if not turn else open_.withColumn("share", F.xxhash64("doc_id"))
            centres = ranked.groupBy("key").agg(F.max_by(F.struct("doc_id", "root"), F.struct("share", "doc_id")).alias("c"))
            pairs = open_.join(centres, "key").where("root != c.root").select(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b"))
        else:
            # pairs with a rare shingle in common, RARE at most a row; and those whose other shingles can suffice
            labels = open_.select("doc_id", "root").distinct()
            some = rare.where("df > 1").join(labels, "doc_id").select("shingle", "doc_id", "root")
            met = some.join(some.select("shingle", F.col("doc_id").alias("b"), F.col("root").alias("other")), "shingle").where("root < other").select(F.col("doc_id").alias("a"), "b")
            pairs = _possible(open_.join(sizes, "doc_id"), percent).union(met)
        fresh = staged(sized(pairs).join(seen, ["a", "b"], "left_anti"), "pairs")
        if fresh.limit(1).count():
            seen = seen.union(fresh)
            found = verified(fresh, docs, percent, words)
            links = links.union(found)
            if found.limit(1).count():
                roots = components(links)
        open_ = open_.select("key", "doc_id")
    rooted = reps.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(*content, F.coalesce("root", "doc_id").alias("root"))
    out = sign.select("doc_id", *content).join(rooted, content, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents by 4-word shingles at 80 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
