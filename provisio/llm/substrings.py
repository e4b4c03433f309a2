"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Two equal strings of LENGTH bytes have the same anchor: the least hashed gram in them. Anchors that stand once cannot lie in a
repeat, so only the surroundings of repeated anchors are sorted. Surroundings with the same anchor meet in one task, which builds the
transforms of small shards and merges them by refining their interleaving; rows whose common prefix with the row above
is LENGTH form the repeated intervals, and all but the first place in each are repeats. Where very many surroundings share an anchor, the anchor is made
longer on both sides until few do, so no task has to hold them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUE, SECOND, _powers, bounded_batches, drop_staged, keep_members, member_filter, mix, slices, span_hashes, staged, utf8, without_members

LENGTH, GRAM = 100, 40
#: Bits of the prefilter of repeated anchors: 8 MB whatever the size of the corpus. It only saves work; an exact join follows.
SLOTS = 1 << 26
#: Bytes of a shard's transform, and of the surroundings that one merge takes (an anchor's are never divided).
SHARD_BYTES, MERGE_BYTES = 1 << 16, 1 << 20
#: An anchor with more different surroundings than this is made longer (40, 70, 85, 93, 97, 99, 100 bytes) until it has fewer; one of
#: LENGTH bytes has one. So many surroundings take 160 bytes each at most.
MOST_CONTEXTS = 4_000
#: Bits of a gram's place within a block of text when anchors are chosen; the others are its hash's.
PLACE_BITS = 21


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, first and last start of the LENGTH-byte strings whose anchor it is; strings never cross rows.

    Of grams whose hashes agree but for PLACE_BITS the leftmost counts, wherever the string stands; a long text is read in blocks,
    and an anchor over a block's end is given twice, with the strings of either block.
    """
    size = 1 << PLACE_BITS
    if len(data) <= size:
        return _anchors(data, off)
    out = []
    for begin in range(0, len(data) - LENGTH + 1, size - LENGTH + 1):
        part = data[begin : begin + size]
        gram, *places = _anchors(part, np.clip(off - begin, 0, len(part)))
        out.append((gram, *(x + begin for x in places)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * power[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & place).astype(np.int64)
    crossing = np.zeros(n + 2, np.int32)
    inner = off[1:-1]
    np.add.at(crossing, np.maximum(inner - LENGTH + 1, 0), 1)
    np.add.at(crossing, inner, -1)
    start = np.flatnonzero(np.cumsum(crossing)[: len(at)] == 0)
    if not len(start):
        return none, none, none, none
    at = at[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    return gram[at[new]].view(np.int64), at[new], start[new], start[np.r_[new[1:], len(start)] - 1]


def _spots(docs: DataFrame) -> DataFrame:
    """k, doc_id, text; k is one number for a document, so rows that repeat an id and text are one document."""
    return docs.select(F.xxhash64("doc_id", "text", F.octet_length("text")).alias("k"), "doc_id", "text")


def _bit_set(slots: DataFrame) -> np.ndarray:
    """A bit for each slot (0 to SLOTS - 1) that stands in the table: SLOTS / 64 rows reach the driver at most."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64)
    return bits


def _repeated_anchors(docs: DataFrame) -> np.ndarray:
    """The bit set of anchors that stand more than once, anywhere in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, n = np.unique(anchors(*utf8(part.column("text")))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])

    often = docs.select("text").mapInArrow(run, "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    return _bit_set(often.select(F.col("anchor").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")))


def _contexts(docs: DataFrame, bits: np.ndarray, with_bytes: bool) -> DataFrame:
    """anchor, print, second, k, doc_id, first, size of the surroundings of anchors, that is of all strings with that anchor.

    print and second are independent hashes of the bytes. Without bytes: those whose anchor is in the bit set. With bytes (and at,
    the anchor's place): those whose own place is in it, as _place_slot has it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["anchor", "print", "second", "k", "doc_id", "first", "size", "at", "bytes"][: 9 if with_bytes else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = utf8(part.column("text"))
                anchor, at, first, last = anchors(data, off)
                if with_bytes:
                    print_ = span_hashes(data, first, last + LENGTH).view(np.int64)
                    row = np.searchsorted(off, first, "right") - 1
                    slot = (print_ ^ np.asarray(part.column("k"), np.int64)[row] ^ ((first - off[row]) << 7)) & (SLOTS - 1)
                else:
                    slot = anchor & (SLOTS - 1)
                use = np.flatnonzero((bits[slot >> 6] >> (slot & 63)) & 1)
                anchor, at, first, last = anchor[use], at[use], first[use], last[use]
                row = np.searchsorted(off, first, "right") - 1
                size = last - first + LENGTH
                pick = pa.array(row)
                cols = [pa.array(anchor), *[pa.array(h) for h in _prints(data, first, last + LENGTH)], part.column("k").take(pick), part.column("doc_id").take(pick), pa.array(first - off[row]), pa.array(size.astype(np.int32))]
                if with_bytes:
                    cols += [pa.array((at - first).astype(np.int32)), _cut(data, first, size)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, f"anchor long, print long, second long, k long, doc_id {kind}, first long, size int" + ", at int, bytes binary" * with_bytes)


def _prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each span's bytes."""
    return span_hashes(data, start, end).view(np.int64), span_hashes(data, start, end, SECOND).view(np.int64)


def _cut(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans' bytes."""
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())]).cast(pa.binary())


def _place_slot():
    return F.col("print").bitwiseXOR(F.col("k")).bitwiseXOR(F.shiftleft("first", 7)).bitwiseAND(F.lit(SLOTS - 1))


def _packed(first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight characters from each row on as one number, and the row eight steps further."""
    key, at = first.astype(np.uint64), step
    for _ in range(7):
        key = key << np.uint64(8) | first[at]
        at = step[at]
    return key, at


def _refined(order: np.ndarray, key: np.ndarray, step: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order, sorted by eight characters (key), refined to LENGTH of them, and each row's common prefix with the row above.

    Rows with equal prefixes are a block. Those of a block are told apart by the blocks of the rows that stand as many characters further
    (step is one, ahead eight characters on), which doubles the prefix; rows that are alone in their block are left where they are. The common
    prefix is LENGTH, or the last length at which the two were still in one block.
    """
    n = len(order)
    each = np.arange(n)
    head = np.r_[True, key[order[1:]] != key[order[:-1]]]
    block = np.empty(n, np.int64)
    block[order] = np.maximum.accumulate(np.where(head, each, 0))
    common = np.where(head, 0, LENGTH)
    open_ = np.flatnonzero(~head | np.r_[~head[1:], False])
    depth, jump = 8, 8
    while depth < LENGTH and len(open_):
        if depth + jump > LENGTH:
            jump, ahead = LENGTH - depth, _ahead(step, LENGTH - depth)
        rows = order[open_]
        key = block[rows] * n + block[ahead[rows]]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[open_] = rows
        head = np.r_[True, key[1:] != key[:-1]]
        block[rows] = open_[np.maximum.accumulate(np.where(head, each[: len(rows)], 0))]
        parted = open_[head]
        common[parted[common[parted] == LENGTH]] = depth
        open_ = open_[~head | np.r_[~head[1:], False]]
        depth += jump
        jump, ahead = 2 * jump, ahead[ahead]
    return order, common


def _ahead(step: np.ndarray, n: int) -> np.ndarray:
    """The row n steps further."""
    out = np.arange(len(step))
    while n:
        if n & 1:
            out = step[out]
        step, n = step[step], n >> 1
    return out


def shard_transform(data: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of strings that end with 0 and wrap (following: next position), and the positions sorted by LENGTH characters."""
    key, ahead = _packed(data, following)
    order, _ = _refined(np.argsort(key, kind="stable"), key, following, ahead)
    before = np.empty(len(data), np.int64)
    before[following] = np.arange(len(data))
    return data[before[order]], order


def merge_transforms(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave transforms: for each merged row its place in their concatenation, and its common prefix with the row above.

    The interleaving by eight characters is refined to 16, 32, 64 and LENGTH. A shard's rows keep their order throughout, so the t-th row of a shard
    is that shard's t-th in every round. Characters are read from the transforms alone: the row of the suffix that begins one
    character later is where the row's first character stands in its shard's transform.
    """
    later = np.concatenate([np.argsort(t, kind="stable") + at for t, at in zip(transforms, np.cumsum([0, *map(len, transforms)]), strict=False)])
    first = np.concatenate(transforms)[later]
    key, ahead = _packed(first, later)
    return _refined(np.argsort(key, kind="stable"), key, later, ahead)


def later_windows(sizes: np.ndarray, data: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings one after the other (string number, from, to): the runs of LENGTH-byte windows that stand in an earlier place too.

    rank orders windows: rank[s] + offset is the place of string s's window at that offset.
    """
    ends = np.cumsum(sizes)
    transforms, starts, begin = [], [], 0
    while begin < len(sizes):
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin] - sizes[begin]) + SHARD_BYTES, "right")))
        own = sizes[begin:to] + 1
        stop = np.cumsum(own)
        text = np.zeros(int(stop[-1]), np.uint8)
        inner = np.ones(len(text), bool)
        inner[stop - 1] = False
        low, high = int(ends[begin] - sizes[begin]), int(ends[to - 1])
        text[inner] = data[low:high] + 1  # UTF-8 has no byte 255, so 0 is free for the ends
        following = np.arange(1, len(text) + 1)
        following[stop - 1] = stop - own
        transform, order = shard_transform(text, following)
        at = np.full(len(text), -1, np.int64)
        at[inner] = np.arange(low, high)
        transforms.append(transform)
        starts.append(at[order])
        begin = to
    place, common = merge_transforms(transforms)
    # repeated intervals: rows whose common prefix with the row above, or below, has the whole length
    same = common == LENGTH
    rows = np.flatnonzero(same | np.r_[same[1:], False])
    interval = np.cumsum(~same)[rows]
    position = np.concatenate(starts)[place[rows]]
    string = np.searchsorted(ends, position, "right")
    string[position < 0] = 0
    offset = position - (ends - sizes)[string]
    whole = (position >= 0) & (offset <= sizes[string] - LENGTH)
    interval, string, offset = interval[whole], string[whole], offset[whole]
    where = rank[string] + offset
    order = np.lexsort((where, interval))
    interval, string, offset, where = interval[order], string[order], offset[order], where[order]
    head = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]]) if len(interval) else np.zeros(0, np.int64)
    first = np.repeat(where[head], np.diff(np.r_[head, len(interval)]))
    late = where > first
    string, offset = string[late], offset[late]
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(string) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(string)] - 1 if len(new) else new
    return string[new], offset[new], offset[last] + LENGTH


def _by_transforms(contexts: DataFrame) -> DataFrame:
    """k, start, end of repeats among the surroundings (one row for each anchor and content); anchors meet by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(table: pa.Table) -> pa.RecordBatch:
            order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("k", "ascending")], null_placement="at_start")
            table = table.take(order).combine_chunks()
            k, ids = np.asarray(table.column("k"), np.int64), table.column("doc_id").combine_chunks()
            first, sizes = np.asarray(table.column("first"), np.int64), np.asarray(table.column("size"), np.int64)
            document = np.cumsum(np.r_[True, k[1:] != k[:-1]])
            data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            string, low, high = later_windows(sizes, data, document * (1 << 40) + first)
            return pa.RecordBatch.from_arrays([pa.array(k[string]), pa.array(first[string] + low), pa.array(first[string] + high)], names=["k", "start", "end"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < MERGE_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = np.asarray(table.column("anchor"), np.int64)
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    dealt = contexts.select("anchor", "k", "doc_id", "first", "size", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "k long, start long, end long")


def _longer(contexts: DataFrame, core: int) -> DataFrame:
    """contexts (with bytes) of anchors of core bytes as those of longer ones: each string keeps its anchor and the bytes on that side of it which has more of them.

    Equal strings have their anchor in the same place, so they share the longer one too.
    """
    half = (LENGTH - core + 1) // 2
    kind = dict(contexts.dtypes)["doc_id"]
    names = ["anchor", "print", "second", "k", "doc_id", "first", "size", "at", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 10_000):
                part = batch.slice(low, 10_000)
                size, at = np.asarray(part.column("size"), np.int64), np.asarray(part.column("at"), np.int64)
                data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
                begin = np.cumsum(size) - size
                last = size - LENGTH  # starts of strings: 0 to last
                for side in (0, 1):
                    lo, hi = (np.zeros_like(at), np.minimum(last, at - half)) if side == 0 else (np.maximum(0, at - half + 1), last)
                    use = np.flatnonzero(lo <= hi)
                    lo, hi, own = lo[use], hi[use], begin[use]
                    new = at[use] - half * (side == 0)
                    anchor = mix(np.asarray(part.column("anchor"), np.int64)[use].view(np.uint64) + span_hashes(data, own + new, own + new + core + half) + np.uint64(side)).view(np.int64)
                    pick = pa.array(use)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), *[pa.array(h) for h in _prints(data, own + lo, own + hi + LENGTH)], part.column("k").take(pick), part.column("doc_id").take(pick), pa.array(np.asarray(part.column("first"), np.int64)[use] + lo), pa.array((hi - lo + LENGTH).astype(np.int32)), pa.array((new - lo).astype(np.int32)), _cut(data, own + lo, hi - lo + LENGTH)],
                        names=names,
                    )

    return contexts.select(*names).mapInArrow(run, f"anchor long, print long, second long, k long, doc_id {kind}, first long, size int, at int, bytes binary")


_CONTENT = ["anchor", "print", "second"]


def _is_head():
    return F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.k") == F.col("k")) & (F.col("head.first") == F.col("first"))


def _heads(place: DataFrame) -> DataFrame:
    """anchor, print, second, head, n: the first of all surroundings of equal content; counted before rows move."""
    return staged(place.groupBy(*_CONTENT).agg(F.min(F.struct("doc_id", "k", "first")).alias("head"), F.count("*").alias("n")), "heads")


def _copies(place: DataFrame, heads: DataFrame) -> DataFrame:
    """k, start, end of later copies of whole surroundings: all their strings start earlier too."""
    return place.join(heads.where("n > 1"), _CONTENT).where(~_is_head()).select("k", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"))


def _several(heads: DataFrame) -> DataFrame:
    """Heads of the anchors that have surroundings of more than one kind."""
    kinds = heads.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return staged(heads.join(kinds, "anchor").select(*_CONTENT, "head", "kinds"), "several")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k, runs: the byte runs (start, end) of each document that are covered by LENGTH-byte strings which start earlier too.

    Earlier means in a document of smaller id (null is the smallest), or in the same one before; overlaps count.
    """
    docs = _spots(bounded_batches(docs).where("octet_length(text) >= %d" % LENGTH))
    place = staged(_contexts(docs, _repeated_anchors(docs), False), "places")
    heads = _heads(place)
    spans = staged(_copies(place, heads), "copies")
    several = _several(heads)
    drop_staged(place, heads)
    # first copies of the surroundings of anchors that have more than one kind of them: only their bytes are fetched
    bits = _bit_set(several.select("print", "head.k", "head.first").select(_place_slot().alias("slot")))
    columns = [*_CONTENT, "k", "doc_id", "first", "size", "at", "bytes", "kinds"]
    mixed = staged(_contexts(docs, bits, True).join(several, _CONTENT).where(_is_head()).select(*columns).dropDuplicates([*_CONTENT, "k", "first"]), "mixed")
    core = GRAM
    while True:
        spans = spans.union(staged(_by_transforms(mixed.where(F.col("kinds") <= MOST_CONTEXTS)), "spans"))
        crowded = mixed.where(F.col("kinds") > MOST_CONTEXTS)
        if core == LENGTH or not crowded.limit(1).count():
            break
        place = staged(_longer(crowded, core), "places")
        core += (LENGTH - core + 1) // 2
        heads = _heads(place)
        spans = spans.union(staged(_copies(place, heads), "copies"))
        last, mixed = mixed, staged(place.join(_several(heads), _CONTENT).where(_is_head()).select(*columns), "mixed")
        drop_staged(last, place, heads)
    drop_staged(mixed)
    by = Window.partitionBy("k").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("new", F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining bytes and the runs, for every row of docs.

    Null and empty texts have no bytes. Rows that repeat an id and text get equal results. Documents without repeats never move.
    """
    runs = staged(repeated_spans(docs.select("doc_id", "text")), "runs")
    keyed = docs.select(F.xxhash64("doc_id", "text", F.octet_length("text")).alias("_k"), "doc_id", "text")
    bitmap = staged(member_filter(runs, "k"), "bitmap")
    touched = keep_members(keyed, bitmap, "_k").join(runs, F.col("_k") == F.col("k"), "left").select("doc_id", "text", "runs")
    rest = without_members(keyed, bitmap, "_k").select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, gone = [], 0, 0
                for r in cut or ():
                    kept.append(raw[at : r["start"]])
                    at, gone = r["end"], gone + r["end"] - r["start"]
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), gone, len(cut or ()), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            if with_text:
                arrays += [pa.array(cols[4], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs"][: len(arrays)])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, runs array<struct<start:long,end:long>>" if with_text else "")
    return touched.unionByName(rest).mapInArrow(run, schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and a digest of what is left."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
